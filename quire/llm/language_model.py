"""A bigram language model in a log-frequency Bloom filter."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import BLOCK_BITS, Words, bounded_batches, chunked, has_bits, mix64, stored, utf8_rows

FILTER_BITS = 28
FLOOR = 1 << 22
BITS_PER_EVENT = 12
STEPS_PER_DOUBLING = 2
HEAD_TOKENS = 1 << 18
HELD_GRAMS = 1 << 21
HEAVY = 1 << 12
BUCKET_TOKENS = 1 << 20
HELD_PLACES = 1 << 20
HELD_SUMS = 1 << 22
GROUP_BITS = 8
FINE_BITS = 2
TAIL = 255
DISCOUNT = 0.75
_END = np.uint64(0xA0761D6478BD642E)
_COUNT = np.uint64(0x8EBC6AF09C88C6E3)
_REST = np.uint64(0xE7037ED1A0B428DB)
_HISTORY = ((1 << 37) - 1) & ~1
_PAIR = np.uint64(0x589965CC75374CC3)
_STOP = _END & ~np.uint64(1)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, token code and bigram code of every token; a text's last token is its end, which is also what stands before
    its first. Tokens have even codes. Bigrams have odd ones: 36 bits of the first token, so that the bigrams of a history
    can be summed, and 27 of both. Of a billion different tokens one in seventy shares its 36 bits with another, as do
    the followers of one token that are more than some millions."""
    words = Words([t.lower() for t in texts])
    h, at = words.hashes(1)
    token = np.full(len(h) + len(texts), _END, dtype=np.uint64)
    token[at + words.row] = h
    token &= ~np.uint64(1)
    row = np.repeat(np.arange(len(texts)), words.counts + 1)
    before = np.concatenate(([_END], token[:-1]))
    pair = mix64(before * _PAIR + token) & ~np.uint64(_HISTORY | 1)
    return row, token, pair | (before & np.uint64(_HISTORY)) | np.uint64(1)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(gram, kind="stable")
    gram = gram[order]
    at = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    return gram[at], np.add.reduceat(n[order], at)


def count_grams(texts: DataFrame, pairs: bool = True) -> DataFrame:
    """(gram, n): exact counts of all tokens and bigrams, or of tokens alone. A task sums up to HELD_GRAMS rows before it hands them on."""

    def batch_of(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        gram, n = _summed(parts)
        return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], names=["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            rows = utf8_rows(batch.column("text"))
            for i, j in chunked(rows):
                _, token, pair = grams(rows[i:j])
                for codes in (token, pair) if pairs else (token,):
                    held.append(np.unique(codes, return_counts=True))
                    size += len(held[-1][0])
                if size > HELD_GRAMS:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    return texts.select(F.col("text").cast("string")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def level(n: Column, unit: float = 1.0) -> Column:
    """Quantised count: 0 below the unit, 1 from there on, and STEPS_PER_DOUBLING more for each doubling."""
    return F.when(n >= unit, (F.floor(F.log2(n / unit) * STEPS_PER_DOUBLING + 1e-9) + 1).cast("int")).otherwise(0)


def level_of(n: np.ndarray) -> np.ndarray:
    """level of an array, by units of 1."""
    return np.where(n >= 1, np.floor(np.log2(np.maximum(n, 1)) * STEPS_PER_DOUBLING + 1e-9).astype(np.int64) + 1, 0)


def count_at(levels: int, unit: float = 1.0) -> np.ndarray:
    """The mean of the whole counts that share a level; 0 for level 0."""
    edges = unit * 2.0 ** (np.arange(levels + 1) / STEPS_PER_DOUBLING)
    low, high = np.ceil(edges[:-1] - 1e-9), np.ceil(edges[1:] - 1e-9) - 1
    return np.concatenate(([0.0], np.where(high >= low, (low + high) / 2, edges[:-1])))


def _places(code: np.ndarray, j: int, kind: np.uint64, filter_bits: int) -> list[np.ndarray]:
    """The bits of the event "code has level j or more": three in the code's block."""
    g = mix64(code + np.uint64(j * int(kind) & 0xFFFFFFFFFFFFFFFF))
    block = (code >> np.uint64(64 - filter_bits + BLOCK_BITS)) << np.uint64(BLOCK_BITS)
    mask = np.uint64((1 << BLOCK_BITS) - 1)
    return [block + ((g >> np.uint64(BLOCK_BITS * i)) & mask) for i in range(3)]


@dataclass
class Model:
    """What scoring needs: the filter, the exact counts of the most frequent tokens and the totals; of a whole model also how
    many levels there are, and the heavy histories with the levels of their counts and rests."""

    bits: np.ndarray
    filter_bits: int
    most: int
    unit: float
    head: np.ndarray
    head_n: np.ndarray
    tokens: int
    distinct: int
    every_level: int = 0
    heavy: np.ndarray | None = None
    heavy_level: np.ndarray | None = None
    heavy_rest: np.ndarray | None = None

    def levels(self, code: np.ndarray, kind: np.uint64 = _COUNT) -> np.ndarray:
        """The level of each code: probed from 1 up until an event isn't in the filter."""
        out, live = np.zeros(len(code), dtype=np.int64), np.arange(len(code))
        for j in range(1, self.most + 1):
            hit = np.logical_and.reduce([has_bits(self.bits, place) for place in _places(code[live], j, kind, self.filter_bits)])
            live = live[hit]
            if not len(live):
                break
            out[live] = j
        return out


def _totals(counts: DataFrame) -> tuple[int, int, int, int]:
    """Of the tokens in counts: how often they run, how many differ, the largest count, and the level from which on they are
    HEAD_TOKENS at most."""
    by_level = counts.groupBy(level(F.col("n")).alias("q")).agg(F.count("*").alias("grams"), F.sum("n").alias("n"), F.max("n").alias("top")).collect()
    head_level = next(q for q in range(1, 200) if sum(r["grams"] for r in by_level if r["q"] >= q) <= HEAD_TOKENS)
    return sum(r["n"] for r in by_level), sum(r["grams"] for r in by_level), max((r["top"] for r in by_level), default=1), head_level


def _head(counts: DataFrame, head_level: int) -> tuple[np.ndarray, np.ndarray]:
    head = counts.where(level(F.col("n")) >= head_level).select("gram", "n").toArrow()
    code, n = head.column("gram").to_numpy().view(np.uint64), head.column("n").to_numpy()
    order = np.argsort(code)
    return code[order], n[order]


def _most(top: int, unit: float) -> int:
    return max(1, int(np.floor(np.log2(top / unit) * STEPS_PER_DOUBLING + 1e-9)) + 1) if top >= unit else 1


def _fits(floor: int, filter_bits: int) -> None:
    if 4.5 * floor * BITS_PER_EVENT > 1 << filter_bits:
        raise ValueError(f"{4.5 * floor:.0f} events of {BITS_PER_EVENT} bits may not fit a filter of 2**{filter_bits} bits")


def fit(texts: DataFrame, filter_bits: int, floor: int, discount: float = DISCOUNT) -> tuple[Model, DataFrame]:
    """The bounded model of all given texts and the stored counts (gram, n).

    Every token and bigram is counted. The filter has the tokens and bigrams that are 1 / floor of all tokens or more: a rule of relative
    frequency, so that it says the same of a corpus and of the corpus taken twice; up to `floor` tokens it holds
    everything, bigrams seen once too. Its unit, a level's first count, is that share. An n-gram of m units makes at most
    1.5 m events and all n-grams of an order are `floor` units, so there are at most 4.5 * floor events (tokens, bigrams
    and rests), whatever the input: that bounds what is broadcast, and is checked against BITS_PER_EVENT bits each.

    Beside its count a history has its rest in the filter: how often it was followed by something else than its bigrams
    there, discounts included. Tokens below the unit are not lost: score joins their exact counts. The exact counts sent
    along are those of at most HEAD_TOKENS tokens.
    """
    _fits(floor, filter_bits)
    counts = stored(count_grams(texts), "gram-counts")
    is_pair = F.col("gram") % 2 != 0
    tokens, distinct, top, head_level = _totals(counts.where(~is_pair))
    unit = max(1.0, tokens / floor)

    ranked = counts.select("gram", "n", level(F.col("n"), unit).alias("q"), is_pair.alias("pair"), F.col("gram").bitwiseAND(F.lit(_HISTORY)).alias("history"))
    pairs, alone = ranked.where(F.col("pair") & (F.col("q") > 0)), ranked.where(~F.col("pair"))
    followed = stored(pairs.groupBy("history").agg(F.sum(F.col("n") - discount).alias("followed")), "followed")
    shares = followed.join(alone.groupBy("history").agg(F.sum("n").alias("all")), "history").select("history", (1 - F.col("followed") / F.col("all")).alias("share"))
    rest = F.when(F.col("share").isNotNull(), level(F.greatest(F.lit(unit), F.col("n") * F.col("share")), unit)).otherwise(0)
    entries = alone.where(F.col("q") > 0).join(shares, "history", "left").select("gram", "q", rest.alias("rest")).unionAll(pairs.select("gram", "q", F.lit(0)))

    def build(frame):
        import pandas as pd

        bits = np.zeros(1 << BLOCK_BITS, dtype=np.uint8)
        code = frame["gram"].to_numpy().view(np.uint64)
        for kind, q in ((_COUNT, frame["q"].to_numpy()), (_REST, frame["rest"].to_numpy())):
            for j in range(1, int(q.max()) + 1):
                for place in _places(code[q >= j], j, kind, filter_bits):
                    bits[(place & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)] = 1
        return pd.DataFrame({"block": [int(code[0] >> np.uint64(64 - filter_bits + BLOCK_BITS))], "bits": [np.packbits(bits).tobytes()]})

    bits = np.zeros((1 << (filter_bits - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), dtype=np.uint8)
    for r in entries.groupBy(F.shiftrightunsigned("gram", 64 - filter_bits + BLOCK_BITS).alias("b")).applyInPandas(build, "block long, bits binary").collect():
        bits[r["block"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return Model(bits.reshape(-1), filter_bits, _most(top, unit), unit, *_head(alone, head_level), tokens, distinct), counts


def _planes(codes: np.ndarray) -> bytes:
    """The bytes of codes, all first ones before all second ones: of codes in order most of the high ones are alike."""
    return codes.view(np.uint8).reshape(-1, codes.dtype.itemsize).T.tobytes()


def _codes(planes: list[bytes], kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.concatenate([np.ascontiguousarray(np.frombuffer(x, dtype=np.uint8).reshape(size, -1).T).view(kind).reshape(-1) for x in planes])


def _begins(codes: np.ndarray) -> np.ndarray:
    """Where a run of equal codes begins."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1])))


def _among(codes: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each code is among the ordered ones, and where."""
    if not len(ordered):
        return np.zeros(len(codes), bool), np.zeros(len(codes), dtype=np.int64)
    at = np.minimum(np.searchsorted(ordered, codes), len(ordered) - 1)
    return ordered[at] == codes, at


def _heavy_followers(texts: DataFrame, heavy: np.ndarray, unit: float, filter_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter of the bigrams of heavy histories that run `unit` times or more, and by how many different tokens each heavy
    history is followed. Bigrams are dealt by the filter's blocks; a task keeps one block and the counts of 1 / 2**FINE_BITS of it."""
    fine_bits = filter_bits - BLOCK_BITS + FINE_BITS
    sent = texts.sparkSession.sparkContext.broadcast(heavy)

    def pack(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        gram, n = _summed(parts)
        fine = gram >> np.uint64(64 - fine_bits)
        begin = _begins(fine)
        end = np.append(begin[1:], len(gram))
        n = n.astype(np.uint32)
        columns = [pa.array(fine[begin].astype(np.int32)), pa.array([_planes(gram[i:j]) for i, j in zip(begin, end, strict=True)], pa.binary()), pa.array([_planes(n[i:j]) for i, j in zip(begin, end, strict=True)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["fine", "gram", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            rows = utf8_rows(batch.column("text"))
            for i, j in chunked(rows):
                _, token, pair = grams(rows[i:j])
                before = np.concatenate(([_STOP], token[:-1]))
                held.append(np.unique(pair[_among(before & np.uint64(_HISTORY), sent.value)[0]], return_counts=True))
                size += len(held[-1][0])
                if size > HELD_GRAMS:
                    yield pack(held)
                    held, size = [], 0
        if size:
            yield pack(held)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = (x for batch in batches for x in batch.to_pylist())
        for block, of_block in groupby(packs, lambda x: x["fine"] >> FINE_BITS):
            bits, followers = np.zeros(1 << BLOCK_BITS, dtype=np.uint8), np.zeros(len(sent.value), dtype=np.int64)
            for _, rows in groupby(of_block, lambda x: x["fine"]):
                some = list(rows)
                gram, n = _summed([(_codes([x["gram"] for x in some], np.uint64), _codes([x["n"] for x in some], np.uint32).astype(np.int64))])
                followers += np.bincount(np.searchsorted(sent.value, gram & np.uint64(_HISTORY)), minlength=len(followers))
                gram, q = gram[n >= unit], level_of(n[n >= unit] / unit)
                for j in range(1, int(q.max(initial=0)) + 1):
                    for place in _places(gram[q >= j], j, _COUNT, filter_bits):
                        bits[(place & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)] = 1
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([np.packbits(bits).tobytes()]), pa.array([followers.tobytes()])], names=["block", "bits", "followers"])

    bits = np.zeros((1 << (filter_bits - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), dtype=np.uint8)
    followers = np.zeros(len(heavy), dtype=np.int64)
    dealt = texts.select(F.col("text").cast("string")).mapInArrow(cut, "fine int, gram binary, n binary").repartitionById(_partitions(texts), F.shiftright("fine", FINE_BITS))
    for r in dealt.sortWithinPartitions("fine").mapInArrow(build, "block long, bits binary, followers binary").collect():
        bits[r["block"]] = np.frombuffer(r["bits"], dtype=np.uint8)
        followers += np.frombuffer(r["followers"], dtype=np.int64)
    return bits.reshape(-1), followers


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fit_whole(texts: DataFrame, filter_bits: int, discount: float = DISCOUNT) -> tuple[Model, DataFrame]:
    """What is broadcast of the whole model of all given texts, and the stored counts (gram, n) of their tokens.

    The whole model has every bigram whatever the input's size, and levels begin with a count of 1. The filter is but the near
    copy of its most frequent bigrams: those of 1 / FLOOR of all tokens or more (rounded up to a whole level) whose
    history is heavy, 1 / HEAVY of all tokens or more. score counts all others where it scores them. It deals bigrams by
    their history, so that counts and rests of histories are known there; those of the heavy ones, which are dealt
    by the whole bigram, are sent along.
    """
    _fits(FLOOR, filter_bits)
    counts = stored(count_grams(texts, pairs=False), "token-counts")
    tokens, distinct, top, head_level = _totals(counts)
    unit = 2.0 ** (np.ceil(np.log2(max(1.0, tokens / FLOOR)) * STEPS_PER_DOUBLING - 1e-9) / STEPS_PER_DOUBLING)
    head, head_n = _head(counts, head_level)
    often = head_n >= tokens / max(HEAVY, _partitions(texts))
    heavy, at = np.unique(head[often] & np.uint64(_HISTORY), return_inverse=True)
    bits, followers = _heavy_followers(texts, heavy, unit, filter_bits)
    of_heavy = level_of(np.bincount(at, head_n[often], len(heavy))), level_of(np.maximum(1.0, discount * followers))
    every_level = int(level_of(np.array([top]))[0])
    return Model(bits, filter_bits, _most(top, unit), unit, head, head_n, tokens, distinct, every_level, heavy, *of_heavy), counts


def _scored(docs: DataFrame, model, discount: float) -> DataFrame:
    """One row per row of docs: sums of score and base over what is known here, and the tail tokens with their counts,
    `open` if their share of the score is still to be added too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        value, every = count_at(m.most, m.unit), m.tokens + m.distinct + 1
        for batch in batches:
            texts = utf8_rows(batch.column("text"))
            for i, j in chunked(texts):
                row, token, pair = grams(texts[i:j])
                rows = j - i
                unique, inverse = np.unique(token, return_inverse=True)
                alone = value[m.levels(unique)]
                rest = m.levels(unique, _REST)
                rest = np.where((rest > 0) & (alone > 0), np.minimum(value[rest], alone) / np.maximum(alone, 1.0), 1.0)
                before = np.concatenate(([np.searchsorted(unique, _END & ~np.uint64(1))], inverse[:-1]))
                at = np.minimum(np.searchsorted(m.head, unique), max(len(m.head) - 1, 0))
                known = m.head[at] == unique if len(m.head) else np.zeros(len(unique), bool)
                exact = np.where(known, m.head_n[at], 0) if len(m.head) else np.zeros(len(unique))
                share = (np.where(alone > 0, alone, exact) + 1.0) / every
                opened = ~known & (alone == 0)
                followed = np.maximum(np.minimum(value[m.levels(pair)], alone[before]) - discount, 0.0) / np.maximum(alone[before], 1.0)
                p = np.where(alone[inverse] > 0, followed, 0.0) + rest[before] * np.where(opened, 1.0, share)[inverse]
                score = np.bincount(row, np.log10(np.minimum(p, 1.0)), rows)
                base = np.where(known, np.log10((exact + 1.0) / every), 0.0)
                other = ~known[inverse]
                tail_row, tail = row[other], inverse[other]
                order = np.lexsort((tail, tail_row))
                tail_row, tail = tail_row[order], tail[order]
                opens = np.flatnonzero(np.concatenate(([True], (tail[1:] != tail[:-1]) | (tail_row[1:] != tail_row[:-1])))) if len(tail) else np.zeros(0, np.int64)
                n = np.diff(np.concatenate((opens, [len(tail)])))
                offsets = pa.array(np.searchsorted(tail_row[opens], np.arange(rows + 1)).astype(np.int32))
                entries = pa.StructArray.from_arrays([pa.array(unique[tail[opens]].view(np.int64)), pa.array(n), pa.array(opened[tail[opens]])], ["gram", "times", "open"])
                columns = [
                    batch.column("uid").slice(i, rows), batch.column("doc_id").slice(i, rows), batch.column("held_out").slice(i, rows),
                    pa.array(np.bincount(row, minlength=rows)), pa.array(np.bincount(row, known[inverse], rows).astype(np.int64)),
                    pa.array(np.bincount(row, base[inverse], rows)), pa.array(score), pa.ListArray.from_arrays(offsets, entries),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "held_out", "n_tokens", "head_known", "head_base", "head_score", "tail"])

    schema = "uid long, doc_id long, held_out boolean, n_tokens long, head_known long, head_base double, head_score double, tail array<struct<gram:long,times:long,open:boolean>>"
    return docs.mapInArrow(run, schema)


def _runs(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each different code of a row its first place and how often it occurs, rows in order."""
    order = np.lexsort((code, row))
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), bool), (code[order][1:] != code[order][:-1]) | (row[order][1:] != row[order][:-1]))))
    return order[new], np.diff(np.append(new, len(row)))


_PACKS = "bucket int, uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, keys binary, times binary, x binary, places binary, tail binary"
_SUMS = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
_PARTS = f"{_SUMS}, part long, places binary, scores binary"


def _named(spec: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
    return [(name, kinds[kind]) for name, kind in (c.split() for c in spec.split(", "))]


def _padded(spec: str, columns: dict[str, pa.Array], rows: int) -> pa.RecordBatch:
    """A batch of spec's columns; those that aren't given are null."""
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(rows, kind) for c, kind in _named(spec)], names=[c for c, _ in _named(spec)])


def _probability(value: np.ndarray, every: int, discount: float, n: np.ndarray, a: np.ndarray, rest: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of a bigram by the levels of its count, of its history's count and rest, and of its second token's count."""
    most, share = np.maximum(value[a], 1.0), (value[x] + 1.0) / every
    followed = (np.maximum(np.minimum(value[n], value[a]) - discount, 0.0) + np.minimum(value[rest], value[a]) * share) / most
    return np.minimum(np.where(a > 0, followed, share), 1.0)


def _packs(docs: DataFrame, model, buckets: int, discount: float) -> DataFrame:
    """For each row of docs one row with what the head tokens and the filter tell; and all bigrams that aren't in the filter, packed
    by bucket: of some rows of docs each different key (again, if tokens share it) with how often it occurs, the level of its second token (TAIL:
    not among the head; then the token itself is in `tail`) and where (number of the row from uid, last bit: held out).

    A key is 36 bits of the history and 27 of the bigram, which come first if the history is heavy (marked by the first bit). Its
    bucket follows from what comes first, so that a history that isn't heavy has all its bigrams in one bucket."""

    def pack(uid: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, where, x, token = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(key)
        key, where, token = key[order], where[order], token[order]
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (token[1:] != token[:-1]))))
        ends = np.append(new[1:], len(key))
        u, times, x, token = key[new], (ends - new).astype(np.uint32), x[order[new]], token[new]
        heavy = u >> np.uint64(63) == 1
        bucket = np.where(heavy, ((u >> np.uint64(36)) & np.uint64((1 << 27) - 1)) * np.uint64(buckets) >> np.uint64(27), (u >> np.uint64(27)) * np.uint64(buckets) >> np.uint64(36)).astype(np.int32)
        begin = _begins(bucket * 2 + heavy)
        slices = list(zip(begin, np.append(begin[1:], len(u)), strict=True))
        columns = {
            "bucket": pa.array(bucket[begin]), "uid": pa.array(np.full(len(begin), uid)), "keys": pa.array([_planes(u[i:j]) for i, j in slices], pa.binary()), "times": pa.array([_planes(times[i:j]) for i, j in slices], pa.binary()),
            "x": pa.array([x[i:j].tobytes() for i, j in slices], pa.binary()), "places": pa.array([_planes(where[new[i] : ends[j - 1]]) for i, j in slices], pa.binary()),
            "tail": pa.array([_planes(token[i:j][x[i:j] == TAIL]) for i, j in slices], pa.binary()),
        }
        return _padded(_PACKS, columns, len(begin))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        value, every = count_at(m.every_level), m.tokens + m.distinct + 1
        under = round(np.log2(m.unit) * STEPS_PER_DOUBLING)
        head_level = level_of(m.head_n)
        held: list[tuple[np.ndarray, ...]] = []
        first = rows_held = size = 0
        for batch in batches:
            texts, uid = utf8_rows(batch.column("text")), batch.column("uid").to_numpy()
            held_out = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for i, j in chunked(texts):
                if held and (size > HELD_PLACES or uid[i] != first + rows_held):
                    yield pack(first, held)
                    held, rows_held, size = [], 0, 0
                if not rows_held:
                    first = int(uid[i])
                row, token, pair = grams(texts[i:j])
                rows = j - i
                unique, inverse = np.unique(token, return_inverse=True)
                before = np.concatenate(([np.searchsorted(unique, _STOP)], inverse[:-1]))
                known, at = _among(unique, m.head)
                exact, x = (np.where(known, c[at], none) if len(m.head) else np.full(len(unique), none) for c, none in ((m.head_n, 0), (head_level, TAIL)))
                base = np.where(known, np.log10((exact + 1.0) / every), 0.0)
                heavy, history = _among(unique & np.uint64(_HISTORY), m.heavy)
                near = np.flatnonzero(heavy[before] & known[inverse])
                codes, back = np.unique(pair[near], return_inverse=True)
                q = m.levels(codes)[back]
                done, q = near[q > 0], q[q > 0]
                h = history[before[done]]
                p = _probability(value, every, discount, np.minimum(q + under, m.every_level), m.heavy_level[h], m.heavy_rest[h], x[inverse[done]])
                left = np.ones(len(row), bool)
                left[done] = False
                left = np.flatnonzero(left)
                history_bits, pair_bits = (pair[left] & np.uint64(_HISTORY)) >> np.uint64(1), pair[left] >> np.uint64(37)
                key = np.where(heavy[before[left]], np.uint64(1 << 63) | pair_bits << np.uint64(36) | history_bits, history_bits << np.uint64(27) | pair_bits)
                held.append((key, ((rows_held + row[left]) * 2 + held_out[i:j][row[left]]).astype(np.uint32), x[inverse[left]].astype(np.uint8), token[left]))
                rows_held, size = rows_held + rows, size + len(left)
                columns = {
                    "bucket": pa.array((uid[i:j] % buckets).astype(np.int32)), "uid": pa.array(uid[i:j]), "doc_id": batch.column("doc_id").slice(i, rows), "held_out": pa.array(held_out[i:j]),
                    "n_tokens": pa.array(np.bincount(row, minlength=rows)), "n_known": pa.array(np.bincount(row, known[inverse], rows).astype(np.int64)),
                    "base": pa.array(np.bincount(row, base[inverse], rows)), "score": pa.array(np.bincount(row[done], np.log10(p), rows).astype(np.float64)),
                }
                yield _padded(_PACKS, columns, rows)
        if size:
            yield pack(first, held)

    return docs.mapInArrow(run, _PACKS)


def _settled(packs: DataFrame, model, discount: float, tails: bool) -> DataFrame:
    """Each bucket's bigrams, counted and scored: a task's sums of each uid, packed by 2**GROUP_BITS uids (part), and the rows of docs
    as they are. HELD_SUMS sums are held at most before they are handed on. With tails, only the bigrams whose second token is still to be looked up (uid, token, ctx; 8 bits each: the levels of the count and of its
    history's rest and count; above them how often it occurs)."""

    def settle(m: Model, value: np.ndarray, rows: list[dict], sums: dict[int, np.ndarray]) -> pa.RecordBatch | None:
        of = lambda name, kind: _codes([r[name] for r in rows], kind)
        key, times, x, where = of("keys", np.uint64), of("times", np.uint32), of("x", np.uint8), of("places", np.uint32)
        place = np.repeat(np.arange(len(key)), times)
        u, back = np.unique(key, return_inverse=True)
        n = np.bincount(back[place], where & np.uint32(1) == 0, len(u)).astype(np.int64)
        light = int(np.searchsorted(u, np.uint64(1 << 63)))
        history = u[:light] >> np.uint64(27)
        begin = _begins(history)
        of_history = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, light)))
        all_, followers = (np.add.reduceat(c, begin) if light else c for c in (n[:light], (n[:light] > 0).astype(np.int64)))
        at = np.searchsorted(m.heavy, (u[light:] & np.uint64((1 << 36) - 1)) << np.uint64(1))
        a, rest = np.concatenate((level_of(all_)[of_history], m.heavy_level[at])), np.concatenate((level_of(np.maximum(1.0, discount * followers))[of_history], m.heavy_rest[at]))
        q = level_of(n)
        sizes = np.array([len(r["places"]) // 4 for r in rows])
        if tails:
            some = np.flatnonzero(x[place] == TAIL)
            uid = np.repeat(np.array([r["uid"] for r in rows]), sizes)[some] + (where[some] >> np.uint32(1))
            token = np.zeros(len(key), dtype=np.uint64)
            token[x == TAIL] = of("tail", np.uint64)
            first, runs = _runs(uid, place[some])
            i = back[place[some[first]]]
            return pa.RecordBatch.from_arrays([pa.array(uid[first]), pa.array(token[place[some[first]]].view(np.int64)), pa.array(runs << 24 | q[i] << 16 | rest[i] << 8 | a[i])], names=["uid", "token", "ctx"])
        p = _probability(value, m.tokens + m.distinct + 1, discount, q[back], a[back], rest[back], np.where(x == TAIL, 0, x))
        scores = np.where(x == TAIL, 0.0, np.log10(p))[place]
        for r, j, k in zip(rows, np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True):
            part, have = np.bincount(where[j:k] >> np.uint32(1), scores[j:k]), sums.get(r["uid"], np.zeros(0))
            longer, shorter = (part, have) if len(part) >= len(have) else (have, part)
            longer[: len(shorter)] += shorter
            sums[r["uid"]] = longer
        return None

    def summed(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for first, score in sums.items():
            at = np.flatnonzero(score)
            uid, score = first + at, score[at]
            begin = _begins(uid >> GROUP_BITS)
            slices = list(zip(begin, np.append(begin[1:], len(uid)), strict=True))
            places = (uid & ((1 << GROUP_BITS) - 1)).astype(np.uint8)
            columns = {"part": pa.array(uid[begin] >> GROUP_BITS), "places": pa.array([places[i:j].tobytes() for i, j in slices], pa.binary()), "scores": pa.array([_planes(score[i:j]) for i, j in slices], pa.binary())}
            yield _padded(_PARTS, columns, len(begin))
        sums.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        value = count_at(m.every_level)
        whole: list[pa.RecordBatch] = []
        sums: dict[int, np.ndarray] = {}

        def packed() -> Iterator[dict]:
            for batch in batches:
                packs = pc.is_valid(batch.column("keys"))
                own = batch.filter(pc.invert(packs))
                if len(own) and not tails:
                    columns = {c: own.column(c) for c, _ in _named(_SUMS)}
                    whole.append(_padded(_PARTS, columns | {"part": pa.array(columns["uid"].to_numpy() >> GROUP_BITS)}, len(own)))
                yield from batch.filter(packs).select(["bucket", "uid", "keys", "times", "x", "places", "tail"]).to_pylist()

        for _, rows in groupby(packed(), lambda r: r["bucket"]):
            found = settle(m, value, list(rows), sums)
            if found:
                yield found
            if sum(map(len, sums.values())) > HELD_SUMS:
                yield from summed(sums)
            while whole:
                yield whole.pop()
        yield from whole
        yield from summed(sums)

    return packs.mapInArrow(run, "uid long, token long, ctx long" if tails else _PARTS)


def _joined(parts: DataFrame) -> DataFrame:
    """The rows of docs with the sums of all tasks added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby((r for batch in batches for r in batch.to_pylist()), lambda r: r["part"]):
            score, own = np.zeros(1 << GROUP_BITS), []
            for r in rows:
                if r["places"] is None:
                    own.append(r)
                else:
                    score[np.frombuffer(r["places"], dtype=np.uint8)] += _codes([r["scores"]], np.float64)
            for r in own:
                r["score"] += float(score[r["uid"] & ((1 << GROUP_BITS) - 1)])
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in own], kind) for c, kind in _named(_SUMS)], names=[c for c, _ in _named(_SUMS)])

    return parts.repartition(_partitions(parts), "part").sortWithinPartitions("part").mapInArrow(run, _SUMS)


def _looked_up(tails: DataFrame, model: Model, counts: DataFrame, discount: float) -> DataFrame:
    """The sums of what _settled left open: bigrams whose second token isn't among the head, by a join with its exact count."""
    every = float(model.tokens + model.distinct + 1)
    values = F.lit([float(x) for x in count_at(model.every_level)])
    found = tails.join(counts.select(F.col("gram").alias("token"), "n"), "token", "left").withColumn("x", level(F.coalesce("n", F.lit(0))))
    bits = {c: F.shiftright("ctx", shift).bitwiseAND(F.lit(255)).cast("int") for c, shift in (("q", 16), ("rest", 8), ("a", 0))}
    found = found.select("uid", "n", "x", F.shiftright("ctx", 24).alias("times"), *(x.alias(c) for c, x in bits.items()))
    of = lambda c: F.get(values, F.col(c))
    share = (of("x") + 1) / every
    followed = (F.greatest(F.least(of("q"), of("a")) - discount, F.lit(0.0)) + F.least(of("rest"), of("a")) * share) / F.greatest(of("a"), F.lit(1.0))
    p = F.least(F.when(F.col("a") > 0, followed).otherwise(share), F.lit(1.0))
    known, base = F.when(F.col("n").isNotNull(), F.col("times")), F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / every)
    none = {"doc_id": "long", "held_out": "boolean", "n_tokens": "long"}
    return found.select("uid", *(F.lit(None).cast(k).alias(c) for c, k in none.items()), known.alias("n_known"), base.alias("base"), (F.col("times") * F.log10(p)).alias("score"))


def _scored_whole(rows: DataFrame, model: Model, counts: DataFrame, discount: float) -> DataFrame:
    sent, partitions = rows.sparkSession.sparkContext.broadcast(model), _partitions(rows)
    buckets = partitions * max(1, -(-model.tokens // (partitions * BUCKET_TOKENS)))
    packs = _packs(rows, sent, buckets, discount).repartitionById(partitions, F.col("bucket")).sortWithinPartitions("bucket")
    sums = _joined(_settled(packs, sent, discount, False)).unionAll(_looked_up(_settled(packs, sent, discount, True), model, counts, discount))
    of_row = (F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens"))
    summed = sums.groupBy("uid").agg(*of_row, F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def score(docs: DataFrame, held_out: Column, filter_bits: int = FILTER_BITS, floor: int | None = None, discount: float = DISCOUNT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs(doc_id, text).

    Learns from rows for which held_out is false (null: counts as false). Null and empty texts have one token, the
    end. Repeated rows are learnt and scored each time. Other columns are not read.

    base_score uses exact counts: those of the head tokens are broadcast, those of all others are joined. score is the
    log10 of each token's probability: the discounted share of the bigram among its history's tokens, plus the history's
    rest times the share of the token among all, all counts by their levels. Without a `floor` the model is whole at any size:
    bigrams that aren't in the filter are dealt by history once and take the level of their exact count there, so that a score
    doesn't depend on what the filter holds. With a floor levels come from the filter alone; a token below its unit has no bigram there and
    takes its exact count, and a history without bigrams in the filter has all its mass as rest.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    learnt = rows.where(~F.col("held_out")).select("text")
    if floor is None:
        model, counts = fit_whole(learnt, filter_bits, discount)
        return _scored_whole(rows, model, counts, discount)
    model, counts = fit(learnt, filter_bits, floor, discount)
    zero, none = F.lit(0), F.lit(0.0)
    scored = stored(_scored(rows, spark.sparkContext.broadcast(model), discount), "scored")
    every = float(model.tokens + model.distinct + 1)
    tail = scored.select("uid", F.explode("tail").alias("t")).select("uid", "t.*").join(counts.where("gram % 2 = 0"), "gram", "left")
    part = F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / every)
    tail = tail.groupBy("uid").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("tail_known"), F.sum(part).alias("tail_base"), F.sum(F.when(F.col("open"), part)).alias("tail_score"))
    return scored.drop("tail").join(tail, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", zero)).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("tail_base", none)).alias("base_score"), (F.col("head_score") + F.coalesce("tail_score", none)).alias("score"),
    )
