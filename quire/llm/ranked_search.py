"""Ranked lexical search: a sharded inverted index with block maxima, searched by Block-Max MaxScore, shard heaps merged."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.shared import bounded_batches, stored, utf8_rows

SHARD_ROWS, SHARD_TERMS, BLOCK = 4096, 1 << 20, 64
QUERY_PAIRS = 1 << 16
#: Documents of a shard are scored in pieces that grow, so that the first ones give a threshold for the rest.
PIECES = (256, 1024)
# Fixed values of the score: weight and impact in 64-bit integers.
SCALE, LENGTH_SHARE, SATURATION = 1_000_000_000, 90, 8

_TERM_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_SCHEMA = pa.schema([("shard", pa.string()), ("term", pa.binary()), ("df", pa.int64()), ("last", _INTS), ("ends", _INTS), ("first", _INTS), ("impact_tf", _LONGS), ("impact_n", _LONGS), ("payload", pa.binary()), ("doc_ids", _LONGS), ("lengths", _LONGS)])
_INDEX = "shard string, term binary, df long, last array<int>, ends array<int>, first array<int>, impact_tf array<long>, impact_n array<long>, payload binary, doc_ids array<long>, lengths array<long>"


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all that isn't ASCII, A-Z in lower case."""
    return text.translate(_TERM_BYTES).split()


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of seven bits each, the high bit set on all but the last byte of a number, and where each number ends."""
    size = np.ones(len(values), dtype=np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        part = ((values[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8)
        out[(ends - size)[has] + k] = part | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    return out, ends


def _read_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    final = np.flatnonzero(raw < 128)
    begin = np.concatenate(([0], final[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(begin, final - begin + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), begin)


def _shard_rows(name: str, doc_ids: list, counts: list[Counter]) -> Iterator[pa.RecordBatch]:
    """The index rows of one shard: one for its documents, and one for each of its terms."""
    order = sorted(range(len(doc_ids)), key=lambda i: (doc_ids[i] is None, doc_ids[i] or 0))
    ids: dict[bytes, int] = {}
    term, doc, tf = [], [], []
    for at, i in enumerate(order):
        c = counts[i]
        term.extend([ids.setdefault(t, len(ids)) for t in c])
        tf.extend(c.values())
        doc.extend([at] * len(c))
    lengths = np.array([sum(counts[i].values()) for i in order], dtype=np.int64)
    term, doc, tf = (np.array(x, dtype=np.int64) for x in (term, doc, tf))
    by = np.argsort(term, kind="stable")  # documents of a term stay ascending
    term, doc, tf = term[by], doc[by], tf[by]
    rank = np.arange(len(term)) - np.searchsorted(term, term)
    opens = rank % BLOCK == 0
    block = np.cumsum(opens) - 1
    delta = doc - np.where(opens, 0, np.concatenate(([0], doc[:-1])))
    data, ends = _varints(np.stack([delta, tf], axis=1).reshape(-1).astype(np.uint64))
    begins = np.flatnonzero(opens)
    closes = np.concatenate((begins[1:], [len(term)])) - 1 if len(term) else begins
    # of each block the pairs (tf, length) that no other one of it equals or exceeds in both: whatever the collection's
    # size will be, one of these has the block's highest impact
    n = lengths[doc]
    best = np.lexsort((n, -tf, block))
    reach = n[best] - block[best] * (1 << 40)
    low = np.minimum.accumulate(reach) if len(reach) else reach
    best = best[np.concatenate(([True], reach[1:] < low[:-1]))] if len(best) else best
    impact_at = np.searchsorted(block[best], np.arange(len(begins) + 1))
    list_at = np.searchsorted(term[begins], np.arange(len(ids) + 1))  # blocks of a list
    byte_ends = ends[1::2]
    first_byte = np.concatenate(([0], byte_ends))
    own_list = np.repeat(np.arange(len(ids)), np.diff(list_at))
    start = first_byte[begins[list_at[:-1]]] if ids else np.zeros(0, dtype=np.int64)
    impacts = impact_at[list_at]

    def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

    payload = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.append(start, len(data)).astype(np.int32)), pa.py_buffer(data)])
    terms = {
        "shard": pa.array([name] * len(ids), pa.string()), "term": pa.array(list(ids), pa.binary()), "df": pa.array(np.bincount(term, minlength=len(ids)), pa.int64()),
        "last": lists(doc[closes], list_at, pa.int32()), "ends": lists(byte_ends[closes] - start[own_list], list_at, pa.int32()), "first": lists(impact_at[:-1] - impacts[:-1][own_list], list_at, pa.int32()),
        "impact_tf": lists(tf[best], impacts, pa.int64()), "impact_n": lists(n[best], impacts, pa.int64()), "payload": payload,
    }
    documents = {"shard": pa.array([name]), "df": pa.array([int(np.count_nonzero(lengths))], pa.int64()), "doc_ids": pa.array([[doc_ids[i] for i in order]], _LONGS), "lengths": pa.array([lengths.tolist()], _LONGS)}
    for columns, rows in ((documents, 1), (terms, len(ids))):
        yield pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in _SCHEMA], schema=_SCHEMA)


def build_index(docs: DataFrame) -> DataFrame:
    """The index of docs(doc_id, text), written once: for each shard a row with its documents (term null), and a row for each
    of its terms. A shard is what one task has read, at most SHARD_ROWS rows, and cut once they have SHARD_TERMS terms; so
    nothing is shuffled, and a row is as large as a shard at most. Documents are numbered within a shard by ascending doc_id
    (nulls last). The postings of a term are gaps of these numbers and counts, as varints in blocks of BLOCK; of each block
    there is the last number, where its bytes end, and its impacts. Null texts have no terms and are never found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, ids, counts, held = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8_rows(batch.column("text")), strict=True):
                ids.append(doc_id)
                counts.append(Counter(terms_of(text)))
                held += len(counts[-1])
                if len(ids) == SHARD_ROWS or held >= SHARD_TERMS:
                    yield from _shard_rows(f"{task}-{made}", ids, counts)
                    made, ids, counts, held = made + 1, [], [], 0
        if ids:
            yield from _shard_rows(f"{task}-{made}", ids, counts)

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(run, _INDEX), "search-index")


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of items(item_id, text): each different term once."""

    def run(terms: pa.Array) -> pa.Array:
        return pa.array([sorted(set(terms_of(t))) for t in utf8_rows(terms)], pa.list_(pa.binary()))

    return items.select("item_id", F.explode(F.arrow_udf(run, "array<binary>")(F.col("text").cast("string"))).alias("term")).distinct()


class _List:
    """The postings of a term in a shard; blocks are decoded when a candidate needs them."""

    def __init__(self, row: dict, weight: int, spread):
        self.row, self.weight, self.decoded = row, weight, {}
        self.last = np.array(row["last"], dtype=np.int64)
        impacts = _impact(np.array(row["impact_tf"], dtype=np.int64), spread(np.array(row["impact_n"], dtype=np.int64)))
        self.block_max = weight * np.maximum.reduceat(impacts, np.array(row["first"], dtype=np.int64))
        self.bound = int(self.block_max.max())

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        if b not in self.decoded:
            ends = self.row["ends"]
            pairs = _read_varints(self.row["payload"][ends[b - 1] if b else 0 : ends[b]]).reshape(-1, 2)
            self.decoded[b] = np.cumsum(pairs[:, 0]), pairs[:, 1]
        return self.decoded[b]

    def between(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a range and their counts."""
        a, b = np.searchsorted(self.last, begin), np.searchsorted(self.last, end)
        parts = [self.block(i) for i in range(int(a), min(int(b) + 1, len(self.last)))]
        if not parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        doc, tf = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        keep = (doc >= begin) & (doc < end)
        return doc[keep], tf[keep]


def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (SCALE * tf) // (1000 * tf + SATURATION * m)


def search_shard(lists: list[_List], spread: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of a shard, as numbers and scores, by Block-Max MaxScore.

    Lists are ordered by their bounds; those whose bounds together don't exceed the threshold, the k-th best score so far,
    are not essential: only documents of the others are candidates. A candidate goes once what it has, the maximum of the
    block where the next list may hold it, and the bounds of the lists below don't exceed the threshold; blocks where no
    candidate is left aren't decoded. Later documents of a shard have higher ids, so an equal score doesn't exceed it.
    """
    lists = sorted(lists, key=lambda x: x.bound)
    below = np.cumsum([x.bound for x in lists])
    top, top_score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    edges = [0, *(e for e in PIECES if e < len(spread)), len(spread)]
    for begin, end in zip(edges[:-1], edges[1:], strict=True):
        threshold = int(top_score[-1]) if len(top) == k else 0
        essential = int(np.searchsorted(below, threshold, side="right"))
        score = np.zeros(end - begin, dtype=np.int64)
        for x in lists[essential:]:
            doc, tf = x.between(begin, end)
            score[doc - begin] += x.weight * _impact(tf, spread[doc])
        found = np.flatnonzero(score)
        score = score[found]
        for i in range(essential - 1, -1, -1):
            x, rest = lists[i], int(below[i - 1]) if i else 0
            may = score + rest + x.bound > threshold
            found, score = found[may], score[may]
            if not len(found):
                break
            b = np.searchsorted(x.last, found + begin)
            held = b < len(x.last)
            most = np.where(held, x.block_max[np.minimum(b, len(x.last) - 1)], 0)
            may = score + rest + most > threshold
            found, score, b, held = found[may], score[may], b[may], held[may]
            for which in np.unique(b[held]).tolist():
                doc, tf = x.block(which)
                mine = np.flatnonzero(b == which)
                at = np.minimum(np.searchsorted(doc, found[mine] + begin), len(doc) - 1)
                hit = doc[at] == found[mine] + begin
                score[mine[hit]] += x.weight * _impact(tf[at[hit]], spread[doc[at[hit]]])
        top, top_score = np.concatenate((top, found + begin)), np.concatenate((top_score, score))
        best = np.lexsort((top, -top_score))[:k]
        top, top_score = top[best], top_score[best]
    return top[top_score > 0], top_score[top_score > 0]


def _weight(n: Column, df: Column) -> Column:
    return F.floor(1000 * F.log((2 * n + 2) / (2 * df + 1))).cast("long")


def search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of an index for each of items(item_id, text), scores
    above 0 only, equal scores by ascending doc_id (null last).

    N, the documents with a term, L, all terms, and the df of the terms are sums over shards. Items are dealt into blocks of
    about QUERY_PAIRS pairs of an item and a term; a block's pairs are broadcast, and each shard's lists of these terms meet
    in one group, whose size the shard bounds. A shard gives k documents an item at most; the heaps of all shards are merged
    by rank. Equal items are searched each; items without text or known terms have no rows; rows with the same item_id are
    one item with the terms of all.
    """
    spark = index.sparkSession
    sums = index.where("term is null").agg(F.sum("df").alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("all")).first()
    n, every = sums["n"] or 0, sums["all"] or 0
    wanted = stored(query_terms(items), "search-terms")
    df = index.where("term is not null").select("term", "df").join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = stored(wanted.join(df.select("term", _weight(F.lit(n), F.col("df")).alias("weight")), "term").where("weight > 0"), "search-weights")
    blocks = -(-weighed.count() // QUERY_PAIRS)
    dealt = weighed.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks))))
    kind = items.schema["item_id"].dataType.simpleString()
    found = []
    for block in range(blocks):
        pairs = dealt.where(F.col("block") == block)
        heaps = _search_block(index, pairs.select("item_id", "term", "weight"), n, every, k, kind)
        found.append(heaps)
    heaps = spark.createDataFrame([], f"item_id {kind}, doc_id long, score long") if not found else found[0]
    for more in found[1:]:
        heaps = heaps.unionAll(more)
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return heaps.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_block(index: DataFrame, pairs: DataFrame, n: int, every: int, k: int, kind: str) -> DataFrame:
    items: dict = {}
    for item_id, term, weight in zip(*(pairs.toArrow().column(c).to_pylist() for c in ("item_id", "term", "weight")), strict=True):
        items.setdefault(item_id, {})[term] = weight
    shared = index.sparkSession.sparkContext.broadcast(items)

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        own = next(r for r in rows if r["term"] is None)
        lengths = np.array(own["lengths"], dtype=np.int64)
        spread = lambda length: 100 - LENGTH_SHARE + (LENGTH_SHARE * length * n) // every
        lists = {r["term"]: r for r in rows if r["term"] is not None}
        ready: dict[bytes, _List] = {}
        out = {"item_id": [], "doc_id": [], "score": []}
        m = spread(lengths)
        for item_id, weights in shared.value.items():
            mine = []
            for term, weight in weights.items():
                if term in lists:
                    if term not in ready:
                        ready[term] = _List(lists[term], weight, spread)
                    mine.append(ready[term])
            if mine:
                doc, score = search_shard(mine, m, k)
                out["item_id"] += [item_id] * len(doc)
                out["doc_id"] += [own["doc_ids"][i] for i in doc.tolist()]
                out["score"] += score.tolist()
        return pa.table({"item_id": pa.array(out["item_id"], id_type), "doc_id": pa.array(out["doc_id"], pa.int64()), "score": pa.array(out["score"], pa.int64())})

    id_type = pairs.limit(0).select("item_id").toArrow().schema.field("item_id").type
    terms = pairs.select("term").distinct()
    lists = index.where("term is not null").join(terms, "term", "left_semi").select(*index.columns).unionAll(index.where("term is null"))
    return lists.groupBy("shard").applyInArrow(run, f"item_id {kind}, doc_id long, score long")
