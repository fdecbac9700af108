"""Substring deduplication: windows of words that an earlier document holds too, by super-k-mer partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import Words, bounded_batches, chunked, has_bits, mix64, set_bits, stored, utf8_rows

WINDOW_WORDS, MINIMISER_WORDS = 13, 5
FILTER_BITS = 27
HOT_KEYS, SALT_ROWS, SLICE_ROWS = 100_000, 1024, 1 << 16
LONGEST_RUN = 64


def super_kmers(words: Words, window: int, minimiser: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of one text that share a minimiser: first word, number of windows, minimiser."""
    n = len(words.begin) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.full(len(words.begin), np.iinfo(np.uint64).max, dtype=np.uint64)
    h, at = words.hashes(minimiser)
    grams[at] = h
    least = grams[:n].copy()
    for i in range(1, window - minimiser + 1):
        np.minimum(least, grams[i : n + i], out=least)
    whole = words.row[:n] == words.row[window - 1 :]
    begins = whole.copy()
    begins[1:] &= ~whole[:-1] | (least[1:] != least[:-1])
    run = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    begins |= whole & ((np.arange(n) - run) % LONGEST_RUN == 0)
    first = np.flatnonzero(begins)
    ends = begins | ~whole
    stop = np.flatnonzero(ends)
    after = np.searchsorted(stop, first, side="right")
    last = np.where(after < len(stop), stop[np.minimum(after, len(stop) - 1)], n)
    return first, last - first, least[first]


def _texts(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).where("doc_id is not null")


def _minimisers(docs: DataFrame, window: int, minimiser: int) -> DataFrame:
    """(minimiser, n): those of super-k-mers in two documents at least, with the number of super-k-mers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = utf8_rows(batch.column("text")), batch.column("doc_id").to_numpy()
            for i, j in chunked(texts):
                words = Words(texts[i:j])
                first, _, key = super_kmers(words, window, minimiser)
                doc = ids[i:j][words.row[first]]
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
                n = np.diff(np.concatenate((at, [len(key)])))
                yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(doc[at]), pa.array(doc[at + n - 1]), pa.array(n)], names=["minimiser", "lo", "hi", "n"])

    found = _texts(docs).select("doc_id", "text").mapInArrow(run, "minimiser long, lo long, hi long, n long")
    return found.groupBy("minimiser").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).where("lo < hi").select("minimiser", "n")


def _packed(docs: DataFrame, bits, hot, window: int, minimiser: int) -> DataFrame:
    """(key, salt, doc_id, text_key, first, packed): the super-k-mers whose minimiser may be repeated, words joined by
    spaces. Salt 0: the bucket is whole. Those of a hot minimiser are dealt by document over salts from 1 up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, hot_salts = hot.value
        for batch in batches:
            texts, ids, texts_key = utf8_rows(batch.column("text")), batch.column("doc_id").to_numpy(), batch.column("text_key").to_numpy()
            for i, j in chunked(texts):
                words = Words(texts[i:j])
                first, n, key = super_kmers(words, window, minimiser)
                kept = has_bits(bits.value, key >> np.uint64(64 - FILTER_BITS))
                first, n, key = first[kept], n[kept], key[kept]
                row = words.row[first]
                doc = ids[i:j][row]
                salt = np.zeros(len(key), dtype=np.int32)
                if len(hot_keys):
                    at = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
                    salt = np.where(hot_keys[at] == key, 1 + mix64(doc.astype(np.uint64)) % hot_salts[at], 0).astype(np.int32)
                packed = [words.buffer[x:y] for x, y in zip(words.begin[first].tolist(), words.end[first + n + window - 2].tolist(), strict=True)]
                columns = [key.view(np.int64), salt, doc, texts_key[i:j][row], first - words.bounds[row]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(packed, pa.binary())], names=["key", "salt", "doc_id", "text_key", "first", "packed"])

    return _texts(docs).mapInArrow(run, "key long, salt int, doc_id long, text_key long, first long, packed binary")


class _Windows:
    """The windows of a table of packed super-k-mers, sorted, with the least document of each."""

    def __init__(self, part: pa.Table, window: int):
        self.doc, self.text_key, self.first = (part.column(c).to_numpy() for c in ("doc_id", "text_key", "first"))
        self.more = part.column("more").to_numpy() if "more" in part.column_names else np.zeros(len(part), np.int64)  # words that a row covers beyond its window
        self.words = words = Words(part.column("packed").to_pylist())
        h, at = words.hashes(window)
        order = np.lexsort((self.doc[words.row[at]], h))
        h, at = h[order], at[order]
        self.row, self.at = words.row[at], at
        self.begin, self.end = words.begin[at], words.end[at + window - 1]
        opens = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        self.head = np.maximum.accumulate(np.where(opens, np.arange(len(h)), 0))  # the run's window of least document
        self._settle()

    def text(self, i: int) -> bytes:
        return self.words.buffer[self.begin[i] : self.end[i]]

    def _settle(self) -> None:
        """Compare each window with its head word for word; other words under one hash get a head of their own."""
        rest = np.flatnonzero(self.head != np.arange(len(self.head)))
        same = np.fromiter((self.text(i) == self.text(k) for i, k in zip(rest.tolist(), self.head[rest].tolist(), strict=True)), bool, len(rest))
        for k in np.unique(self.head[rest[~same]]).tolist():
            heads: dict[bytes, int] = {}
            for i in np.flatnonzero(self.head == k).tolist():
                self.head[i] = heads.setdefault(self.text(i), i)

    def ranges(self, window: int) -> list[np.ndarray]:
        """doc_id, text_key, begin and end of the words that windows of an earlier document cover."""
        late = np.flatnonzero(self.doc[self.row] > self.doc[self.row[self.head]])
        row, at = self.row[late], self.at[late]
        order = np.lexsort((at, row))
        row, at = row[order], at[order]
        opens = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)))) if len(row) else np.zeros(0, np.int64)
        last = np.concatenate((opens[1:], [len(row)])) - 1 if len(row) else opens
        begin = self.first[row[opens]] + at[opens] - self.words.bounds[row[opens]]
        return [self.doc[row[opens]], self.text_key[row[opens]], begin, begin + (at[last] - at[opens]) + window + self.more[row[opens]]]

    def heads(self, of_row: np.ndarray, window: int) -> tuple[list[np.ndarray], list[bytes]]:
        """The same of every place of a window in its least document, in the rows chosen by of_row, and the window's words.
        Places that overlap or touch are one range."""
        own = np.flatnonzero((self.doc[self.row] == self.doc[self.row[self.head]]) & of_row[self.row])
        begin = self.first[self.row[own]] + self.at[own] - self.words.bounds[self.row[own]]
        order = np.lexsort((begin, self.text_key[self.row[own]], self.head[own]))
        own, begin = own[order], begin[order]
        head, text_key = self.head[own], self.text_key[self.row[own]]
        opens = np.flatnonzero(np.concatenate(([True], (head[1:] != head[:-1]) | (text_key[1:] != text_key[:-1]) | (begin[1:] > begin[:-1] + window)))) if len(own) else np.zeros(0, np.int64)
        last = np.concatenate((opens[1:], [len(own)])) - 1 if len(own) else opens
        return [self.doc[self.row[own[opens]]], text_key[opens], begin[opens], begin[last] + window], [self.text(i) for i in own[opens].tolist()]

    def first_rows(self) -> np.ndarray:
        """A row of the least document of each window."""
        return np.unique(self.row[self.head == np.arange(len(self.head))])


def _by_bucket(packed: DataFrame, keys: list[str], window: int, open_end: bool) -> DataFrame:
    """(doc_id, text_key, begin, end, packed): the ranges covered by windows that are repeated within a bucket, packed
    null. If open_end, also all places of each window in the least document of the buckets that are only a part of their
    minimiser's: salted ones, and slices of a bucket longer than SLICE_ROWS, which bound the memory. Else a bucket is
    sorted by document and has the rows of few windows; its slices hand on a row of each window's least document."""
    names = ["doc_id", "text_key", "begin", "end", "packed"]

    def found(part: pa.Table, cut: bool) -> Iterator[pa.RecordBatch]:
        windows = _Windows(part, window)
        columns = windows.ranges(window)
        yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in columns), pa.nulls(len(columns[0]), pa.binary())], names=names)
        if open_end:
            partial = np.full(len(part), cut) | (part.column("salt").to_numpy() > 0)
            columns, texts = windows.heads(partial, window)
            yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in columns), pa.array(texts, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cut = None, False
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = pa.concat_tables([held, part]) if held is not None else part
            if not len(part):
                continue
            key = np.stack([part.column(c).to_numpy() for c in keys])
            changes = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            whole = int(changes[-1]) if len(changes) else 0  # the last bucket may go on
            if whole:
                yield from found(part.slice(0, whole), cut)
                cut = False
            held = part.slice(whole)
            if len(held) > SLICE_ROWS:
                yield from found(held, True)
                held, cut = None if open_end else held.take(_Windows(held, window).first_rows()), True
        if held is not None and len(held):
            yield from found(held, cut)

    dealt = packed.repartition(*keys).sortWithinPartitions(*keys, *([] if open_end else ["doc_id"]))
    return dealt.mapInArrow(run, "doc_id long, text_key long, begin long, end long, packed binary")


def repeated_ranges(docs: DataFrame, window: int = WINDOW_WORDS, minimiser: int = MINIMISER_WORDS) -> DataFrame:
    """(doc_id, text_key, begin, end): word ranges covered by windows that start in a document of smaller doc_id too.

    A window is repeated only if its minimiser, a run of `minimiser` words, is found in two documents. A first scan
    counts the minimisers of all super-k-mers and sets the bits of the repeated ones in a filter of fixed size
    (2**FILTER_BITS bits; a bit set by another minimiser lets more rows through, never fewer). A second scan sends the
    super-k-mers that pass to the bucket of their minimiser, where their windows are sorted and compared word for
    word.

    A minimiser with many super-k-mers (over SALT_ROWS, and over 1/HOT_KEYS of all, so that such keys are a bounded
    list) is dealt over salts by document. What later documents of a salt repeat is settled there; all places of a window
    in the salt's least document go on, keyed by the window's words, to a second round.
    """
    spark = docs.sparkSession
    counted = stored(_minimisers(docs, window, minimiser), "minimisers")
    rows = max(SALT_ROWS, (counted.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    hot = np.array([(r[0], -(-r[1] // rows)) for r in counted.where(F.col("n") > rows).collect()], dtype=np.int64).reshape(-1, 2)
    keys = hot[:, 0].view(np.uint64) if len(hot) else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    hot = spark.sparkContext.broadcast((keys[order], hot[order, 1].astype(np.uint64)))
    positions = counted.select(F.shiftrightunsigned("minimiser", 64 - FILTER_BITS).alias("position"))
    bits = spark.sparkContext.broadcast(set_bits(positions, 1 << FILTER_BITS))
    first = stored(_by_bucket(_packed(docs, bits, hot, window, minimiser), ["key", "salt"], window, True), "repeats")
    ranges = ["doc_id", "text_key", "begin", "end"]
    again = first.where("packed is not null").select(F.xxhash64("packed").alias("key"), "doc_id", "text_key", F.col("begin").alias("first"), (F.col("end") - F.col("begin") - window).alias("more"), "packed")
    return first.where("packed is null").select(*ranges).unionAll(_by_bucket(again, ["key"], window, False).select(*ranges))


def _cut(text: pa.Array, begins: pa.Array, ends: pa.Array) -> pa.Array:
    kept, n_words, n_removed = [], [], []
    for t, b, e in zip(utf8_rows(text), begins.to_pylist(), ends.to_pylist(), strict=True):
        words = t.split()
        n = len(words)
        if b:
            change = np.zeros(n + 1, dtype=np.int64)
            np.add.at(change, b, 1)
            np.add.at(change, e, -1)
            covered = np.cumsum(change[:-1]) > 0
            words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
        kept.append(b" ".join(words))
        n_words.append(n)
        n_removed.append(n - len(words))
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["kept_text", "n_words", "n_removed"])


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS, minimiser: int = MINIMISER_WORDS) -> DataFrame:
    """docs plus kept_text, n_words and n_removed: each word covered by a repeated window is taken out.

    Needs doc_id and text; all other columns pass through (columns of the three names are replaced). Null text: no
    words. Rows with a null doc_id keep all words and mark none. Of rows with equal doc_id none counts as smaller.
    kept_text joins the kept words by one space. Texts with fewer words than a window stay as they are.
    """
    ranges = repeated_ranges(docs, window, minimiser).select("doc_id", "text_key", "begin", "end").distinct()  # copies of a row have the same
    found = ranges.groupBy("doc_id", "text_key").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [c for c in docs.columns if c not in ("kept_text", "n_words", "n_removed")]
    rows = docs.select(F.struct(*kept).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"))
    cut = F.arrow_udf(_cut, "struct<kept_text:string,n_words:long,n_removed:long>")(F.col("row.text").cast("string"), F.col("begins"), F.col("ends"))
    return rows.join(found, ["doc_id", "text_key"], "left").select("row", cut.alias("cut")).select("row.*", "cut.*")
