"""Document fingerprints: bottom-k sketches of shingle hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import Substrings, bounded_batches, chunked, mix64, utf8_rows

SHINGLE_CHARS, K, HASH_BITS = 8, 128, 48
BUCKET_ROWS, MOST_BUCKETS = 1024, 1 << 16
HELD_KEYS = 1 << 14
_FIRST_ID = -(1 << 63)


def sketch_texts(texts: list[str], shingle: int = SHINGLE_CHARS, k: int = K) -> list[np.ndarray]:
    """The k least distinct hashes of each text's shingles of code points, ascending; a shorter text is one shingle,
    an empty one has none."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sums = Substrings(mix64(codes.astype(np.uint64) + np.uint64(1)) | np.uint64(1))
    out, at = [], 0
    for text in texts:
        n = len(text)
        begin = np.arange(at, at + max(n - shingle + 1, min(n, 1)))
        h = sums.hash(begin, np.minimum(begin + shingle, at + n)) >> np.uint64(64 - HASH_BITS)
        low = h
        if len(h) > 16 * k:  # most often the least hashes are enough to find k distinct ones
            low = np.unique(h[h < np.uint64((1 << HASH_BITS) // len(h) * 4 * k)])
        out.append((low if len(h) > 16 * k and len(low) >= k else np.unique(h))[:k])
        at += n
    return out


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the union's distinct shingles that both texts have. Two empty texts: 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate((a, b)))
    twice = both[1:] == both[:-1]
    union = both[np.concatenate(([True], ~twice))][:k]
    return float(np.count_nonzero(both[1:][twice] <= union[-1])) / len(union)


def distinct_estimate(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles: exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * float(1 << HASH_BITS) / float(a[k - 1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's distinct shingles that b has (a empty: 1)."""
    return min(1.0, resemblance(a, b, k) * distinct_estimate(merged(a, b, k), k) / distinct_estimate(a, k)) if len(a) else 1.0


def to_string(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex() if HASH_BITS == 64 else "".join(f"{x:0{HASH_BITS // 4}x}" for x in sketch.tolist())


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def sketch_parts(parts: DataFrame, keys: list[str], shingle: int = SHINGLE_CHARS, k: int = K) -> DataFrame:
    """(keys..., sketch array<long>) of the union of the parts' shingles, merged by key.

    Each row's text is sketched alone, then sketches of one key are merged: the k least of the union are those of the
    whole. A task merges the parts of a key that it reads (of HELD_KEYS keys at a time), then what the tasks have is
    merged in two levels, so that a key with a third of all parts is never gathered whole. Shingles that cross from part
    to part are not seen, so parts should overlap by shingle - 1 characters. Null texts are empty; null keys are a key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        task = TaskContext.get().partitionId() % 64

        def flush() -> pa.RecordBatch:
            columns = [pa.array([key[c] for key in held], batch.schema.field(c).type) for c in range(len(keys))]
            lists = pa.array([s.astype(np.int64) for s in held.values()], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([*columns, pa.array([task] * len(held), pa.int32()), lists], names=[*keys, "_task", "h"])

        for batch in batches:
            texts = [t.decode() for t in utf8_rows(batch.column(len(keys)))]
            rows = list(zip(*(batch.column(c).to_pylist() for c in range(len(keys))), strict=True))
            for i, j in chunked([t.encode() for t in texts]):
                for key, sketch in zip(rows[i:j], sketch_texts(texts[i:j], shingle, k), strict=True):
                    held[key] = merged(held[key], sketch, k) if key in held else sketch
                if len(held) >= HELD_KEYS:
                    yield flush()
                    held = {}
        if held:
            yield flush()

    bounded_batches(parts.sparkSession)
    rows = parts.select(*keys, F.col("text").cast("string").alias("_text"))
    types = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes[:-1])
    hashes = rows.mapInArrow(run, f"{types}, _task int, h array<long>").select(*keys, "_task", F.explode_outer("h").alias("h"))
    for by in ([*keys, "_task"], keys):
        merged_once = hashes.groupBy(*by).agg(F.slice(F.array_sort(F.collect_set("h")), 1, k).alias("sketch"))
        hashes = merged_once.select(*by, F.explode_outer("sketch").alias("h"))
    return merged_once


def _below(a: Column, b: Column, k: int) -> Column:
    return F.slice(F.array_sort(F.array_distinct(F.concat(a, b))), 1, k)


def resemblance_of(a: Column, b: Column, k: int = K) -> Column:
    """Resemblance of two sketch columns; of two empty ones 1."""
    union = _below(a, b, k)
    return F.when(F.size(union) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(1 << HASH_BITS) / F.element_at(a, k))


def containment_of(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has (a empty: 1)."""
    shared = resemblance_of(a, b, k) * distinct_count(_below(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def with_next_row(docs: DataFrame) -> DataFrame:
    """(bucket, extra, doc_id, text): rows dealt by ranges of doc_id, sorted descending, each range followed by a copy
    of the row that comes after it (extra). After the last row comes the first.

    The ranges end at approximate quantiles of the ids, one for BUCKET_ROWS rows. There are at most MOST_BUCKETS, so ends
    and heads are a bounded list; then a range has more rows (of 100 TB, 1.5 GB). A range is streamed, not held. Equal ids are ordered by text; null ids come last.
    """
    bounded_batches(docs.sparkSession)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST_ID))
    docs = docs.select(order.alias("at"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = docs.count()
    n = min(MOST_BUCKETS, max(1, rows // BUCKET_ROWS))
    ends = docs.agg(F.percentile_approx("at", [i / n for i in range(1, n)] or [1.0], 20 * n)).first()[0] if rows else []
    ends = np.unique(np.array(ends if n > 1 else [], dtype=np.int64))

    bucket = F.arrow_udf(lambda at: pa.array(np.searchsorted(ends, at.to_numpy(), side="right").astype(np.int32)), "int")(F.col("at"))
    heads = sorted((r[0], r[1]) for r in docs.select(bucket.alias("bucket"), "at").groupBy("bucket").agg(F.max("at")).collect())
    before = [(head, heads[(i + 1) % len(heads)][0]) for i, (_, head) in enumerate(heads)]
    heads = docs.sparkSession.createDataFrame(before, "head long, follows int")
    dealt = docs.withColumn("own", bucket).join(F.broadcast(heads), F.col("at") == F.col("head"), "left")
    places = F.filter(F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("extra")), F.struct(F.col("follows").alias("bucket"), F.lit(True).alias("extra"))), lambda x: x["bucket"].isNotNull())
    dealt = dealt.select(F.explode(places).alias("place"), "at", "doc_id", "text").select("place.*", "at", "doc_id", "text")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "extra", F.desc("at"), "text").drop("at")


def edited_likeness(docs: DataFrame, shingle: int = SHINGLE_CHARS, k: int = K) -> DataFrame:
    """One row per row of docs(doc_id, text): its fingerprint, that of its edited text and their likeness; how many distinct
    shingles the text has, and what share of the edited text's it holds, by estimates of the fingerprints.

    The edited text keeps the first half and takes the rest from the next document in descending order of doc_id. Null
    texts are empty; an empty text has an empty fingerprint, like only to another. Of one row alone the next is itself.
    Repeated rows give repeated results. Other columns are not read.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "distinct_shingles", "edited_contained"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            columns = [batch.column(c).to_pylist() for c in ("bucket", "extra", "doc_id")]
            for i, j in chunked(texts):
                part = [t.decode() for t in texts[i:j]]
                rows = held + list(zip(*(c[i:j] for c in columns), part, sketch_texts(part, shingle, k), strict=True))
                pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and not a[1]]
                held = rows[-1:]
                edited = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs]
                found = [
                    (a[2], len(a[3]), hashlib.sha256(e.encode()).hexdigest(), to_string(a[4]), to_string(s), resemblance(a[4], s, k), resemblance(a[4], b[4], k), distinct_estimate(a[4], k), containment(s, a[4], k))
                    for (a, b), e, s in zip(pairs, edited, sketch_texts(edited, shingle, k), strict=True)
                ]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double, edited_contained double"
    return with_next_row(docs).mapInArrow(run, schema)
