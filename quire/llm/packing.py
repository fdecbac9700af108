"""Best-fit packing of documents into sequences, with conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import stored

CAPACITY_WORDS = 2048
GROUP_ITEMS = 2048
#: Equal rows that one list holds when they are told apart again.
FAN_OUT = 4096
WORD = r"[^\x20\x09-\x0D]+"


def best_fit(items: list[tuple[int, str | None, int | None]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item (length, source, cluster), placed in the given order.

    Bins are kept in order of what is left in them. The search begins at the least residual that holds the item and
    goes on to its successors until a bin has neither the item's source nor its duplicate cluster in its bitmaps; that
    is the tightest compatible bin. None conflicts with nothing.
    """
    open_bins: list[tuple[int, int]] = []
    sources: list[int] = []
    clusters: list[int] = []
    bits: tuple[dict, dict] = {}, {}

    def bit(kind: int, value) -> int:
        return 0 if value is None else 1 << bits[kind].setdefault(value, len(bits[kind]))

    placed = []
    for length, source, cluster in items:
        s, c = bit(0, source), bit(1, cluster)
        i = bisect_left(open_bins, (length, -1))
        while i < len(open_bins) and (sources[open_bins[i][1]] & s or clusters[open_bins[i][1]] & c):
            i += 1
        if i < len(open_bins):
            left, b = open_bins.pop(i)
        else:
            left, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= s
        clusters[b] |= c
        placed.append((b, capacity - left))
        insort(open_bins, (left - length, b))
    return placed


def pack(docs: DataFrame, capacity: int = CAPACITY_WORDS, length: Column | None = None, cluster: Column | None = None, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(doc_id, part, doc_offset, length, bin_id, bin_offset): every word of docs(doc_id, text, source) in one bin.

    length: words of the text by default; a null or negative one is 0. A longer document is cut in parts of `capacity`,
    the last one shorter. cluster: documents of one cluster never share a bin; by default those with the same words,
    letter case aside. Nor do documents, or parts, of one source. Null sources and clusters conflict with none. Empty and
    null texts are one part of length 0. Repeated rows are packed again, dealt like any others; null ids are kept. Other
    columns are not read.

    Parts are dealt by hash into groups of about group_items, a parameter that doesn't move with the corpus: a bin is
    filled from one group, and each group is packed alone, longest first, the successor search going over all its bins.
    Equal rows are counted before they are dealt, so groups stay small whatever repeats and whatever the source, and only
    lengths and ids are shuffled. Each group's last bins are the price: one in some hundreds.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    length = F.regexp_count(text, F.lit(WORD)) if length is None else length
    cluster = F.xxhash64(F.lower(F.regexp_replace(F.trim(text), r"[\x20\x09-\x0D]+", " "))) if cluster is None else cluster.cast("long")
    words = F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("words"), cluster.alias("cluster"))
    sized = stored(sized.groupBy("doc_id", "source", "words", "cluster").agg(F.count("*").alias("copies")), "lengths")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("words") - 1, F.lit(0)), F.lit(capacity).cast("long"))
    fan = lambda first, last, step: F.explode(F.sequence(first, last, F.lit(step).cast("long")))
    parts = sized.withColumn("from", fan(F.lit(1).cast("long"), F.col("copies"), FAN_OUT)).repartition("doc_id", "from")
    parts = parts.select("doc_id", "source", "cluster", "words", fan(F.col("from"), F.least(F.col("from") + (FAN_OUT - 1), F.col("copies")), 1).alias("copy"))
    parts = parts.select("doc_id", "source", "cluster", "words", "copy", F.posexplode(starts).alias("part", "doc_offset"))
    parts = parts.select("doc_id", "source", "cluster", "copy", "part", "doc_offset", F.least(F.lit(capacity), F.col("words") - F.col("doc_offset")).alias("length"))
    n = sized.select(F.sum(F.greatest(F.lit(1), F.ceil(F.col("words") / capacity)) * F.col("copies"))).first()[0] or 0
    groups = max(1, -(-int(n) // group_items))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), *((c, "ascending") for c in ("doc_id", "part", "cluster", "source", "copy"))])
        placed = best_fit(list(zip(*(group.column(c).to_pylist() for c in ("length", "source", "cluster")), strict=True)), capacity)
        base = group.column("pack")[0].as_py() << 20
        bins = pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())
        return pa.Table.from_arrays([*(group.column(c) for c in ("doc_id", "part", "doc_offset", "length")), *bins], names=["doc_id", "part", "doc_offset", "length", "bin_id", "bin_offset"])

    dealt = parts.withColumn("pack", F.pmod(F.xxhash64("doc_id", "part", "cluster", "copy"), F.lit(groups)))
    return dealt.groupBy("pack").applyInArrow(run, "doc_id long, part int, doc_offset long, length long, bin_id long, bin_offset long")
