"""Boxes on pages: validity, reading order, lines, words, regions, clusters and groups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators.ranges import overlap_join
from quire.sources.incremental import stored_checkpoint

SIDES = ("x0", "y0", "x1", "y1")


def clean_boxes(boxes: DataFrame, top: int = 1000) -> DataFrame:
    """PRJ-06: boxes clamped to 0..top and confidence to 0..1; a box without area becomes empty. reason says which."""
    clamp = {c: F.greatest(F.lit(0), F.least(F.lit(top), F.col(c))) for c in SIDES}
    bad = (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0"))
    outside = F.col("x0").isNull() | (F.least(*SIDES) < 0) | (F.greatest(*SIDES) > top)
    rows = boxes.withColumns(clamp | {"_out": outside, "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))})
    reason = F.when(bad, "invalid").when(F.col("_out"), "clamped").otherwise("ok")
    rows = rows.withColumn("reason", reason).drop("_out")
    return rows.withColumns({c: F.when(F.col("reason") != "invalid", F.col(c)) for c in SIDES})


def bbox_union(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """AG-16: the box around all boxes of each key, and their number."""
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))


def lattice_filter(strokes: DataFrame, least: int, length: str = "length") -> DataFrame:
    """AG-17: strokes without those of a rounded length, or one off it, that `least` strokes or more have."""
    common = strokes.groupBy(F.round(length).cast("long").alias("_len")).count().where(F.col("count") >= least)
    common = common.select(F.explode(F.array(F.col("_len") - 1, F.col("_len"), F.col("_len") + 1)).alias("_len")).distinct()
    return strokes.withColumn("_len", F.round(length).cast("long")).join(common, "_len", "left_anti").drop("_len")


def robust_filter(boxes: DataFrame, key: str = "page") -> DataFrame:
    """AG-29: boxes whose height is 0.45 to 5 times the page's median and whose width is 1.2 times their height or more."""
    height = F.col("y1") - F.col("y0")
    median = boxes.groupBy(key).agg(F.percentile(height, 0.5).alias("_m"))
    kept = boxes.join(median, key).where((height >= 0.45 * F.col("_m")) & (height <= 5 * F.col("_m")) & (F.col("x1") - F.col("x0") >= 1.2 * height))
    return kept.drop("_m")


def alignment_edge(boxes: DataFrame, key: str = "page", share: float = 0.8) -> DataFrame:
    """AG-29: (key, edge): the 80th percentile of the right edges of the lines at least as long as the page's mean."""
    width = F.col("x1") - F.col("x0")
    mean = boxes.groupBy(key).agg(F.avg(width).alias("_w"))
    return boxes.join(mean, key).where(width >= F.col("_w")).groupBy(key).agg(F.round(F.percentile("x1", share), 6).alias("edge"))


def reading_order(boxes: DataFrame, key: str = "page", band: int = 40) -> DataFrame:
    """ST-01: boxes plus place: by bands of height, right to left in a band."""
    return boxes.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.round(F.col("y0") / band), F.desc("x0"), "box_id")))


def top1(rows: DataFrame, key: str, score: str, then: str) -> DataFrame:
    """ST-02: the row of the highest score of each key; a tie goes to the least `then`."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), then))).where("_n = 1").drop("_n")


def _line_numbers(centres: pa.Array, tolerance: pa.Array) -> pa.Array:
    """Of each ascending list of centres the line that each falls in: that of the one before if its mean is in reach."""
    out = []
    for row, reach in zip(centres.to_pylist(), tolerance.to_pylist(), strict=True):
        lines, mean, n = [], 0.0, 0
        for c in row:
            if n and abs(mean - c) <= reach:
                mean, n = (mean * n + c) / (n + 1), n + 1
                lines.append(lines[-1])
            else:
                mean, n = c, 1
                lines.append(lines[-1] + 1 if lines else 1)
        out.append(lines)
    return pa.array(out, pa.list_(pa.int32()))


def visual_lines(words: DataFrame, figures: DataFrame, key: str = "page") -> DataFrame:
    """WN-03: (key, line, text): words(key, box_id, sides, text) whose centre is in none of figures(key, f_*), two units of
    margin included, in lines: from the top, a word joins the line if its centre is within 0.55 (upper) median heights of
    the mean centre of the line so far. By right edges from right to left in a line. The fold goes over one page's words."""
    centre_x, centre_y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    near = figures.withColumns({"_a": F.col("f_y0") - 2, "_b": F.col("f_y1") + 3})
    inside = overlap_join(words, near, [key], ("y0", "y1"), ("_a", "_b"), 64).where(centre_x.between(F.col("f_x0") - 2, F.col("f_x1") + 2) & centre_y.between(F.col("f_y0") - 2, F.col("f_y1") + 2))
    kept = words.join(inside.select(key, "box_id").distinct(), [key, "box_id"], "left_anti")
    pages = kept.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(centre_y.cast("double").alias("c"), "box_id", "x1", "text"))).alias("w"), F.array_sort(F.collect_list(F.col("y1") - F.col("y0"))).alias("h")
    )
    reach = 0.55 * F.get("h", F.floor(F.size("h") / 2).cast("int"))
    numbers = F.arrow_udf(_line_numbers, "array<int>")(F.transform("w", lambda x: x["c"]), reach.cast("double"))
    lines = pages.select(key, F.explode(F.arrays_zip("w", numbers.alias("line"))).alias("z")).select(key, "z.line", "z.w.*")
    order = F.array_sort(F.collect_list(F.struct((-F.col("x1")).alias("x"), "box_id", "text")))
    return lines.groupBy(key, "line").agg(F.array_join(F.transform(order, lambda w: w["text"]), " ").alias("text"))


def words(chars: DataFrame, key: str = "page", band: int = 12) -> DataFrame:
    """WN-29: (key, band, word, x0, y0, x1, y1, n): boxes of a band of rows joined while the gap to the one before is below
    max(4, 0.7 heights)."""
    by = Window.partitionBy(key, "band").orderBy("x0", "box_id")
    rows = chars.withColumn("band", F.floor(F.col("y0") / band))
    gap = F.col("x0") - F.lag("x1").over(by)
    begins = F.coalesce((gap >= F.greatest(F.lit(4.0), 0.7 * (F.col("y1") - F.col("y0")))).cast("int"), F.lit(1))
    numbered = rows.withColumn("_new", begins).withColumn("word", F.sum("_new").over(by))
    return bbox_union(numbered, [key, "band", "word"])


def merge_rows(boxes: DataFrame, key: str = "page", share: float = 0.5) -> DataFrame:
    """WN-12: (key, row, sides, n): boxes in order of their top fall in one row while they overlap what the row spans so far
    by more than `share` of their height."""
    by = Window.partitionBy(key).orderBy("y0", "y1", "box_id")
    end = F.max("y1").over(by.rowsBetween(Window.unboundedPreceding, -1))
    overlap = F.least(end, "y1") - F.col("y0")
    begins = (end.isNull() | (overlap <= share * (F.col("y1") - F.col("y0")))).cast("int")
    return bbox_union(boxes.withColumn("_new", begins).withColumn("row", F.sum("_new").over(by)), [key, "row"])


def touching(boxes: DataFrame, key: str, gap: int) -> DataFrame:
    """(key, a, b) for boxes at most `gap` apart, a < b."""
    wide = boxes.select(key, "box_id", "x0", "x1", F.col("y0").alias("y0"), (F.col("y1") + gap + 1).alias("y2"))
    other = boxes.select(key, F.col("box_id").alias("o_id"), F.col("x0").alias("o_x0"), F.col("x1").alias("o_x1"), F.col("y0").alias("o_y0"), (F.col("y1") + gap + 1).alias("o_y2"))
    pairs = overlap_join(wide, other, [key], ("y0", "y2"), ("o_y0", "o_y2"), 64)
    return pairs.where((F.col("box_id") < F.col("o_id")) & (F.col("x0") <= F.col("o_x1") + gap) & (F.col("o_x0") <= F.col("x1") + gap)).select(key, F.col("box_id").alias("a"), F.col("o_id").alias("b"))


def _forest(edges: DataFrame, key: str, held: int | None = None) -> DataFrame:
    """(key, a, b), b < a: the edges(key, a, b) of a task with each box bound to the least one that it hangs together with, by
    union-find. With `held`, a task that knows so many boxes puts them out and begins anew, so some are bound to another
    one of their cluster only; without, the edges come sorted by key and a page is held at a time."""
    plain = edges.select(key, "a", "b")
    shape = ", ".join(f"{name} {kind}" for name, kind in plain.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def top(node):
            while (up := above.setdefault(node, node)) != node:
                above[node] = node = above[up]
            return node

        def known(schema: pa.Schema) -> pa.RecordBatch:
            bound = [(page, box, least) for page, box in above for least in [top((page, box))[1]] if least != box]
            above.clear()
            return pa.RecordBatch.from_arrays([pa.array([row[i] for row in bound], field.type) for i, field in enumerate(schema)], schema=schema)

        last, schema = None, None
        for batch in batches:
            schema = batch.schema
            for page, a, b in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if above and (len(above) >= held if held else page != last):
                    yield known(schema)
                last = page
                x, y = top((page, a)), top((page, b))
                above[max(x, y)] = min(x, y)
        if above:
            yield known(schema)

    return plain.mapInArrow(run, shape)


def _contracted(edges: DataFrame, key: str, rounds: int) -> DataFrame:
    """(key, box_id, cluster) for the ends of edges(key, a, b), by joins: a round maps each box to the one of itself and its
    neighbours that comes first in an order drawn anew, and replaces the ends of all edges by what they map to, so that
    half of the boxes of a chain go, however its ids run, until no edge is left; then the maps are followed and each
    cluster is given its least box. Each round is a checkpoint; more than `rounds` is an error."""
    found, maps = edges.select(key, F.col("a").alias("box_id")).union(edges.select(key, "b")).distinct().withColumn("cluster", F.col("box_id")), []
    while not edges.isEmpty():
        if len(maps) == rounds:
            raise RuntimeError(f"clusters did not settle in {rounds} rounds")
        drawn = lambda box, turn=len(maps): F.struct(F.xxhash64(key, box, F.lit(turn)).alias("h"), F.col(box).alias("box"))
        ends = edges.unionAll(edges.select(key, F.col("b"), F.col("a")))
        firsts = ends.groupBy(key, F.col("a").alias("box_id")).agg(F.min(drawn("b")).alias("_near"))
        to = stored_checkpoint(firsts.select(key, "box_id", F.least(drawn("box_id"), "_near")["box"].alias("cluster")))
        maps.append(to)
        named = lambda x, to=to: to.select(key, F.col("box_id").alias(x), F.col("cluster").alias(f"_{x}"))
        moved = edges.join(named("a"), [key, "a"]).join(named("b"), [key, "b"]).where("_a <> _b")
        edges = stored_checkpoint(moved.select(key, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    for to in maps:
        found = found.join(to.select(key, F.col("box_id").alias("cluster"), F.col("cluster").alias("_to")), [key, "cluster"], "left").select(key, "box_id", F.coalesce("_to", "cluster").alias("cluster"))
    least = found.groupBy(key, "cluster").agg(F.min("box_id").alias("_least"))
    return found.join(least, [key, "cluster"]).select(key, "box_id", F.col("_least").alias("cluster"))


def clusters(boxes: DataFrame, gap: int, key: str = "page", rounds: int = 60, most: int = 500_000) -> DataFrame:
    """WN-13: (key, box_id, cluster): boxes joined by chains of gaps of `gap` at most; a cluster is named by its least box.

    Where the edges are found, each task binds its boxes to the least of their chain first, so a page sends one row a box
    and task on, however many boxes touch. A page of at most `most` such rows is settled by union-find in one pass over
    it; a larger one by rounds of joins, which no page is too large for. A box without an id or page is its own cluster.
    """
    bound = stored_checkpoint(_forest(touching(boxes, key, gap), key, most))
    large = bound.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key)
    settled = _forest(bound.join(large, key, "left_anti").repartition(key).sortWithinPartitions(key), key).select(key, F.col("a").alias("box_id"), F.col("b").alias("cluster"))
    rest = stored_checkpoint(bound.join(large, key, "left_semi"))
    if not rest.isEmpty():
        settled = settled.unionByName(_contracted(rest, key, rounds))
    return boxes.select(key, "box_id").join(settled, [key, "box_id"], "left").withColumn("cluster", F.coalesce("cluster", "box_id"))


def classify_clusters(members: DataFrame, keys: list[str]) -> DataFrame:
    """PRJ-07: role, reason and grid of each cluster of members(keys..., box_id, sides, kind): the first rule that fits its
    counts of strokes, thin strokes, oblique strokes and words, and its size."""
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    # the rank of a value among those of its cluster counts the different ones where members are, without a copy of them for each count
    rank = lambda c: F.when(F.col(c).isNotNull(), F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(c))))
    members = members.withColumn("_row", rank("y0")).withColumn("_col", rank("x0"))
    counts = members.groupBy(*keys).agg(
        F.count_if(F.col("kind") == "stroke").alias("strokes"), F.count_if((F.col("kind") == "stroke") & (F.least(width, height) <= 10)).alias("thin"),
        F.count_if((F.col("kind") == "stroke") & (width > 20) & (height > 10)).alias("oblique"), F.count_if(F.col("kind") == "word").alias("words"),
        F.coalesce(F.max("_row"), F.lit(0)).alias("rows"), F.coalesce(F.max("_col"), F.lit(0)).alias("cols"), (F.max("x1") - F.min("x0")).alias("w"), (F.max("y1") - F.min("y0")).alias("h"),
    )
    role = (
        F.when((F.col("w") < 30) & (F.col("h") < 15), F.lit("noise:small"))
        .when((F.col("thin") >= 3) & (F.col("words") >= 3), "table:ruled words")
        .when((F.col("oblique") >= 2) & (F.col("words") <= 2), "figure:oblique strokes")
        .when(F.col("words") > F.col("strokes"), "text:mostly words")
        .when(F.col("strokes") > 0, "drawing:strokes")
        .otherwise("unknown:")
    )
    grid = F.when(F.col("role") == "table", F.concat_ws("x", "rows", "cols")).otherwise("")
    named = counts.withColumn("_r", role).withColumn("role", F.substring_index("_r", ":", 1)).withColumn("reason", F.substring_index("_r", ":", -1))
    return named.withColumn("grid", grid).select(*keys, "role", "reason", "grid")


def option_groups(boxes: DataFrame, labels: DataFrame, key: str = "page") -> DataFrame:
    """WN-14: (key, group, place, box_id, label): boxes of a page whose width is within 30 % and height within 60 % of each
    other's, in rows then right to left, each with the nearest label(key, label, x, y)."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    sized = boxes.select(key, "box_id", "x0", "y0", w.alias("w"), h.alias("h"))
    other = sized.select(key, F.col("box_id").alias("o_id"), F.col("w").alias("o_w"), F.col("h").alias("o_h"))
    alike = (F.abs(F.col("w") - F.col("o_w")) <= 0.3 * F.greatest("w", "o_w")) & (F.abs(F.col("h") - F.col("o_h")) <= 0.6 * F.greatest("h", "o_h"))
    group = sized.join(other, key).where(alike).groupBy(key, "box_id", "x0", "y0").agg(F.min("o_id").alias("group"), F.count("*").alias("n")).where("n >= 2")
    placed = group.withColumn("place", F.row_number().over(Window.partitionBy(key, "group").orderBy(F.round(F.col("y0") / 40), F.desc("x0"), "box_id")))
    d2 = (F.col("x") - F.col("x0")) * (F.col("x") - F.col("x0")) + (F.col("y") - F.col("y0")) * (F.col("y") - F.col("y0"))
    near = placed.join(labels, key).groupBy(key, "box_id").agg(F.min(F.struct(d2.alias("d"), "label")).alias("near"))
    return placed.join(near, [key, "box_id"], "left").select(key, "group", "place", "box_id", F.col("near.label").alias("label"))


def marker_sequence(markers: DataFrame, most_per_page: int = 3) -> DataFrame:
    """WN-10: (doc, start, numbers): the start page from which the markers(doc, page, y, number), in order, count 1, 2, 3 ...
    the furthest. Pages with more than most_per_page markers are left out; a document has a bounded number of markers."""
    usable = markers.withColumn("_n", F.count("*").over(Window.partitionBy("doc", "page"))).where(F.col("_n") <= most_per_page)
    listed = usable.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "y", "number"))).alias("all"))
    starts = listed.select("doc", F.explode(F.array_distinct(F.transform("all", lambda m: m["page"]))).alias("start"), "all")
    after = F.filter("all", lambda m: m["page"] >= F.col("start"))
    taken = F.aggregate(after, F.array().cast("array<bigint>"), lambda seen, m: F.when(m["number"] == F.size(seen) + 1, F.array_append(seen, m["number"])).otherwise(seen))
    best = starts.withColumn("numbers", taken).groupBy("doc").agg(F.max_by(F.struct("start", "numbers"), F.struct(F.size("numbers"), -F.col("start"))).alias("best"))
    return best.select("doc", F.col("best.start").alias("start"), F.array_join("best.numbers", ",").alias("numbers"))


def regions(markers: DataFrame, pages: DataFrame) -> DataFrame:
    """WN-11: (doc, number, page) of the pages of each question: from its marker(doc, page, number) to the page before the
    next one's; a page after the first belongs only while all pages up to it have role continuation."""
    by = Window.partitionBy("doc").orderBy("page", "number")
    spans = markers.withColumn("_next", F.lead("page").over(by)).join(pages.groupBy("doc").agg(F.max("page").alias("_end")), "doc")
    until = F.greatest(F.col("page"), F.coalesce(F.col("_next") - 1, F.col("_end")))
    every = spans.select("doc", "number", F.col("page").alias("_first"), F.explode(F.sequence("page", until)).alias("page"))
    role = every.join(pages, ["doc", "page"], "left")
    broken = F.when((F.col("page") > F.col("_first")) & ~F.coalesce(F.col("role") == "continuation", F.lit(False)), 1).otherwise(0)
    kept = role.withColumn("_broken", F.sum(broken).over(Window.partitionBy("doc", "number", "_first").orderBy("page")))
    return kept.where("_broken = 0").select("doc", "number", "page")
