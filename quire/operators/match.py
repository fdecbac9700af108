"""Joins that compare two sources: bags, ids, boxes, points, names, cells, values and series."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators.batching import changes, whole_keys
from quire.operators.nearest import nearest_points
from quire.operators.ranges import as_of, near_join, overlap_join
from quire.sources.incremental import stored_checkpoint


def _bags(a: DataFrame, b: DataFrame | None, keys: list[str], flagged: DataFrame | None = None) -> DataFrame:
    """(keys..., n_a, n_b, n_f): how often each key is in a, b and flagged, by one aggregation. Without b, a has the rows of
    both with their `side`, a or b, so that those of a task are counted together before they are sent. A key with a null
    is equal to none of another side."""
    sided = [a.select(*keys, "side") if b is None else a.select(*keys, F.lit("a").alias("side"))]
    sided += [x.select(*keys, F.lit(side).alias("side")) for side, x in (("b", b), ("f", flagged)) if x is not None]
    apart = F.when(reduce(lambda x, y: x | y, (F.col(k).isNull() for k in keys)), F.col("side")).alias("_apart")
    counts = [F.count_if(F.col("side") == side).alias(f"n_{side}") for side in "abf"]
    return reduce(DataFrame.unionAll, sided).groupBy(*keys, apart).agg(*counts).where("n_a + n_b > 0").drop("_apart")


def bag_diff(a: DataFrame, b: DataFrame | None, keys: list[str]) -> DataFrame:
    """JN-01: (keys..., n_a, n_b, missing, extra): how often each key is in either bag, and the differences. Without b, a has
    the rows of both with their `side`."""
    both = _bags(a, b, keys)
    return both.select(*keys, "n_a", "n_b", F.greatest(F.col("n_a") - F.col("n_b"), F.lit(0)).alias("missing"), F.greatest(F.col("n_b") - F.col("n_a"), F.lit(0)).alias("extra"))


def bag_recall(truth: DataFrame, got: DataFrame | None, group: list[str], token: str) -> DataFrame:
    """AG-01: (group..., truth, found, recall): the share of the truth's tokens, repeats counted, that were got."""
    diff = bag_diff(truth, got, [*group, token])
    return diff.groupBy(*group).agg(F.sum("n_a").alias("truth"), F.sum(F.least("n_a", "n_b")).alias("found")).withColumn("recall", F.round(F.when(F.col("truth") > 0, F.col("found") / F.col("truth")), 6))


def silent_errors(truth: DataFrame, got: DataFrame | None, flagged: DataFrame, whole: DataFrame, group: str, token: str) -> DataFrame:
    """AG-02: (group, silent): differences of the reading from the truth that no flag names; a group of `whole`, flagged
    as a whole, has none."""
    wrong = _bags(truth, got, [group, token], flagged)
    left = wrong.groupBy(group).agg(F.sum(F.greatest(F.abs(F.col("n_a") - F.col("n_b")) - F.col("n_f"), F.lit(0))).alias("silent"))
    return left.join(whole.select(group).distinct().withColumn("_w", F.lit(True)), group, "left").select(group, F.when(F.col("_w"), 0).otherwise(F.col("silent")).alias("silent"))


def reconcile_ids(expected: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """JN-02: (key, issue) of ids that are missing, extra or returned more than once."""
    missing = expected.select(key).distinct().join(returned, key, "left_anti").select(key, F.lit("missing").alias("issue"))
    extra = returned.select(key).distinct().join(expected, key, "left_anti").select(key, F.lit("extra").alias("issue"))
    return missing.unionByName(extra).unionByName(returned.groupBy(key).count().where("count > 1").select(key, F.lit("duplicate").alias("issue")))


def iou_join(a: DataFrame, b: DataFrame, key: str = "page", cell: int = 64) -> DataFrame:
    """JN-04: (key, box_id, match_id, iou): for each box of a the box of b with the largest intersection over union."""
    other = b.select(key, *(F.col(c).alias(f"o_{c}") for c in ("box_id", "x0", "y0", "x1", "y1")))
    pairs = overlap_join(a, other, [key], ("y0", "y1"), ("o_y0", "o_y1"), cell).where("x0 < o_x1 AND o_x0 < x1")
    inter = (F.least("x1", "o_x1") - F.greatest("x0", "o_x0")) * (F.least("y1", "o_y1") - F.greatest("y0", "o_y0"))
    area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    scored = pairs.withColumn("iou", F.round(inter / (area("") + area("o_") - inter), 6))
    best = scored.groupBy(key, "box_id").agg(F.max_by(F.struct("o_box_id", "iou"), F.struct("iou", -F.col("o_box_id"))).alias("best"))
    return best.select(key, "box_id", F.col("best.o_box_id").alias("match_id"), F.col("best.iou").alias("iou"))


def bind_regions(items: DataFrame, markers: DataFrame, key: str = "page") -> DataFrame:
    """JN-05: items(key, item, y0, y1) plus region: the last marker(key, y, region) at or above the item's top, else at or
    above its bottom."""
    page, by = Window.partitionBy(key), Window.partitionBy(key).orderBy("_at", "_item", "region").rowsBetween(Window.unboundedPreceding, 0)
    both = items.withColumns({"_item": F.lit(1), "_mark": F.lit(None), "region": F.lit(None)}).unionByName(markers.where("y IS NOT NULL").select(key, F.col("y").alias("_mark"), F.lit(0).alias("_item"), "region"), allowMissingColumns=True)
    # an item above the first marker of its page is looked up by its bottom, any other by its top: one sort answers both
    at = F.when(F.col("_item") == 0, F.col("_mark")).when(F.col("y0") >= F.min(F.when(F.col("region").isNotNull(), F.col("_mark"))).over(page), F.col("y0")).otherwise(F.col("y1"))
    return both.withColumn("_at", at).withColumn("region", F.last("region", ignorenulls=True).over(by)).where("_item = 1").drop("_at", "_item", "_mark")


def one_to_one(pairs: DataFrame, left: list[str], right: list[str], cost: list[Column]) -> DataFrame:
    """The pairs that a greedy pass in order of cost takes, each end once, to the end. left and right are the columns of
    either end; those of both are the group (a page, a document) within which ends are matched. cost must order all pairs
    of a group strictly.

    The pairs of a group are sorted by Spark, which spills, and streamed through one pass; what is held are the ends that are taken,
    however many pairs there are and however long their chains."""
    group = [c for c in left if c in right]
    ends = [[c for c in side if c not in group] for side in (left, right)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        taken: tuple[set, set] = (set(), set())
        for batch in batches:
            groups, lefts, rights = (list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True)) for columns in (group, *ends))
            keep = []
            for g, x, y in zip(groups or [()] * batch.num_rows, lefts, rights, strict=True):
                if g != last:
                    last, taken = g, (set(), set())
                keep.append(x not in taken[0] and y not in taken[1])
                if keep[-1]:
                    taken[0].add(x)
                    taken[1].add(y)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return pairs.repartition(*group).sortWithinPartitions(*group, *cost).mapInArrow(run, pairs.schema)


def tolerance_match(a: DataFrame, b: DataFrame, key: str, tx: float, ty: float) -> DataFrame:
    """JN-06: (key, pid, match_id, status) for points(key, pid, x, y): pairs within the tolerances, the nearest first, each
    point once, and the points of either side that are left. contested: another candidate was in reach of either."""
    other = b.select(key, F.col("pid").alias("o_pid"), F.col("x").alias("o_x"), F.col("y").alias("o_y"))
    pairs = near_join(a, other, [key], F.col("x"), F.col("o_x"), tx).where(F.abs(F.col("y") - F.col("o_y")) <= ty)
    d = F.round((F.col("x") - F.col("o_x")) ** 2 + (F.col("y") - F.col("o_y")) ** 2, 9)
    several = (F.count("*").over(Window.partitionBy(key, "pid")) > 1) | (F.count("*").over(Window.partitionBy(key, "o_pid")) > 1)
    found = one_to_one(pairs.select(key, "pid", "o_pid", d.alias("d"), several.alias("contested")), [key, "pid"], [key, "o_pid"], [F.col("d"), F.col("pid"), F.col("o_pid")])
    matched = found.select(key, "pid", F.col("o_pid").alias("match_id"), F.when(F.col("contested"), "contested").otherwise("matched").alias("status"))
    lost = a.select(key, "pid").join(matched, [key, "pid"], "left_anti").select(key, "pid", F.lit(None).cast("long").alias("match_id"), F.lit("unmatched").alias("status"))
    more = b.select(key, F.col("pid").alias("match_id")).join(matched, [key, "match_id"], "left_anti").select(key, F.lit(None).cast("long").alias("pid"), "match_id", F.lit("extra").alias("status"))
    return matched.unionByName(lost).unionByName(more)


def nearest_owner(tokens: DataFrame, segs: DataFrame, key: str = "page") -> DataFrame:
    """JN-07: (key, seg_id, token_id, d2): each token(key, token_id, x, y) goes to the nearest seg(key, seg_id, x, y) of
    its page, and each seg keeps the nearest of its tokens. Ties go to the least id; a page without segs has no rows, and
    what has no position is near to none."""
    sides = (rows.select(key, F.lit(seg).alias("seg"), F.col(name).alias("id"), "x", "y") for seg, name, rows in ((False, "token_id", tokens), (True, "seg_id", segs)))
    found = nearest_of_points(reduce(DataFrame.unionAll, sides), key)
    return found.select(key, *(F.col(name).cast(dict(rows.dtypes)[name]).alias(name) for name, rows in (("seg_id", segs), ("token_id", tokens))), "d2")


_WHOLE_NUMBERS = ("tinyint", "smallint", "int", "bigint")


def nearest_of_points(points: DataFrame, key: str = "page", most: int = 1 << 20, pairs: int = 1 << 26, held: int = 1 << 17) -> DataFrame:
    """JN-07: nearest_owner of points(key, seg, id, x, y), segs and tokens.

    Points are dealt by page, unless they lie so already, and stream through, whole pages of some `held` points at a time, in
    which every token is compared with the segs of its page. A page of more than `most` points or `pairs` of a token and a
    seg isn't held: it passes through and goes to a grid, which is dealt by cell. Points of other types than numbers all do."""
    kinds, number = dict(points.dtypes), (*_WHOLE_NUMBERS, "float", "double")
    plain = kinds["id"] in _WHOLE_NUMBERS and kinds["x"] in number and kinds["y"] in number
    d2 = points.select((F.col("x") - F.col("x")) * (F.col("x") - F.col("x")) + (F.col("y") - F.col("y")) * (F.col("y") - F.col("y"))).dtypes[0][1]
    page = Window.partitionBy(key)
    found = points.where(F.col(key).isNotNull() & (F.col("id").isNotNull() | ~F.col("seg")))
    for c in ("x", "y"):
        found = found.where((F.col(c).cast("double") > -math.inf) & (F.col(c).cast("double") < math.inf))
    found = found.select(key, "seg", "id", "x", "y", F.count("*").over(page).alias("_n"), F.count_if("seg").over(page).alias("_s"))
    found = found.select(key, "seg", "id", "x", "y", ((F.col("_n") > most) | (F.col("_s") * (F.col("_n") - F.col("_s")) > pairs) | F.lit(not plain)).alias("large"))

    def values(rows: pa.RecordBatch, c: str) -> np.ndarray:
        column = rows.column(c).cast(pa.int64()) if kinds[c] in _WHOLE_NUMBERS else rows.column(c)
        return (column.fill_null(np.iinfo(np.int64).min) if c == "id" else column).to_numpy(zero_copy_only=False)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
        for batch in batches:
            ends = [0, *changes(batch.column("large")).tolist(), batch.num_rows] if batch.num_rows else []
            yield from ((batch.column("large")[i].as_py(), batch.slice(i, j - i)) for i, j in pairwise(ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "seg", "id", "other", "d2", "x", "y"]
        for large, parts in groupby(pieces(batches), lambda piece: piece[0]):
            rows_of = (rows for _, rows in parts)
            for rows in rows_of if large else ():
                none = [pa.nulls(rows.num_rows, rows.schema.field("id").type), pa.nulls(rows.num_rows, found_d2)]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in (key, "seg", "id")), *none, rows.column("x"), rows.column("y")], names=names)
            for rows in () if large else whole_keys(rows_of, key, lambda rows: np.ones(rows.num_rows, np.int64), held):
                number = np.zeros(rows.num_rows, np.int64)
                number[changes(rows.column(key))] = 1
                seg = rows.column("seg").to_numpy(zero_copy_only=False)
                s, t, far = nearest_points(np.cumsum(number), seg, *(values(rows, c) for c in ("id", "x", "y")))
                none = [pa.nulls(len(s), rows.schema.field(c).type) for c in ("seg", "x", "y")]
                yield pa.RecordBatch.from_arrays([rows.column(key).take(pa.array(s)), none[0], rows.column("id").take(pa.array(s)), rows.column("id").take(pa.array(t)), pa.array(far).cast(found_d2), *none[1:]], names=names)

    found_d2 = pa.int64() if {kinds["x"], kinds["y"]} <= {*_WHOLE_NUMBERS} else pa.float64()
    schema = f"{key} {kinds[key]}, seg boolean, id {kinds['id']}, other {kinds['id']}, d2 {'bigint' if found_d2 == pa.int64() else 'double'}, x {kinds['x']}, y {kinds['y']}"
    settled = stored_checkpoint(found.mapInArrow(run, schema))
    done = settled.where("seg IS NULL").select(key, F.col("id").alias("seg_id"), F.col("other").alias("token_id"), F.col("d2").cast(d2).alias("d2"))
    rest = settled.where("seg IS NOT NULL")
    if rest.isEmpty():
        return done
    tokens = rest.where(~F.col("seg")).select(key, F.struct("id", "x", "y").alias("token_id"), "x", "y")  # known by all it has, as an id may be null or twice
    grid = _nearest_by_grid(tokens, rest.where("seg").select(key, F.col("id").alias("seg_id"), "x", "y"), key)
    return done.unionAll(grid.select(key, "seg_id", F.col("token_id.id").alias("token_id"), F.col("d2").cast(d2).alias("d2")))


def _nearest_by_grid(tokens: DataFrame, segs: DataFrame, key: str) -> DataFrame:
    """JN-07: nearest_owner of pages of any size.

    A page is a grid with about one seg a cell. A token looks at its cell and the eight around; what is nearer than a cell's
    width is the nearest. The few tokens that found nothing so near look for the narrowest cells, each twice as wide as the
    ones before, with a seg in or around their own, all widths in one join, and then at the segs within four of these. So a
    token meets few segs wherever segs are dense, a page of n tokens and m segs isn't n * m pairs, and there are two rounds
    whatever the distances. The joins are merges: none of their sides is gathered by the driver."""
    at = lambda c, step: F.floor(F.col(c) / step).cast("long")
    width = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).cast("double")
    grids = segs.groupBy(key).agg(F.when(width > 0, width).otherwise(1.0).alias("_wide"), F.count("*").alias("_n"), F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    grids = stored_checkpoint(grids.withColumn("_step", F.col("_wide") / F.sqrt(F.col("_n").cast("double"))).drop("_n"))
    other = segs.select(key, "seg_id", F.col("x").alias("sx"), F.col("y").alias("sy"))
    d2 = (F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy"))
    near = F.array(*map(F.lit, (-1, 0, 1)))

    def around(step: Column) -> Column:
        return F.explode(F.flatten(F.transform(near, lambda i: F.transform(near, lambda j: F.struct((at("x", step) + i).alias("_cx"), (at("y", step) + j).alias("_cy"))))))

    def nearest(rows: DataFrame, level: list[str]) -> DataFrame:
        """(key, token_id, x, y, _step, best) of rows(key, token_id, x, y, _step, level...): the nearest seg in or around the
        token's cell, or null."""
        at_levels = other.join((rows.select(key, "_step", *level).distinct() if level else grids.select(key, "_step")).hint("merge"), key)
        cells = at_levels.select(key, *level, "seg_id", "sx", "sy", at("sx", F.col("_step")).alias("_cx"), at("sy", F.col("_step")).alias("_cy"))
        looked = rows.select(key, *level, "token_id", "x", "y", "_step", around(F.col("_step")).alias("_c")).select(key, *level, "token_id", "x", "y", "_step", "_c.*")
        best = F.min(F.when(F.col("seg_id").isNotNull(), F.struct(d2.alias("d2"), "seg_id"))).alias("best")
        return looked.join(cells.hint("merge"), [key, *level, "_cx", "_cy"], "left").groupBy(key, "token_id", "x", "y", "_step").agg(best)

    seen = stored_checkpoint(nearest(tokens.select(key, "token_id", "x", "y").join(grids.select(key, "_step").hint("merge"), key), []))
    sure = F.coalesce(F.col("best.d2") <= F.col("_step") * F.col("_step"), F.lit(False))
    outside = F.greatest(F.col("_x0") - F.col("x"), F.col("x") - F.col("_x1"), F.col("_y0") - F.col("y"), F.col("y") - F.col("_y1"), F.lit(0)).cast("double")
    doublings = lambda d: F.log2(F.greatest(d / F.col("_step"), F.lit(1.0)))
    levels = F.sequence(F.greatest(F.floor(doublings(outside)) - 1, F.lit(0)).cast("int"), (F.ceil(doublings(outside + F.col("_wide"))) + 1).cast("int"))
    asked = stored_checkpoint(seen.where(~sure).join(grids.drop("_step").hint("merge"), key).select(key, "token_id", "x", "y", F.col("_step").alias("_unit"), F.explode(levels).alias("_level")).withColumn("_step", F.col("_unit") * F.pow(F.lit(2.0), "_level")))
    cells = other.join(asked.select(key, "_level", "_step").distinct().hint("merge"), key).select(key, "_level", at("sx", F.col("_step")).alias("_cx"), at("sy", F.col("_step")).alias("_cy")).distinct()
    looked = asked.select(key, "token_id", "_level", around(F.col("_step")).alias("_c")).select(key, "token_id", "_level", "_c.*")
    first = looked.join(cells.hint("merge"), [key, "_level", "_cx", "_cy"]).groupBy(key, "token_id").agg(F.min("_level").alias("_level"))
    late = stored_checkpoint(asked.join(first.hint("merge"), [key, "token_id", "_level"]).withColumn("_step", F.col("_step") * 4).select(key, "token_id", "x", "y", "_level", "_step"))
    owner = seen.where(sure).select(key, "token_id", "best").unionAll(nearest(late, ["_level"]).select(key, "token_id", "best"))
    kept = owner.groupBy(key, F.col("best.seg_id").alias("seg_id")).agg(F.min(F.struct(F.col("best.d2").alias("d2"), "token_id")).alias("kept"))
    return kept.select(key, "seg_id", F.col("kept.token_id").alias("token_id"), F.col("kept.d2").alias("d2"))


def fuzzy_bind(a: DataFrame, b: DataFrame, key: str, threshold: float = 0.75) -> DataFrame:
    """JN-08: (key, name, other, ratio): names of a and b bound by 1 - edits / longer length, the likest first, each once.

    Only names whose lengths allow the threshold are compared, by buckets of length. block_bind goes by matching blocks.
    """
    left = a.select(key, "name").distinct().withColumn("_len", F.length("name"))
    right = b.select(key, F.col("name").alias("other")).distinct()
    reach = F.sequence(F.ceil(F.length("other") * threshold), F.floor(F.length("other") / threshold))
    pairs = left.join(right.withColumn("_len", F.explode(reach)), [key, "_len"])
    ratio = F.round(1 - F.levenshtein("name", "other") / F.greatest(F.length("name"), F.length("other")), 6)
    scored = pairs.withColumn("ratio", ratio).where(F.col("ratio") >= threshold).select(key, "name", "other", "ratio")
    return one_to_one(scored, [key, "name"], [key, "other"], [F.desc("ratio"), F.col("name"), F.col("other")])


def block_ratios(a: pa.Array, b: pa.Array) -> pa.Array:
    """Twice the letters in matching blocks (the longest first, then to its left and right) over all letters of both names."""
    return pa.array([SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def letter_grams(names: pa.Array) -> pa.Array:
    """Of each name its letters, numbered where they repeat: later repeats first, which few names have, then by letter."""
    out = []
    for name in names.to_pylist():
        seen: Counter = Counter()
        numbered = []
        for c in name or "":
            seen[c] += 1
            numbered.append((-seen[c], c))
        out.append([f"{-n}{c}" for n, c in sorted(numbered)])
    return pa.array(out, pa.list_(pa.string()))


def block_bind(a: DataFrame, b: DataFrame, key: str, threshold: float = 0.75) -> DataFrame:
    """JN-08: (key, name, other, ratio): names of a and b bound by the share of letters in matching blocks, the likest first,
    each once. Empty and null names are bound to none.

    Blocks match at most the letters that both names have, so an index of letters finds all pairs: two names that reach the
    threshold share a letter among the first so many of each, in one order of all. Lengths and the count of common letters
    rule out most of these; only the rest are compared by blocks."""
    def listed(rows: DataFrame, name: str, grams: str) -> DataFrame:
        return rows.select(key, F.col("name").alias(name)).distinct().where(F.length(name) > 0).withColumn(grams, F.arrow_udf(letter_grams, "array<string>")(name))

    def prefix(grams: str) -> Column:
        least = F.ceil(F.size(grams) * (threshold / (2 - threshold)) - 1e-9).cast("int")
        return F.explode(F.slice(grams, 1, F.size(grams) - least + 1)).alias("_gram")

    left, right = listed(a, "name", "_ga"), listed(b, "other", "_gb")
    both = F.size("_ga") + F.size("_gb")
    pairs = left.select("*", prefix("_ga")).join(right.select("*", prefix("_gb")), [key, "_gram"]).where(2 * F.least(F.size("_ga"), F.size("_gb")) >= threshold * both - 1e-9)
    pairs = pairs.dropDuplicates([key, "name", "other"]).where(2 * F.size(F.array_intersect("_ga", "_gb")) >= threshold * both - 1e-9)
    scored = pairs.select(key, "name", "other", F.arrow_udf(block_ratios, "double")("name", "other").alias("ratio")).where(F.col("ratio") >= threshold)
    return one_to_one(scored.withColumn("ratio", F.round("ratio", 6)), [key, "name"], [key, "other"], [F.desc("ratio"), F.col("name"), F.col("other")])


def compare_cells(spec: DataFrame, observed: DataFrame, table: str, value: str) -> DataFrame:
    """JN-09: (table, r, c, spec, observed) of cells that differ; a table whose shape differs has one row of nulls instead."""
    shape = lambda df, n: df.groupBy(table).agg(F.struct(F.max("r"), F.max("c"), F.count("*")).alias(n))
    other = shape(spec, "s").join(shape(observed, "o"), table, "full_outer").where(~F.col("s").eqNullSafe(F.col("o"))).select(table)
    both = spec.select(table, "r", "c", F.col(value).alias("spec")).join(observed.select(table, "r", "c", F.col(value).alias("observed")), [table, "r", "c"], "full_outer")
    differ = both.where(~F.col("spec").eqNullSafe(F.col("observed"))).join(other, table, "left_anti")
    return differ.unionByName(other, allowMissingColumns=True)


def verify_values(declared: DataFrame, measured: DataFrame, group: str, step: float, per_pixel: float) -> DataFrame:
    """JN-10: (group, cat, status) per category: VERIFIED within max(2 % of the step, 3 % of the value, 6 pixels), PARTIAL
    within twice that, else CONFLICT; UNAVAILABLE without a measure. Different counts make the whole group a CONFLICT."""
    n = lambda df, name: df.groupBy(group).agg(F.count("value").alias(name))
    off = n(declared, "n_d").join(n(measured, "n_m"), group).where("n_d <> n_m").select(group, F.lit(True).alias("off"))
    both = declared.join(measured.select(group, "cat", F.col("value").alias("got")), [group, "cat"], "left").join(off, group, "left")
    limit = F.greatest(F.lit(0.02 * step), 0.03 * F.greatest(F.abs("value"), F.lit(1.0)), F.lit(6 * per_pixel))
    d = F.abs(F.col("got") - F.col("value"))
    status = F.when(F.col("off"), "CONFLICT").when(F.col("got").isNull(), "UNAVAILABLE").when(d <= limit, "VERIFIED").when(d <= 2 * limit, "PARTIAL").otherwise("CONFLICT")
    return both.select(group, "cat", status.alias("status"))


def header_join(cells: DataFrame, table: str, header_rows: int, header_cols: int) -> DataFrame:
    """JN-11: data cells with the text of their row's and their column's headers, in order."""
    text = lambda at, name: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "text"))), lambda x: x["text"]), " ").alias(name)
    rows = cells.where((F.col("c") < header_cols) & (F.col("r") >= header_rows)).groupBy(table, "r").agg(text("c", "row_header"))
    cols = cells.where((F.col("r") < header_rows) & (F.col("c") >= header_cols)).groupBy(table, "c").agg(text("r", "col_header"))
    data = cells.where((F.col("r") >= header_rows) & (F.col("c") >= header_cols))
    return data.join(rows, [table, "r"], "left").join(cols, [table, "c"], "left").select(table, "r", "c", "text", "row_header", "col_header")


def prefer_text(image: DataFrame, text: DataFrame, key: str) -> DataFrame:
    """JN-12: (key, value, source, changed): the text's value where there is one, else the image's."""
    both = image.select(key, F.col("value").alias("_image")).join(text.select(key, F.col("value").alias("_text")), key, "full_outer")
    source = F.when(F.col("_text").isNotNull(), "text").otherwise("image")
    return both.select(key, F.coalesce("_text", "_image").alias("value"), source.alias("source"), F.coalesce(F.col("_text") != F.col("_image"), F.lit(False)).alias("changed"))


def arbitrate(conflicts: DataFrame, numbers: DataFrame, key: str) -> DataFrame:
    """JN-13: conflicts(key, item, vision, ocr) plus verdict: the text has the other's number: wrong; it has the vision's:
    note; equal digits, the dot aside: neither; else unresolved."""
    known = lambda c, n: numbers.select(key, F.col("number").alias(c)).distinct().withColumn(n, F.lit(True))
    both = conflicts.join(known("ocr", "_o"), [key, "ocr"], "left").join(known("vision", "_v"), [key, "vision"], "left")
    same = F.replace("vision", F.lit("."), F.lit("")) == F.replace("ocr", F.lit("."), F.lit(""))
    verdict = F.when(same, "neither").when(F.col("_o"), "wrong").when(F.col("_v"), "note").otherwise("unresolved")
    return both.select(key, "item", "vision", "ocr", verdict.alias("verdict"))


def adjacent(boxes: DataFrame, key: str = "page") -> DataFrame:
    """JN-14: (key, first, second, side) of boxes that share a part of an edge. A box gives its four edges, which meet at
    their position, those that end there with those that begin there, in one join for both sides."""
    edge = lambda side, ends, at, lo, hi: F.struct(F.lit(side).alias("side"), F.lit(ends).alias("ends"), F.col(at).alias("at"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    sides = F.array(edge("right", True, "x1", "y0", "y1"), edge("right", False, "x0", "y0", "y1"), edge("below", True, "y1", "x0", "x1"), edge("below", False, "y0", "x0", "x1"))
    edges = boxes.where(f"{key} IS NOT NULL").select(key, "box_id", F.explode(sides).alias("e")).select(key, "box_id", "e.*").where("at IS NOT NULL AND lo IS NOT NULL AND hi IS NOT NULL")
    ended = edges.where("ends").select(key, "side", "at", F.col("box_id").alias("first"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    begun = edges.where("NOT ends").select(key, "side", "at", F.col("box_id").alias("second"), "lo", "hi")
    return ended.join(begun, [key, "side", "at"]).where("_lo < hi AND lo < _hi AND first <> second").select(key, "first", "second", "side")


def match_options(target: DataFrame, options: DataFrame, group: str) -> DataFrame:
    """JN-15: (group, option) of the options(group, option, key, value) that equal every given fact of target(group, key,
    value); keys that aren't given don't matter."""
    given = target.groupBy(group).agg(F.count("*").alias("_given"))
    same = options.join(target.withColumnRenamed("value", "_want"), [group, "key"]).groupBy(group, "option").agg(F.count_if(F.col("value") == F.col("_want")).alias("_same"))
    return same.join(given, group).where("_same = _given").select(group, "option")


def declared_vs_detected(docs: DataFrame, items: DataFrame, words: DataFrame) -> DataFrame:
    """JN-16: (doc_id, declared, detected) where the number that a text states first differs from how many items it has.

    words(word, number) is a short table of number words.
    """
    stated = docs.select("doc_id", F.regexp_extract(F.lower("text"), r"(^|[^a-z0-9])([0-9]{1,4}|one|two|three|four|five|six|seven|eight|nine|ten)([^a-z0-9]|$)", 2).alias("word")).where("word <> ''")
    number = stated.join(words, "word", "left").select("doc_id", F.coalesce("number", F.col("word").try_cast("long")).alias("declared"))
    found = items.groupBy("doc_id").agg(F.count("*").alias("detected"))
    return number.join(found, "doc_id", "left").select("doc_id", "declared", F.coalesce("detected", F.lit(0)).alias("detected")).where("declared <> detected")


def best_fragment(items: DataFrame, docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """JN-18: (item_id, doc_id, shared, total, score): the document that holds the largest share of an item's distinct runs
    of n words, if that is the threshold or more; a tie goes to the least id. Runs are joined by hash, repeats in a
    document counting once, as do rows of one id. Texts that are null or shorter than a run hold none.

    Of an item's runs only the rarest are joined to documents: so many that a document which lacks all of them holds too
    few of the rest. What a document shares is then counted for these candidates alone, so a run that many items and
    many documents have is counted by documents but doesn't bring all of its pairs.
    """

    def runs(df: DataFrame, key: str) -> DataFrame:
        words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
        listed = df.select(key, words.alias("w")).where(F.size("w") >= n)
        grams = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " ")))
        return listed.select(key, F.explode(F.array_distinct(grams)).alias("gram"))

    wanted = stored_checkpoint(runs(items, "item_id").distinct())
    held = stored_checkpoint(runs(docs, "doc_id").join(wanted.select("gram").distinct(), "gram", "left_semi").distinct())
    total = wanted.groupBy("item_id").agg(F.count("*").alias("total"))
    ranked = wanted.join(held.groupBy("gram").agg(F.count("*").alias("df")), "gram", "left").join(total, "item_id")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "gram"))
    needed = F.ceil((threshold - 1e-6) * F.col("total"))  # scores are rounded to six places
    rarest = ranked.withColumn("place", place).where(F.col("place") <= F.col("total") - needed + 1).select("item_id", "gram")
    candidates = held.join(rarest, "gram").select("item_id", "doc_id").distinct()
    shared = candidates.join(wanted, "item_id").join(held, ["doc_id", "gram"], "left_semi").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    scored = shared.join(total, "item_id").withColumn("score", F.round(F.col("shared") / F.col("total"), 6)).where(F.col("score") >= threshold)
    best = scored.groupBy("item_id").agg(F.max_by(F.struct("doc_id", "shared", "total", "score"), F.struct("score", -F.col("doc_id"))).alias("best"))
    return best.select("item_id", "best.*")


def bind_dimension(dims: DataFrame, entities: DataFrame, group: str) -> DataFrame:
    """JN-21: (group, dim, entity, ambiguous): a dimension goes to the entities of its kind, to the one of its ordinal if it
    states one; more than one is ambiguous."""
    numbered = entities.withColumn("_n", F.row_number().over(Window.partitionBy(group, "kind").orderBy("entity")))
    both = dims.join(numbered, [group, "kind"]).where(F.col("ordinal").isNull() | (F.col("ordinal") == F.col("_n")))
    return both.select(group, "dim", "entity", (F.count("*").over(Window.partitionBy(group, "dim")) > 1).alias("ambiguous"))


def check_facts(facts: DataFrame, points: DataFrame, group: str, tolerance: float = 1e-6) -> DataFrame:
    """JN-22: facts(group, fact_id, kind, p1..p4) plus holds: checked on points(group, name, x, y), null if one is absent."""
    joined = facts
    for i in range(1, 5):
        joined = joined.join(points.select(group, F.col("name").alias(f"p{i}"), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}")), [group, f"p{i}"], "left")
    c = lambda n: F.col(n)
    dx, dy = (lambda i, j: c(f"x{j}") - c(f"x{i}")), (lambda i, j: c(f"y{j}") - c(f"y{i}"))
    cross = lambda i, j, k, m: dx(i, j) * dy(k, m) - dy(i, j) * dx(k, m)
    dot = lambda i, j, k, m: dx(i, j) * dx(k, m) + dy(i, j) * dy(k, m)
    zero = lambda e: F.abs(e) <= tolerance
    holds = (
        F.when(c("kind") == "collinear", zero(cross(1, 2, 1, 3)))
        .when(c("kind") == "between", zero(cross(1, 2, 1, 3)) & (dot(2, 1, 2, 3) <= tolerance))
        .when(c("kind") == "midpoint", zero(c("x1") + c("x3") - 2 * c("x2")) & zero(c("y1") + c("y3") - 2 * c("y2")))
        .when(c("kind") == "equal_length", zero(dot(1, 2, 1, 2) - dot(3, 4, 3, 4)))
        .when(c("kind") == "parallel", zero(cross(1, 2, 3, 4)))
        .when(c("kind") == "perpendicular", zero(dot(1, 2, 3, 4)))
        .when(c("kind") == "right_angle", zero(dot(2, 1, 2, 3)))
        .when(c("kind") == "on_x_axis", zero(c("y1")))
        .when(c("kind") == "on_y_axis", zero(c("x1")))
    )
    return joined.select(group, "fact_id", "kind", holds.alias("holds"))


def tolerant_f1(a: DataFrame, b: DataFrame, key: str, k: int) -> DataFrame:
    """JN-23: (key, precision, recall, f1) of two sets of whole-numbered points(key, x, y): one counts if the other set has
    one within k cells in x and in y."""

    def hits(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        mine = left.select(key, "x", "y").distinct()
        other = right.select(key, F.col("x").alias("ox"), F.col("y").alias("oy")).distinct()
        near = near_join(mine, other, [key], F.col("x"), F.col("ox"), k).where(F.abs(F.col("y") - F.col("oy")) <= k).select(key, "x", "y").distinct()
        return mine.join(near.withColumn("_hit", F.lit(1)), [key, "x", "y"], "left").groupBy(key).agg(F.round(F.count("_hit") / F.count("*"), 6).alias(name))

    both = hits(a, b, "precision").join(hits(b, a, "recall"), key, "full_outer").fillna(0.0)
    total = F.col("precision") + F.col("recall")
    return both.withColumn("f1", F.round(F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0), 6))


def manifest_diff(expected: DataFrame, got: DataFrame, group: str) -> DataFrame:
    """JN-24: (group, key, expected, got) for the keys whose sorted values differ; null where a side lacks the key."""
    listed = lambda df, name: df.groupBy(group, "key").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias(name))
    return listed(expected, "expected").join(listed(got, "got"), [group, "key"], "full_outer").where(~F.col("expected").eqNullSafe(F.col("got")))


def equivalent(a: DataFrame, b: DataFrame, key: str, most: int = 2, least: int = 5) -> DataFrame:
    """JN-25: (key, shared, unshared, equivalent): two sampled series are equal where both are defined, to 1e-7 relative or
    1e-9 absolute; `most` samples may be defined in one only, and `least` must be shared."""
    both = a.select(key, "x", "y").join(b.select(key, "x", F.col("y").alias("o")), [key, "x"], "full_outer")
    two = F.col("y").isNotNull() & F.col("o").isNotNull()
    one = F.col("y").isNotNull() != F.col("o").isNotNull()
    close = F.abs(F.col("y") - F.col("o")) <= F.greatest(F.lit(1e-9), 1e-7 * F.greatest(F.abs("y"), F.abs("o")))
    found = both.groupBy(key).agg(F.count_if(two).alias("shared"), F.count_if(one).alias("unshared"), F.coalesce(F.bool_and(close), F.lit(False)).alias("_close"))
    return found.select(key, "shared", "unshared", (F.col("_close") & (F.col("shared") >= least) & (F.col("unshared") <= most)).alias("equivalent"))


def series_relation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """JN-26: (key, relation): inversion, mirror, shift_y, shift_x or none, the first that every pair of points shows. Points
    are paired by rank in x, for the mirror in reverse."""
    asc, desc = Window.partitionBy(key).orderBy("x"), Window.partitionBy(key).orderBy(F.desc("x"))
    left = a.select(key, "x", "y", F.row_number().over(asc).alias("_n"))
    right = b.select(key, F.col("x").alias("ox"), F.col("y").alias("oy"), F.row_number().over(asc).alias("_n"), F.row_number().over(desc).alias("_m"))
    near = lambda e: F.bool_and(F.abs(e) <= 1e-9)
    dx, dy = F.col("ox") - F.col("x"), F.col("oy") - F.col("y")
    alike = lambda e: (F.max(F.round(e, 9)) == F.min(F.round(e, 9)))
    fore = left.join(right, [key, "_n"]).groupBy(key).agg((near(dx) & near(F.col("oy") + F.col("y"))).alias("inversion"), (near(dx) & alike(dy)).alias("shift_y"), (near(dy) & alike(dx)).alias("shift_x"))
    back = left.join(right.drop("_n").withColumnRenamed("_m", "_n"), [key, "_n"]).groupBy(key).agg((near(F.col("ox") + F.col("x")) & near(dy)).alias("mirror"))
    relation = F.when(F.col("inversion"), "inversion").when(F.col("mirror"), "mirror").when(F.col("shift_y"), "shift_y").when(F.col("shift_x"), "shift_x").otherwise("none")
    return fore.join(back, key).select(key, relation.alias("relation"))


def integrity_issues(table: DataFrame, key: list[str], references: list[tuple[str, DataFrame, str]], ranges: list[tuple[str, float, float]]) -> DataFrame:
    """JN-27: (issue, column, n): how many duplicate keys, dangling references and values out of range a table has."""
    repeated = table.groupBy(*key).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate").alias("issue"), F.lit(",".join(key)).alias("column"), "n")
    dangling = [
        table.join(other.select(F.col(to).alias(column)).distinct(), column, "left_anti").agg(F.count("*").alias("n")).select(F.lit("dangling").alias("issue"), F.lit(column).alias("column"), "n")
        for column, other, to in references
    ]
    counts = table.agg(*(F.count_if(~F.col(c).between(lo, hi)).alias(c) for c, lo, hi in ranges))
    outside = counts.select(F.explode(F.array(*(F.struct(F.lit("range").alias("issue"), F.lit(c).alias("column"), F.col(c).alias("n")) for c, _, _ in ranges))).alias("i")).select("i.*")
    return reduce(DataFrame.unionByName, [*dangling, outside], repeated)


def grid_cells(tokens: DataFrame, rows: DataFrame, cols: DataFrame, key: str, rtl: bool = False) -> DataFrame:
    """JN-28: (key, row, col, text): tokens(key, token_id, x, y, text) put in the cells between consecutive rules(key, at),
    in reading order. The interval that holds a token is found as of its position."""

    def numbered(rules: DataFrame, name: str) -> DataFrame:
        by = Window.partitionBy(key).orderBy("at")
        unique = rules.select(key, "at").distinct()
        return unique.select(key, F.col("at").alias(f"{name}_at"), (F.row_number().over(by) - 1).alias(name), F.lead("at").over(by).isNull().alias("_last")).select(key, f"{name}_at", F.when(~F.col("_last"), F.col(name)).otherwise(-1).alias(name))

    placed = as_of(as_of(tokens, numbered(rows, "row"), key, "y", "row_at", "row"), numbered(cols, "col"), key, "x", "col_at", "col").where("row >= 0 AND col >= 0")
    order: Column = -F.col("x") if rtl else F.col("x")
    listed = F.array_sort(F.collect_list(F.struct("y", order.alias("o"), "token_id", "text")))
    return placed.groupBy(key, "row", "col").agg(F.array_join(F.transform(listed, lambda t: t["text"]), " ").alias("text"))
