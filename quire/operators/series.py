"""Sampled series and points: runs, crossings, extrema, branches, calibration, histograms and fidelity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators.ranges import as_of


def islands(rows: DataFrame, key: str, at: str, gap: float) -> DataFrame:
    """WN-04: (key, island, low, high, centre, n): positions whose neighbours are `gap` apart at most."""
    by = Window.partitionBy(key).orderBy(at)
    begins = F.coalesce((F.col(at) - F.lag(at).over(by) > gap).cast("int"), F.lit(1))
    numbered = rows.withColumn("_new", begins).withColumn("island", F.sum("_new").over(by))
    return numbered.groupBy(key, "island").agg(F.min(at).alias("low"), F.max(at).alias("high"), F.round(F.avg(at), 6).alias("centre"), F.count("*").alias("n"))


def intervals(series: DataFrame, key: str, condition: Column) -> DataFrame:
    """WN-17: (key, begin, end, n): the maximal stretches of samples where the condition holds."""
    by = Window.partitionBy(key)
    rows = series.withColumn("_ok", F.coalesce(condition, F.lit(False))).withColumn("_n", F.row_number().over(by.orderBy("x")))
    held = rows.where("_ok").withColumn("_run", F.col("_n") - F.row_number().over(by.orderBy("x")))
    return held.groupBy(key, "_run").agg(F.min("x").alias("begin"), F.max("x").alias("end"), F.count("*").alias("n")).drop("_run")


def longest_run(series: DataFrame, key: str, condition: Column) -> DataFrame:
    """WN-05: (key, begin, n) of each key's longest stretch; the first of several."""
    best = F.max_by(F.struct("begin", "n"), F.struct("n", -F.col("begin")))
    return intervals(series, key, condition).groupBy(key).agg(best.alias("b")).select(key, "b.begin", "b.n")


def regular_spacing(rows: DataFrame, key: str, at: str) -> DataFrame:
    """WN-06: (key, gaps, median, worst, stable): gaps are regular if none is off their median by over 0.06 of it + 1.5."""
    gaps = rows.withColumn("_g", F.col(at) - F.lag(at).over(Window.partitionBy(key).orderBy(at))).where("_g IS NOT NULL")
    median = gaps.withColumn("median", F.percentile("_g", 0.5).over(Window.partitionBy(key)))
    found = median.groupBy(key).agg(F.count("*").alias("gaps"), F.max("median").alias("median"), F.round(F.max(F.abs(F.col("_g") - F.col("median"))), 6).alias("worst"))
    return found.withColumn("stable", F.col("worst") <= 0.06 * F.col("median") + 1.5)


def crossings(series: DataFrame, key: str = "sid", pole: float = 1e9) -> DataFrame:
    """WN-15: (key, x): where consecutive samples change sign, by linear interpolation, and samples that are zero. A change
    by more than `pole` isn't a crossing."""
    by = Window.partitionBy(key).orderBy("x")
    rows = series.withColumns({"_y": F.lag("y").over(by), "_x": F.lag("x").over(by)})
    root = F.col("_x") + (F.col("x") - F.col("_x")) * F.col("_y") / (F.col("_y") - F.col("y"))
    changed = rows.where((F.col("_y") * F.col("y") < 0) & (F.abs(F.col("y") - F.col("_y")) <= pole)).select(key, F.round(root, 6).alias("x"))
    return changed.unionByName(series.where("y = 0").select(key, F.round(F.col("x").cast("double"), 6).alias("x")))


def extrema(series: DataFrame, key: str = "sid") -> DataFrame:
    """WN-16: (key, x, y, kind) of samples above or below both neighbours; an undefined neighbour makes none."""
    by = Window.partitionBy(key).orderBy("x")
    before, after = F.col("y") - F.lag("y").over(by), F.lead("y").over(by) - F.col("y")
    kind = F.when((before > 0) & (after < 0), "max").when((before < 0) & (after > 0), "min")
    return series.withColumn("kind", kind).where("kind IS NOT NULL").select(key, "x", "y", "kind")


def branches(series: DataFrame, key: str, jump: float, least: int = 3) -> DataFrame:
    """WN-18: (key, branch, begin, end, n): stretches split at undefined samples and at jumps; shorter ones are dropped."""
    by = Window.partitionBy(key).orderBy("x")
    breaks = F.col("y").isNull() | F.lag("y").over(by).isNull() | (F.abs(F.col("y") - F.lag("y").over(by)) > jump)
    rows = series.withColumn("_b", breaks.cast("int")).withColumn("branch", F.sum("_b").over(by)).where("y IS NOT NULL")
    return rows.groupBy(key, "branch").agg(F.min("x").alias("begin"), F.max("x").alias("end"), F.count("*").alias("n")).where(F.col("n") >= least)


def landmark_issues(landmarks: DataFrame, key: str) -> DataFrame:
    """WN-19: (key, flips, marked, turns, forced, unmarked_turn) of ordered landmarks(key, x, y, kind): sign changes along
    them must not exceed the marked intercepts; a turn must be marked as an extremum."""
    by = Window.partitionBy(key).orderBy("x")
    before, after = F.col("y") - F.lag("y").over(by), F.lead("y").over(by) - F.col("y")
    rows = landmarks.withColumns({"_flip": F.lag("y").over(by) * F.col("y") < 0, "_turn": (before * after < 0) & (F.col("kind") != "extremum")})
    found = rows.groupBy(key).agg(F.count_if("_flip").alias("flips"), F.count_if(F.col("kind") == "intercept").alias("marked"), F.count_if("_turn").alias("turns"))
    return found.withColumns({"forced": F.col("flips") > F.col("marked"), "unmarked_turn": F.col("turns") > 0})


def symmetry(series: DataFrame, key: str, tolerance: float) -> DataFrame:
    """WN-20: (key, pairs, symmetry): even, odd or none, on the samples whose mirrored x is sampled too."""
    other = series.select(key, (-F.col("x")).alias("x"), F.col("y").alias("_o"))
    pairs = series.join(other, [key, "x"]).where("x > 0 AND y IS NOT NULL AND _o IS NOT NULL").groupBy(key)
    found = pairs.agg(F.count("*").alias("pairs"), F.bool_and(F.abs(F.col("y") - F.col("_o")) <= tolerance).alias("e"), F.bool_and(F.abs(F.col("y") + F.col("_o")) <= tolerance).alias("o"))
    return found.select(key, "pairs", F.when(F.col("e"), "even").when(F.col("o"), "odd").otherwise("none").alias("symmetry"))


def calibrate(ticks: DataFrame, key: str, least_r2: float = 0.999) -> DataFrame:
    """AG-18: (key, slope, intercept, r2, flipped, ok): the line through ticks(key, pixel, value); if it fits badly, values
    before the zero tick are taken as negative."""

    def fit(rows: DataFrame, flipped: bool) -> DataFrame:
        line = rows.groupBy(key).agg(F.regr_slope("value", "pixel").alias("slope"), F.regr_intercept("value", "pixel").alias("intercept"), F.regr_r2("value", "pixel").alias("r2"))
        return line.withColumn("flipped", F.lit(flipped))

    zero = ticks.groupBy(key).agg(F.min(F.when(F.col("value") == 0, F.col("pixel"))).alias("_z"))
    turned = ticks.join(zero, key).withColumn("value", F.when(F.col("pixel") < F.col("_z"), -F.abs("value")).otherwise(F.col("value"))).drop("_z")
    tries = fit(ticks, False).unionByName(fit(turned, True))
    best = tries.groupBy(key).agg(F.min_by(F.struct("slope", "intercept", "r2", "flipped"), F.struct((~(F.col("r2") >= least_r2)).cast("int"), F.col("flipped").cast("int"))).alias("b"))
    return best.select(key, *(F.round(f"b.{c}", 6).alias(c) for c in ("slope", "intercept", "r2")), "b.flipped", F.coalesce(F.col("b.r2") >= least_r2, F.lit(False)).alias("ok"))


def affine_fit(rows: DataFrame, key: str) -> DataFrame:
    """AG-19: (key, n, a, b, c) of u = a x + b y + c by least squares, from centred sums; null below three points or when
    the points are on a line."""
    mean = rows.groupBy(key).agg(F.count("*").alias("n"), *(F.avg(v).alias(f"m{v}") for v in "xyu"))
    d = rows.join(mean, key).select(key, "n", "mx", "my", "mu", *((F.col(v) - F.col(f"m{v}")).alias(v) for v in "xyu"))
    pairs = {"xx": "x*x", "xy": "x*y", "yy": "y*y", "xu": "x*u", "yu": "y*u"}
    s = d.groupBy(key, "n", "mx", "my", "mu").agg(*(F.sum(F.expr(e)).alias(p) for p, e in pairs.items()))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    s = s.withColumn("det", det).withColumn("ok", (F.col("n") >= 3) & (F.abs("det") > 1e-9))
    a = F.when(F.col("ok"), (F.col("xu") * F.col("yy") - F.col("yu") * F.col("xy")) / F.col("det"))
    b = F.when(F.col("ok"), (F.col("yu") * F.col("xx") - F.col("xu") * F.col("xy")) / F.col("det"))
    return s.withColumns({"a": a, "b": b}).select(key, "n", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round(F.col("mu") - F.col("a") * F.col("mx") - F.col("b") * F.col("my"), 6).alias("c"))


def histogram(rows: DataFrame, key: str, column: str, bins: list[float]) -> DataFrame:
    """AG-20: (key, bin, low, high, n) over explicit bins, half open but for the last; they must rise strictly. The bins are
    a short list, so the place of a value is an expression."""
    if len(bins) < 2 or any(b <= a for a, b in zip(bins, bins[1:], strict=False)):
        raise ValueError("bins must rise strictly")
    place = reduce(lambda c, i: c.when(F.col(column) < bins[i + 1], i), range(1, len(bins) - 1), F.when(F.col(column) < bins[1], 0)).otherwise(len(bins) - 2)
    inside = rows.where(F.col(column).between(bins[0], bins[-1])).groupBy(key, place.alias("bin")).agg(F.count("*").alias("n"))
    edges = F.array(*map(F.lit, map(float, bins)))
    return inside.select(key, "bin", F.element_at(edges, F.col("bin") + 1).alias("low"), F.element_at(edges, F.col("bin") + 2).alias("high"), "n")


def shares(rows: DataFrame, group: str, category: str, value: str) -> DataFrame:
    """AG-21: (group, category, share, ok): parts of the whole; a total that isn't positive or a negative value is an error."""
    by = Window.partitionBy(group)
    total, ok = F.sum(value).over(by), (F.sum(value).over(by) > 0) & (F.min(value).over(by) >= 0)
    return rows.select(group, category, F.round(F.when(ok, F.col(value) / total), 6).alias("share"), ok.alias("ok"))


def sigma_regions(rows: DataFrame, key: str, column: str, k: int) -> DataFrame:
    """AG-22: (key, region, share): k regions of half a standard deviation around the mean, the outer ones open."""
    stats = rows.groupBy(key).agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"), F.count("*").alias("_n"))
    region = F.floor((F.col(column) - F.col("_m")) / F.col("_s") * 2) + k // 2
    placed = rows.join(stats, key).where("_s > 0").withColumn("region", F.greatest(F.lit(0), F.least(F.lit(k - 1), region)))
    return placed.groupBy(key, "region", "_n").agg(F.count("*").alias("_c")).select(key, F.col("region").cast("long").alias("region"), F.round(F.col("_c") / F.col("_n"), 6).alias("share"))


def symmetric(regions: DataFrame, key: str, k: int, tolerance: float) -> DataFrame:
    """AG-22: (key, symmetric): whether the shares equal their reverse."""
    both = regions.join(regions.select(key, (k - 1 - F.col("region")).alias("region"), F.col("share").alias("_o")), [key, "region"], "full_outer").fillna(0.0, ["share", "_o"])
    return both.groupBy(key).agg(F.bool_and(F.abs(F.col("share") - F.col("_o")) <= tolerance).alias("symmetric"))


def otsu(rows: DataFrame, key: str, column: str) -> DataFrame:
    """AG-24: (key, threshold): the level from 0 to 255 that separates two classes best; the lowest of several."""
    bins = rows.groupBy(key, F.col(column).alias("level")).agg(F.count("*").alias("n"))
    by = Window.partitionBy(key)
    upto = by.orderBy("level")
    sums = bins.select(key, "level", F.sum("n").over(upto).alias("w"), F.sum(F.col("n") * F.col("level")).over(upto).alias("s"), F.sum("n").over(by).alias("all_w"), F.sum(F.col("n") * F.col("level")).over(by).alias("all_s"))
    gap = F.col("s") / F.col("w") - (F.col("all_s") - F.col("s")) / (F.col("all_w") - F.col("w"))
    between = F.round(F.col("w").cast("double") * (F.col("all_w") - F.col("w")) * gap * gap, 4)
    return sums.where("w < all_w").withColumn("v", between).groupBy(key).agg(F.max_by("level", F.struct("v", -F.col("level"))).alias("threshold"))


def kind_summary(landmarks: DataFrame, key: str) -> DataFrame:
    """AG-30: (key, maxima, minima, labels): how many landmarks of each kind, and their sorted labels."""
    return landmarks.groupBy(key).agg(F.count_if(F.col("kind") == "max").alias("maxima"), F.count_if(F.col("kind") == "min").alias("minima"), F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"))


def distribution_fidelity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """AG-36: (key, status) of two point sets by their shares of points in each quadrant around a's mean and their trends.
    MISMATCH if one has 20 % where the other has 2 % or less, or if opposite trends differ by 0.5 or more; LOW_CONFIDENCE
    if a share differs by over 35 %."""
    mean = a.groupBy(key).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))

    def shape(rows: DataFrame, p: str) -> DataFrame:
        right, above = F.col("x") >= F.col("_mx"), F.col("y") >= F.col("_my")
        parts = [right & above, right & ~above, ~right & above, ~right & ~above]
        return rows.join(mean, key).groupBy(key).agg(*(F.avg(q.cast("double")).alias(f"{p}{i}") for i, q in enumerate(parts)), F.corr("x", "y").alias(f"{p}c"))

    both = shape(a, "a").join(shape(b, "b"), key)
    empty = reduce(lambda x, y: x | y, [(F.col(f"{p}{i}") >= 0.2) & (F.col(f"{q}{i}") <= 0.02) for i in range(4) for p, q in ("ab", "ba")])
    trend = (F.col("ac") * F.col("bc") < 0) & (F.abs(F.col("ac") - F.col("bc")) >= 0.5)
    far = reduce(lambda x, y: x | y, [F.abs(F.col(f"a{i}") - F.col(f"b{i}")) > 0.35 for i in range(4)])
    return both.select(key, F.when(empty | F.coalesce(trend, F.lit(False)), "MISMATCH").when(far, "LOW_CONFIDENCE").otherwise("OK").alias("status"))


def worst(panels: DataFrame, figure: str) -> DataFrame:
    """AG-36: (figure, status): that of the worst panel."""
    rank = F.when(F.col("status") == "MISMATCH", 2).when(F.col("status") == "LOW_CONFIDENCE", 1).otherwise(0)
    return panels.groupBy(figure).agg(F.max_by("status", rank).alias("status"))


def value_at(series: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """wanted(key, at) plus y, the last defined sample's at or before it."""
    known = series.where("y IS NOT NULL").select(key, "x", "y")
    return as_of(wanted, known, key, "at", "x", "y")
