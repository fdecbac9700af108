"""Evaluation and gates: scores by category, stability, outcomes, timing, drift and roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def category_scores(checks: DataFrame, key: str, categories: list[str], default: float = 1.0) -> DataFrame:
    """AG-09: (key, a score each category, overall): the share of checks passed, a default without checks; overall is the
    least."""
    scores = checks.groupBy(key).agg(*(F.round(F.coalesce(F.avg(F.when(F.col("category") == c, F.col("passed").cast("double"))), F.lit(default)), 6).alias(c) for c in categories))
    return scores.withColumn("overall", F.least(*categories) if len(categories) > 1 else F.col(categories[0]))


def stability(runs: DataFrame, key: str, signature: str) -> DataFrame:
    """AG-10: (key, runs, share): how many of a key's runs have its most frequent signature."""
    counts = runs.groupBy(key, signature).agg(F.count("*").alias("_n"))
    return counts.groupBy(key).agg(F.sum("_n").alias("runs"), F.round(F.max("_n") / F.sum("_n"), 6).alias("share"))


def verdict(shares: DataFrame) -> DataFrame:
    """AG-10: one row: STABLE only if every share is 1."""
    return shares.agg(F.count("*").alias("n"), F.when(F.bool_and(F.col("share") == 1), "STABLE").otherwise("UNSTABLE").alias("verdict"))


def outcomes(runs: DataFrame, group: str) -> DataFrame:
    """AG-11: (group, counts of PASS, CORRECTLY_BLOCKED, WRONG_OFFERED, WRONG_ACCEPTED, OTHER) of runs(group, right, offered,
    accepted)."""
    outcome = (
        F.when(F.col("right") & F.col("accepted"), "PASS").when(~F.col("right") & ~F.col("offered"), "CORRECTLY_BLOCKED").when(~F.col("right") & F.col("accepted"), "WRONG_ACCEPTED")
        .when(~F.col("right") & F.col("offered"), "WRONG_OFFERED").otherwise("OTHER")
    )
    names = ["PASS", "CORRECTLY_BLOCKED", "WRONG_OFFERED", "WRONG_ACCEPTED", "OTHER"]
    return runs.groupBy(group).agg(*(F.count_if(outcome == n).alias(n) for n in names))


def label_pr(got: DataFrame, required: DataFrame, key: str) -> DataFrame:
    """AG-12: (key, precision, recall, hallucinated) of distinct labels against the required ones."""
    both = got.select(key, "label").distinct().withColumn("_g", F.lit(1)).join(required.select(key, "label").distinct().withColumn("_r", F.lit(1)), [key, "label"], "full_outer")
    hits = F.count(F.when(F.col("_g").isNotNull() & F.col("_r").isNotNull(), 1))
    extra = F.array_join(F.array_sort(F.collect_list(F.when(F.col("_r").isNull(), F.col("label")))), ",")
    ratio = lambda n: F.round(F.when(F.count(n) > 0, hits / F.count(n)).otherwise(0.0), 6)
    return both.groupBy(key).agg(ratio("_g").alias("precision"), ratio("_r").alias("recall"), extra.alias("hallucinated"))


def percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float], buckets: int = 1024) -> DataFrame:
    """(key, one column for each named share): exact percentiles, interpolated between neighbours. Equal values are counted
    first, then buckets of the range of values; only the buckets that hold a wanted rank are put in order."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranges = counted.groupBy(key).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_all"))
    bucket = F.least(F.lit(buckets - 1), F.floor((F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0)) * buckets))
    placed = counted.join(ranges, key).withColumn("_b", F.coalesce(bucket, F.lit(0)))
    sums = placed.groupBy(key, "_b").agg(F.sum("_c").alias("_in"), F.first("_all").alias("_all"))
    sums = sums.withColumn("_before", F.sum("_in").over(Window.partitionBy(key).orderBy("_b")) - F.col("_in"))
    rank = {name: share * (F.col("_all") - 1) for name, share in shares.items()}
    ends = [f(r) for r in rank.values() for f in (F.floor, F.ceil)]
    wanted = sums.where(reduce(lambda x, y: x | y, ((k >= F.col("_before")) & (k < F.col("_before") + F.col("_in")) for k in ends)))
    inside = placed.join(wanted.select(key, "_b", "_before"), [key, "_b"])
    inside = inside.withColumn("_to", F.col("_before") + F.sum("_c").over(Window.partitionBy(key, "_b").orderBy("_v")))
    at = lambda k: F.max(F.when((k < F.col("_to")) & (k >= F.col("_to") - F.col("_c")), F.col("_v")))
    return inside.groupBy(key).agg(*((at(F.floor(r)) + (F.max(r) - F.max(F.floor(r))) * (at(F.ceil(r)) - at(F.floor(r)))).alias(name) for name, r in rank.items()))


def timing_summary(rows: DataFrame, stage: str, seconds: str, failed: str) -> DataFrame:
    """AG-26: (stage, n, failures, mean, p50, p95, total)."""
    sums = rows.groupBy(stage).agg(F.count("*").alias("n"), F.count_if(F.col(failed)).alias("failures"), F.round(F.avg(seconds), 6).alias("mean"), F.round(F.sum(seconds), 4).alias("total"))
    ranked = percentiles(rows, stage, seconds, {"p50": 0.5, "p95": 0.95})
    return sums.join(ranked, stage, "left").select(stage, "n", "failures", "mean", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "total")


def gate(issues: list[DataFrame], items: DataFrame, key: str) -> DataFrame:
    """AG-31: (key, errors, warnings, blocked) of all items: any error of any check blocks one."""
    every = reduce(DataFrame.unionByName, [i.select(key, "severity") for i in issues])
    counts = every.groupBy(key).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return items.select(key).distinct().join(counts, key, "left").fillna(0, ["errors", "warnings"]).withColumn("blocked", F.col("errors") > 0)


def unknown_keys(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """AG-34: (path, n): keys of JSON objects that the schema doesn't have, with a value."""
    pairs = rows.select(F.explode(F.from_json(column, "map<string,string>")).alias("path", "value"))
    return pairs.where(~F.col("path").isin(*known) & F.col("value").isNotNull() & (F.col("value") != "")).groupBy("path").agg(F.count("*").alias("n"))
