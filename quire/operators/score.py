"""Points under "answer K of N" rules, to the cent. All amounts are decimals; rounding is half up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CENTS = "decimal(18,2)"
TOLERANCE = 0.02


def answered_total(sections: DataFrame) -> DataFrame:
    """AG-06: (qid, mandatory, optional, answered) for sections(qid, sec, points, grp, k): the points outside groups, and
    k times the most that an option of each group gives."""
    groups = sections.where("grp <> ''").groupBy("qid", "grp").agg((F.max("k") * F.max("points")).alias("best"), F.count("*").alias("options"))
    groups = groups.groupBy("qid").agg(F.sum("best").cast(CENTS).alias("optional"))
    own = sections.groupBy("qid").agg(F.coalesce(F.sum(F.when(F.col("grp") == "", F.col("points"))), F.lit(0)).cast(CENTS).alias("mandatory"))
    both = own.join(groups, "qid", "left").withColumn("optional", F.coalesce("optional", F.lit(0)).cast(CENTS))
    return both.withColumn("answered", (F.col("mandatory") + F.col("optional")).cast(CENTS))


def score_issues(sections: DataFrame) -> DataFrame:
    """AG-07: (qid, grp, issue): a group without a choice, with unequal options, and a total that is off by more than
    0.02 for each answer asked for."""
    groups = sections.where("grp <> ''").groupBy("qid", "grp").agg(F.count("*").alias("n"), F.max("k").alias("k"), F.min("points").alias("lo"), F.max("points").alias("hi"))
    asked = groups.groupBy("qid").agg(F.sum("k").alias("asked"))
    total = sections.groupBy("qid").agg(F.max("total").alias("total"))
    off = answered_total(sections).join(total, "qid").join(asked, "qid", "left")
    off = off.where(F.abs(F.col("answered") - F.col("total")) > F.lit(TOLERANCE) * F.greatest(F.lit(1), F.coalesce("asked", F.lit(0))))
    rows = [groups.where("n <= k").select("qid", "grp", F.lit("no_choice").alias("issue")), groups.where("lo <> hi").select("qid", "grp", F.lit("unequal_options").alias("issue"))]
    return rows[0].unionByName(rows[1]).unionByName(off.select("qid", F.lit("").alias("grp"), F.lit("total_mismatch").alias("issue")))


def rubric_issues(sections: DataFrame, general: Column, tolerance: float = 0.5) -> DataFrame:
    """AG-07: sections whose rubric is off its target, G + (100 - G) * share of points, by more than the tolerance."""
    share = F.col("points") / F.sum("points").over(Window.partitionBy("qid"))
    target = general + (100 - general) * share
    return sections.withColumn("target", F.round(target.cast("double"), 4)).where(F.abs(F.col("rubric_pct").cast("double") - F.col("target")) > tolerance)


def route_check(sections: DataFrame, want: int = 100) -> DataFrame:
    """AG-08: (qid, route, asked, ok): whether the answered total is `want`, within max(0.02, 0.005 K + 0.001)."""
    asked = sections.groupBy("qid").agg(F.count_distinct(F.when(F.col("grp") != "", F.col("grp"))).alias("asked"))
    route = answered_total(sections).join(asked, "qid")
    limit = F.greatest(F.lit(TOLERANCE), 0.005 * F.col("asked") + 0.001)
    return route.select("qid", F.col("answered").alias("route"), "asked", (F.abs(F.col("answered") - want) <= limit).alias("ok"))


def completeness(sections: DataFrame, solutions: DataFrame, rubric: DataFrame) -> DataFrame:
    """AG-32: (qid, sec, no_solution, empty_answer, rubric_off): what each section lacks. rubric(qid, sec, points) may be
    off by 0.05."""
    solved = solutions.groupBy("qid", "sec").agg(F.bool_or(F.trim("answer") != "").alias("answered"))
    shares = rubric.groupBy("qid", "sec").agg(F.sum("points").alias("given"))
    joined = sections.select("qid", "sec", "points").join(solved, ["qid", "sec"], "left").join(shares, ["qid", "sec"], "left")
    off = F.col("given").isNull() | (F.abs(F.col("given") - F.col("points")) > 0.05)
    return joined.select("qid", "sec", F.col("answered").isNull().alias("no_solution"), F.coalesce(~F.col("answered"), F.lit(False)).alias("empty_answer"), off.alias("rubric_off"))


def allocate(rows: DataFrame, key: str, order: str, total: str, pct: str) -> DataFrame:
    """WN-07: rows plus `amount`: the share of total by percentage, to the cent; the last row takes what is left if the
    percentages sum to 100 within 0.02."""
    each, upto = Window.partitionBy(key), Window.partitionBy(key).orderBy(order)
    cents = F.round(F.col(total) * F.col(pct) / 100, 2).cast(CENTS)
    rows = rows.withColumn("_cents", cents).withColumn("_last", F.lead(order).over(upto).isNull())
    rest = F.col(total) - (F.sum("_cents").over(each) - F.col("_cents"))
    whole = F.abs(F.sum(pct).over(each) - 100) <= TOLERANCE
    return rows.withColumn("amount", F.when(F.col("_last") & whole, rest).otherwise(F.col("_cents")).cast(CENTS)).drop("_cents", "_last")


def split_evenly(rows: DataFrame, key: str, order: str, total: str) -> DataFrame:
    """WN-07: equal shares of total to the cent, the last row taking the remainder."""
    each, upto = Window.partitionBy(key), Window.partitionBy(key).orderBy(order)
    share = F.round(F.col(total) / F.count("*").over(each), 2).cast(CENTS)
    rest = F.col(total) - share * (F.count("*").over(each) - 1)
    rows = rows.withColumn("_last", F.lead(order).over(upto).isNull())
    return rows.withColumn("amount", F.when(F.col("_last"), rest).otherwise(share).cast(CENTS)).drop("_last")


def rebalance(sections: DataFrame) -> DataFrame:
    """WN-08: sections plus new_points, scaled so that the answered total is `total`.

    Mandatory sections keep their proportions and the options of a group become equal, at their mean or, if that is not
    above 0, at 1. If nothing weighs anything, mandatory sections count alike. The remainder goes to the last section, but
    only if the question has no groups.
    """
    question, group = Window.partitionBy("qid"), Window.partitionBy("qid", "grp")
    mandatory = F.col("grp") == ""
    mean = F.avg(F.col("points").cast("double")).over(group)
    part = F.when(mandatory, F.lit(1.0)).otherwise(F.col("k") / F.count("*").over(group))
    rows = sections.withColumns({"_weight": F.when(mandatory, F.col("points").cast("double")).when(mean > 0, mean).otherwise(1.0), "_part": part})
    rows = rows.withColumns({"_all": F.sum(F.col("_weight") * F.col("_part")).over(question), "_even": F.sum("_part").over(question)})
    flat = F.col("_all") <= 0
    weight, every = F.when(flat, 1.0).otherwise(F.col("_weight")), F.when(flat, F.when(F.col("_even") > 0, F.col("_even")).otherwise(1.0)).otherwise(F.col("_all"))
    rows = rows.withColumn("_raw", F.round(weight * F.col("total").cast("double") / every + 1e-9, 2).cast(CENTS))
    last = F.lead("sec").over(question.orderBy("sec")).isNull() & (F.max("grp").over(question) == "")
    rest = F.col("total") - (F.sum("_raw").over(question) - F.col("_raw"))
    return rows.withColumn("new_points", F.when(last, rest).otherwise(F.col("_raw")).cast(CENTS)).drop("_weight", "_part", "_all", "_even", "_raw")


def rebalance_rubric(sections: DataFrame, rubric: DataFrame, most_general: int = 50) -> DataFrame:
    """WN-08: rubric(qid, sec, step, pct) plus new_pct, for sections(qid, sec, grp, total, new_points).

    A step of no section of the question is general. Without groups, or with general steps only, all steps are scaled to
    100 and the last takes the remainder (all 0: as they are). Else general steps keep theirs, and what they leave of 100,
    counting `most_general` of them at most, goes to the sections by their points, and within a section to its steps by
    their pct, or evenly if all are 0.
    """
    question, section = Window.partitionBy("qid"), Window.partitionBy("qid", "sec")
    points = F.when(F.col("sec").isNotNull(), F.col("new_points").cast("double"))
    own = sections.where("qid IS NOT NULL").select("qid", "sec", points.alias("_points"), (F.col("grp") != "").alias("_grouped"), F.col("total").cast("double").alias("_total"))
    # sections and steps are dealt and sorted together, in place of joins; all windows go by the order of the first
    steps = rubric.withColumn("_step", F.lit(1)).unionByName(own, allowMissingColumns=True)
    steps = steps.withColumn("_at", F.count("_step").over(question.orderBy("sec", "step").rowsBetween(Window.unboundedPreceding, 0)))
    steps = steps.withColumns({"_points": F.max("_points").over(section), "_grouped": F.bool_or("_grouped").over(question), "_total": F.max("_total").over(question), "_steps": F.count("_step").over(question)})
    steps = steps.where("_step = 1")
    pct, general = F.col("pct").cast("double"), F.col("_points").isNull()
    steps = steps.withColumns({
        "_sum": F.sum(pct).over(question), "_general": F.sum(F.when(general, pct).otherwise(0.0)).over(question), "_some": F.count("_points").over(question), "_own": F.sum(pct).over(section), "_n": F.count("*").over(section),
        "_last": F.col("_at") == F.col("_steps"),
    })
    cents = lambda x: F.round(x + 1e-9, 2).cast(CENTS)
    whole = ~F.coalesce("_grouped", F.lit(False)) | (F.col("_some") == 0)
    steps = steps.withColumn("_new", cents(100 * pct / F.nullif(F.col("_sum"), F.lit(0.0))))
    scaled = F.when(F.col("_last"), 100 - (F.sum("_new").over(question) - F.col("_new"))).otherwise(F.col("_new"))
    share = F.when(F.col("_total") > 0, (100 - F.least(F.col("_general"), F.lit(float(most_general)))) * F.col("_points") / F.nullif(F.col("_total"), F.lit(0.0))).otherwise(0.0)
    dealt = cents(F.when(F.col("_own") > 0, share * pct / F.nullif(F.col("_own"), F.lit(0.0))).otherwise(share / F.col("_n")))
    new = F.when(whole & (F.col("_sum") > 0), scaled).when(whole | general, F.col("pct")).otherwise(dealt).cast(CENTS)
    return steps.withColumn("new_pct", new).select(*(F.col(c).cast(kind).alias(c) for c, kind in rubric.dtypes), "new_pct")


def contiguous(members: DataFrame) -> DataFrame:
    """WN-28: (qid, grp, n, ok, positions): whether a group's members stand next to each other, and where if not."""
    groups = members.where("grp <> ''").groupBy("qid", "grp")
    found = groups.agg(F.count("*").alias("n"), (F.max("sec") - F.min("sec") + 1 == F.count("*")).alias("ok"), F.array_join(F.array_sort(F.collect_list("sec")), ",").alias("positions"))
    return found.withColumn("positions", F.when(F.col("ok"), "").otherwise(F.col("positions")))
