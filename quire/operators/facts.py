"""Evidence: which source to believe, what is covered, missing and contradictory, and what to decide."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Sources from the strongest to the weakest, those that may state relations, and thresholds of a decision.
RELATION_SOURCES = ("teacher", "question_text", "detection")
TEXT_SOURCES = ("teacher", "question_text")
ORIGINAL_BELOW, DRAFT_FROM, HIGH_FINAL, HIGH_COVERAGE = 0.70, 0.85, 0.94, 0.90


def eligible(facts: DataFrame, sources: tuple[str, ...] = RELATION_SOURCES) -> DataFrame:
    """PRJ-03: unambiguous facts of sources that may state relations."""
    return facts.where(F.col("source").isin(*sources) & ~F.col("ambiguous"))


def resolve(facts: DataFrame, key: str = "key") -> DataFrame:
    """WN-01: the best fact of each key: unambiguous first, then by rank of source, confidence and least id."""
    best = Window.partitionBy(key).orderBy("ambiguous", F.desc("rnk"), F.desc("confidence"), "fact_id")
    return facts.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def evidence_conflicts(facts: DataFrame, key: str = "key") -> DataFrame:
    """WN-01: facts that disagree with the best one of their key. The winner's value rides along in one window."""
    best = Window.partitionBy(key).orderBy("ambiguous", F.desc("rnk"), F.desc("confidence"), "fact_id")
    return facts.withColumn("winner", F.first("value").over(best)).where("value <> winner")


def coverage(facts: DataFrame, key: str = "key") -> DataFrame:
    """AG-03: one row of counts over keys, and the share of keys that more than one source states."""
    text = F.col("source").isin(*TEXT_SOURCES)
    flags = facts.groupBy(key).agg(
        (F.count_distinct("source") > 1).alias("independent"), F.bool_or(text).alias("text"), F.bool_or(F.col("source") == "detection").alias("cv"),
        F.bool_and(F.col("source") == "vision").alias("ai_only"), F.bool_or("ambiguous").alias("ambiguous"), F.bool_or("required").alias("required"),
    )
    names = ("independent", "text", "cv", "ai_only", "ambiguous", "required")
    return flags.agg(F.count("*").alias("n_keys"), *(F.count_if(n).alias(f"n_{n}") for n in names)).withColumn("ratio", F.round(F.col("n_independent") / F.col("n_keys"), 3))


def reconcile(facts: DataFrame, missing: DataFrame, conflicts: DataFrame, key: str = "key") -> DataFrame:
    """AG-04: (key, status, providers). Facts of one provider are one source; CONFIRMED needs two. Then a MISSING row for
    each missing key and a CONFLICT row for each key in conflict."""
    status = F.when(F.size("providers") > 1, "CONFIRMED").otherwise("UNCONFIRMED")
    found = facts.groupBy(key).agg(F.array_sort(F.collect_set("source")).alias("providers")).select(key, status.alias("status"), F.array_join("providers", ",").alias("providers"))
    more = [df.select(key).distinct().select(key, F.lit(name).alias("status"), F.lit("").alias("providers")) for df, name in ((missing, "MISSING"), (conflicts, "CONFLICT"))]
    return reduce(DataFrame.unionByName, more, found)


def missing_required(required: DataFrame, asserted: DataFrame, keys: list[str]) -> DataFrame:
    """JN-03: required facts that nothing asserts."""
    return required.select(*keys).distinct().join(asserted.select(*keys).distinct(), keys, "left_anti")


def represented(required: DataFrame, asserted: DataFrame, keys: list[str]) -> DataFrame:
    """JN-03: how many required facts there are, how many are asserted, and their ratio."""
    found = required.select(*keys).distinct().join(asserted.select(*keys).distinct().withColumn("found", F.lit(1)), keys, "left")
    return found.agg(F.count("*").alias("checked"), F.count("found").alias("represented")).withColumn("ratio", F.round(F.col("represented") / F.col("checked"), 3))


def contradictions(facts: DataFrame, exclusive: DataFrame, entities: str = "entity_key") -> DataFrame:
    """JN-17: (entities, first, second) for pairs of exclusive fact types that are stated of the same entities.

    exclusive(first, second) is a short rule table. Types are distinct per entities before they are paired.
    """
    stated = facts.select(entities, "fact_type").distinct()
    first = stated.join(exclusive, stated["fact_type"] == exclusive["first"]).select(entities, "first", "second")
    return first.join(stated.withColumnRenamed("fact_type", "second"), [entities, "second"], "left_semi").select(entities, "first", "second")


def union_facts(*channels: DataFrame, keys: tuple[str, ...] = ("key", "fact_type")) -> DataFrame:
    """SO-03: facts of all channels; where required facts share a key, that of the first channel and least id stays."""
    numbered = [c.withColumn("channel", F.lit(i)) for i, c in enumerate(channels)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    first = Window.partitionBy(*keys, "required").orderBy("channel", "fact_id")
    return every.withColumn("place", F.row_number().over(first)).where("NOT required OR place = 1").drop("place")


def canonical_key(fact_type: Column, entities: Column, symmetric: tuple[str, ...], segments: tuple[str, ...]) -> Column:
    """SC-09: type and entities; sorted where order doesn't matter, pair by pair where entities name segments."""
    pair = lambda i: F.array_join(F.array_sort(F.slice(entities, i, 2)), "")
    paired = F.array_sort(F.array(pair(1), pair(3)))
    ordered = F.when(fact_type.isin(*segments) & (F.size(entities) == 4), paired).when(fact_type.isin(*symmetric), F.array_sort(entities)).otherwise(entities)
    return F.concat_ws("|", fact_type, F.array_join(ordered, ","))


def decide(scores: DataFrame) -> DataFrame:
    """AG-35: final score, action and whether confidence is high.

    scores(classification, extraction, validation, comparison, coverage, cap, supported, valid, critical, unresolved,
    ai_only, contradictions, ambiguous). The least of the four scores and the cap is plausible; with the coverage it is
    final. Unsupported, invalid, critical or unresolved items and those below 0.70 keep the original, from 0.85 on
    they are drafts, between they are reviewed.
    """
    plausible = F.least("classification", "extraction", "validation", "comparison", "cap")
    blocked = ~F.col("supported") | ~F.col("valid") | F.col("critical") | F.col("unresolved")
    action = F.when(blocked | (F.col("plausible") < ORIGINAL_BELOW), "original").when(F.col("plausible") >= DRAFT_FROM, "draft").otherwise("review")
    clean = (F.col("ai_only") == 0) & (F.col("contradictions") == 0) & (F.col("ambiguous") == 0)
    scored = scores.withColumn("plausible", plausible).withColumn("final", F.least("plausible", "coverage"))
    return scored.withColumn("action", action).withColumn("high", clean & (F.col("final") >= HIGH_FINAL) & (F.col("coverage") >= HIGH_COVERAGE))
