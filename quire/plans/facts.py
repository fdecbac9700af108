"""Queries of the evidence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import facts
from quire.plans.registry import query
from quire.sources import views
from quire.sources.tables import read

_BEST = "ORDER BY ambiguous, rnk DESC, confidence DESC, fact_id"
_EXCLUSIVE = [("click", "error"), ("purchase", "view")]


@query("prj03_eligible", "SELECT key, fact_id, source FROM v_facts WHERE source IN ('teacher', 'question_text', 'detection') AND NOT ambiguous")
def prj03(spark, sf_dir):
    return facts.eligible(views.facts(spark, sf_dir)).select("key", "fact_id", "source")


@query("wn01_resolve", f"SELECT key, fact_id, source, value, confidence FROM v_facts QUALIFY row_number() OVER (PARTITION BY key {_BEST}) = 1")
def wn01(spark, sf_dir):
    return facts.resolve(views.facts(spark, sf_dir)).select("key", "fact_id", "source", "value", "confidence")


@query("wn01_conflicts", f"WITH w AS (SELECT *, first_value(value) OVER (PARTITION BY key {_BEST}) AS winner FROM v_facts) SELECT key, fact_id, value, winner FROM w WHERE value <> winner")
def wn01_conflicts(spark, sf_dir):
    return facts.evidence_conflicts(views.facts(spark, sf_dir)).select("key", "fact_id", "value", "winner")


@query(
    "ag03_coverage",
    """WITH f AS (SELECT key, count(DISTINCT source) > 1 AS i, bool_or(source IN ('teacher', 'question_text')) AS t, bool_or(source = 'detection') AS c, bool_and(source = 'vision') AS a,
        bool_or(ambiguous) AS m, bool_or(required) AS r FROM v_facts GROUP BY key)
    SELECT count(*) AS n_keys, count(*) FILTER (i) AS n_independent, count(*) FILTER (t) AS n_text, count(*) FILTER (c) AS n_cv, count(*) FILTER (a) AS n_ai_only, count(*) FILTER (m) AS n_ambiguous, count(*) FILTER (r) AS n_required,
        round(count_if(i) / count(*), 3) AS ratio FROM f""",
)
def ag03(spark, sf_dir):
    return facts.coverage(views.facts(spark, sf_dir))


def _required_and_asserted(spark, sf_dir):
    every = views.facts(spark, sf_dir)
    return every.where("required"), every.where("NOT ambiguous AND NOT required AND confidence > 0.2")


_SETS = "WITH q AS (SELECT DISTINCT key, fact_type FROM v_facts WHERE required), s AS (SELECT DISTINCT key, fact_type FROM v_facts WHERE NOT ambiguous AND NOT required AND confidence > 0.2)"


@query("jn03_missing_required", f"{_SETS} SELECT key, fact_type FROM q ANTI JOIN s USING (key, fact_type)")
def jn03(spark, sf_dir):
    return facts.missing_required(*_required_and_asserted(spark, sf_dir), ["key", "fact_type"])


@query("jn03_represented", f"{_SETS} SELECT count(*) AS checked, count(s.key) AS represented, round(count(s.key) / count(*), 3) AS ratio FROM q LEFT JOIN s USING (key, fact_type)")
def jn03_ratio(spark, sf_dir):
    return facts.represented(*_required_and_asserted(spark, sf_dir), ["key", "fact_type"])


@query(
    "ag04_reconcile",
    f"""{_SETS}, w AS (SELECT *, first_value(value) OVER (PARTITION BY key {_BEST}) AS winner FROM v_facts),
    p AS (SELECT key, list_sort(list_distinct(list(source))) AS p FROM v_facts GROUP BY key)
    SELECT key, CASE WHEN len(p) > 1 THEN 'CONFIRMED' ELSE 'UNCONFIRMED' END AS status, array_to_string(p, ',') AS providers FROM p
    UNION ALL SELECT DISTINCT key, 'MISSING', '' FROM (SELECT key FROM q ANTI JOIN s USING (key, fact_type))
    UNION ALL SELECT DISTINCT key, 'CONFLICT', '' FROM w WHERE value <> winner""",
)
def ag04(spark, sf_dir):
    every = views.facts(spark, sf_dir)
    missing = facts.missing_required(*_required_and_asserted(spark, sf_dir), ["key", "fact_type"])
    return facts.reconcile(every, missing, facts.evidence_conflicts(every))


@query(
    "jn17_contradictions",
    """WITH s AS (SELECT DISTINCT concat_ws('-', key, value) AS entity_key, fact_type FROM v_facts), x(first, second) AS (VALUES ('click', 'error'), ('purchase', 'view'))
    SELECT a.entity_key, x.first, x.second FROM s a JOIN x ON a.fact_type = x.first JOIN s b ON b.entity_key = a.entity_key AND b.fact_type = x.second""",
)
def jn17(spark, sf_dir):
    stated = views.facts(spark, sf_dir).withColumn("entity_key", F.concat_ws("-", "key", "value"))
    return facts.contradictions(stated, spark.createDataFrame(_EXCLUSIVE, "first string, second string"))


@query(
    "so03_union_facts",
    """WITH e AS (SELECT *, 0 AS channel FROM v_facts WHERE source = 'teacher' UNION ALL SELECT *, 1 FROM v_facts WHERE source = 'vision' UNION ALL SELECT *, 2 FROM v_facts WHERE source = 'detection')
    SELECT key, fact_id, channel FROM (SELECT *, row_number() OVER (PARTITION BY key, required ORDER BY channel, fact_id) AS n FROM e) WHERE NOT required OR n = 1""",
)
def so03(spark, sf_dir):
    every = views.facts(spark, sf_dir)
    return facts.union_facts(*(every.where(F.col("source") == s) for s in ("teacher", "vision", "detection")), keys=("key",)).select("key", "fact_id", "channel")


@query(
    "sc09_canonical_keys",
    """WITH e AS (SELECT p_type AS fact_type, [p_brand, p_name, concat('B', p_size % 3), concat('A', p_size % 4)] AS e FROM part)
    SELECT k, count(*) AS n FROM (SELECT concat_ws('|', fact_type, array_to_string(CASE WHEN fact_type = 'STANDARD' THEN list_sort([array_to_string(list_sort(e[1:2]), ''), array_to_string(list_sort(e[3:4]), '')])
        WHEN fact_type IN ('ECONOMY', 'PROMO') THEN list_sort(e) ELSE e END, ',')) AS k FROM e) GROUP BY k""",
)
def sc09(spark, sf_dir):
    entities = F.array("p_brand", "p_name", F.concat(F.lit("B"), F.col("p_size") % 3), F.concat(F.lit("A"), F.col("p_size") % 4))
    key = facts.canonical_key(F.col("p_type"), entities, ("ECONOMY", "PROMO"), ("STANDARD",))
    return read(spark, sf_dir, "part").groupBy(key.alias("k")).agg(F.count("*").alias("n"))


@query(
    "ag35_decide",
    """WITH s AS (SELECT c_custkey AS id, round((c_acctbal + 1000) / 11000, 3) AS v, count(o_orderkey) AS n, count_if(o_orderstatus = 'P') AS p, coalesce(max(o_totalprice), 0) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
    t AS (SELECT id, least(1.0, 0.6 + v * 0.5, CASE WHEN n > 8 THEN 0.95 ELSE 0.9 END) AS plausible, round(least(1.0, n / 12.0), 3) AS coverage, n = 0 OR m > 490000 AS blocked, p FROM s)
    SELECT action, high, count(*) AS n FROM (SELECT CASE WHEN blocked OR plausible < 0.7 THEN 'original' WHEN plausible >= 0.85 THEN 'draft' ELSE 'review' END AS action,
        p < 4 AND least(plausible, coverage) >= 0.94 AND coverage >= 0.9 AS high FROM t) GROUP BY ALL""",
)
def ag35(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.max("o_totalprice").alias("m"))
    rows = read(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").fillna(0, ["n", "p", "m"])
    value = 0.6 + F.round((F.col("c_acctbal") + 1000) / 11000, 3) * 0.5
    scores = rows.select(
        F.lit(1.0).alias("classification"), value.alias("extraction"), F.lit(1.0).alias("validation"), F.lit(1.0).alias("comparison"), F.round(F.least(F.lit(1.0), F.col("n") / 12.0), 3).alias("coverage"),
        F.when(F.col("n") > 8, 0.95).otherwise(0.9).alias("cap"), (F.col("n") > 0).alias("supported"), F.lit(True).alias("valid"), (F.col("m") > 490000).alias("critical"), F.lit(False).alias("unresolved"),
        F.greatest(F.col("p") - 3, F.lit(0)).alias("ai_only"), F.lit(0).alias("contradictions"), F.lit(0).alias("ambiguous"),
    )
    return facts.decide(scores).groupBy("action", "high").agg(F.count("*").alias("n"))
