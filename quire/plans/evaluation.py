"""Queries of the evaluation and table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import evaluation, tables
from quire.plans.registry import query
from quire.sources import views
from quire.sources.tables import read


@query(
    "ag09_category_scores",
    """SELECT user_id, round(coalesce(avg(CASE WHEN event_type = 'click' THEN CASE WHEN value > 100 THEN 1.0 ELSE 0 END END), 1), 6) AS click, round(coalesce(avg(CASE WHEN event_type = 'view' THEN CASE WHEN value > 100 THEN 1.0 ELSE 0 END END), 1), 6) AS view,
        round(coalesce(avg(CASE WHEN event_type = 'error' THEN CASE WHEN value > 100 THEN 1.0 ELSE 0 END END), 1), 6) AS error, least(click, view, error) AS overall FROM events GROUP BY user_id""",
)
def ag09(spark, sf_dir):
    checks = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("category"), (F.col("value") > 100).alias("passed"))
    return evaluation.category_scores(checks, "user_id", ["click", "view", "error"])


_STABLE = "WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), s AS (SELECT p_brand, cast(sum(n) AS BIGINT) AS runs, round(max(n) / sum(n), 6) AS share FROM c GROUP BY p_brand)"


@query("ag10_stability", f"{_STABLE} SELECT * FROM s")
def ag10(spark, sf_dir):
    return evaluation.stability(read(spark, sf_dir, "part"), "p_brand", "p_type")


@query("ag10_verdict", f"{_STABLE} SELECT count(*) AS n, CASE WHEN bool_and(share = 1) THEN 'STABLE' ELSE 'UNSTABLE' END AS verdict FROM s")
def ag10_verdict(spark, sf_dir):
    return evaluation.verdict(evaluation.stability(read(spark, sf_dir, "part"), "p_brand", "p_type"))


@query(
    "ag11_outcomes",
    """WITH r AS (SELECT event_type, event_id % 3 <> 0 AS good, value > 150 AS offered, value > 300 AS accepted FROM events)
    SELECT event_type, count(*) FILTER (good AND accepted) AS PASS, count(*) FILTER (NOT good AND NOT offered) AS CORRECTLY_BLOCKED, count(*) FILTER (NOT good AND offered AND NOT accepted) AS WRONG_OFFERED,
        count(*) FILTER (NOT good AND accepted) AS WRONG_ACCEPTED, count(*) FILTER (good AND NOT accepted) AS OTHER FROM r GROUP BY event_type""",
)
def ag11(spark, sf_dir):
    runs = read(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 3 != 0).alias("right"), (F.col("value") > 150).alias("offered"), (F.col("value") > 300).alias("accepted"))
    return evaluation.outcomes(runs, "event_type")


@query(
    "ag12_label_pr",
    """WITH g AS (SELECT DISTINCT key, value AS label FROM v_facts WHERE source IN ('vision', 'detection')), r AS (SELECT DISTINCT key, value AS label FROM v_facts WHERE source IN ('teacher', 'question_text')),
    b AS (SELECT key, label, g.label AS gl, r.label AS rl FROM g FULL JOIN r USING (key, label))
    SELECT key, round(CASE WHEN count(gl) > 0 THEN count(*) FILTER (gl = rl) / count(gl) ELSE 0 END, 6) AS precision, round(CASE WHEN count(rl) > 0 THEN count(*) FILTER (gl = rl) / count(rl) ELSE 0 END, 6) AS recall,
        coalesce(string_agg(label, ',' ORDER BY label) FILTER (rl IS NULL), '') AS hallucinated FROM b GROUP BY key""",
)
def ag12(spark, sf_dir):
    named = views.facts(spark, sf_dir).select("key", F.col("value").alias("label"), "source")
    return evaluation.label_pr(named.where("source IN ('vision', 'detection')"), named.where("source IN ('teacher', 'question_text')"), "key")


@query(
    "ag26_timing_summary",
    "SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 11 = 0) AS failures, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(sum(value), 4) AS total FROM events GROUP BY event_type",
)
def ag26(spark, sf_dir):
    return evaluation.timing_summary(read(spark, sf_dir, "events").withColumn("failed", F.col("event_id") % 11 == 0), "event_type", "value", "failed")


@query(
    "ag31_gate",
    """WITH i AS (SELECT o_custkey AS c, 'error' AS s FROM orders WHERE o_totalprice > 480000 UNION ALL SELECT o_custkey, 'warning' FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT c_custkey, 'error' FROM customer WHERE c_acctbal < -900)
    SELECT c_custkey, count(*) FILTER (s = 'error') AS errors, count(*) FILTER (s = 'warning') AS warnings, count(*) FILTER (s = 'error') > 0 AS blocked FROM customer LEFT JOIN i ON c = c_custkey GROUP BY c_custkey""",
)
def ag31(spark, sf_dir):
    orders, customers = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), read(spark, sf_dir, "customer")
    issues = [orders.where("o_totalprice > 480000").withColumn("severity", F.lit("error")), orders.where("o_orderstatus = 'P'").withColumn("severity", F.lit("warning")), customers.where("c_acctbal < -900").withColumn("severity", F.lit("error"))]
    return evaluation.gate(issues, customers, "c_custkey")


@query(
    "ag34_unknown_keys",
    """WITH j AS (SELECT CASE WHEN event_id % 4 = 0 THEN concat('{"k": 1, "', event_type, '": "x"}') ELSE props END AS p FROM events), k AS (SELECT p, unnest(json_keys(p)) AS path FROM j)
    SELECT path, count(*) AS n FROM k WHERE path <> 'k' AND coalesce(json_extract_string(p, concat('$.', path)), '') <> '' GROUP BY path""",
)
def ag34(spark, sf_dir):
    drifted = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"k": 1, "'), "event_type", F.lit('": "x"}'))).otherwise(F.col("props"))
    return evaluation.unknown_keys(read(spark, sf_dir, "events").select(drifted.alias("props")), "props", ["k"])


_GRID = "g AS (SELECT item, (seq - 1) // 3 AS r, (seq - 1) % 3 AS c, CASE WHEN seq = 2 THEN CASE WHEN item % 2 = 0 THEN 'count' ELSE 'name' END WHEN (seq - 1) % 3 = 1 AND item % 5 <> 0 THEN cast(vid % 100 AS VARCHAR) ELSE concat(status, vid) END AS text, vid FROM v_versions)"


def _grid(spark, sf_dir):
    at = F.col("seq") - 1
    text = F.when(F.col("seq") == 2, F.when(F.col("item") % 2 == 0, "count").otherwise("name")).when((at % 3 == 1) & (F.col("item") % 5 != 0), (F.col("vid") % 100).cast("string")).otherwise(F.concat("status", "vid"))
    return views.versions(spark, sf_dir).select("item", F.floor(at / 3).alias("r"), (at % 3).alias("c"), text.alias("text"), "vid")


@query(
    "ag23_frequency_model",
    f"""WITH {_GRID}, h AS (SELECT item, c FROM g WHERE r = 0 AND regexp_matches(lower(text), '^(count|frequency|n)$')), n AS (SELECT g.* FROM g JOIN h USING (item, c) WHERE r > 0),
    o AS (SELECT item, c FROM n GROUP BY ALL HAVING bool_and(regexp_matches(text, '^-?[0-9]+([.][0-9]+)?$'))) SELECT item, v.text AS value, cast(n.text AS DOUBLE) AS frequency FROM n JOIN o USING (item, c) JOIN g v ON v.item = n.item AND v.r = n.r AND v.c = 0""",
)
def ag23(spark, sf_dir):
    return tables.frequency_model(_grid(spark, sf_dir), "item", "^(count|frequency|n)$")


@query(
    "ag37_table_issues",
    f"""WITH {_GRID}, w AS (SELECT item, r, count(*) AS w FROM g GROUP BY ALL), s AS (SELECT item, count(DISTINCT w) AS d, count(*) AS n FROM w GROUP BY item)
    SELECT item, 'ragged' AS issue FROM s WHERE d > 1 UNION ALL SELECT item, 'headers' FROM s WHERE n <= 2 UNION ALL SELECT DISTINCT item, 'value' FROM g WHERE try_cast(text AS DOUBLE) <> vid % 100 + CASE WHEN vid % 17 = 0 THEN 1 ELSE 0 END""",
)
def ag37(spark, sf_dir):
    stored = F.col("vid") % 100 + F.when(F.col("vid") % 17 == 0, 1).otherwise(0)
    return tables.table_issues(_grid(spark, sf_dir).withColumn("value", stored.cast("double")), "item", 2)


_VIEWS = """SELECT scene, 'top' AS view, x AS a, y AS b, max(z) + 1 AS height, count(*) AS n FROM {v} GROUP BY ALL UNION ALL SELECT scene, 'front', x, z, max(z) + 1, count(*) FROM {v} GROUP BY ALL
    UNION ALL SELECT scene, 'side', y, z, max(z) + 1, count(*) FROM {v} GROUP BY ALL UNION ALL SELECT scene, 'all', -1, -1, max(z) + 1, count(*) FROM {v} GROUP BY ALL"""


@query("ag28_projections", _VIEWS.format(v="v_voxels"))
def ag28(spark, sf_dir):
    return tables.projections(views.voxels(spark, sf_dir), "scene")


@query(
    "so01_delta",
    """WITH r AS (SELECT scene, count(*) AS removed FROM (FROM v_voxels EXCEPT ALL FROM v_after) GROUP BY scene), a AS (SELECT scene, count(*) AS added FROM (FROM v_after EXCEPT ALL FROM v_voxels) GROUP BY scene),
    k AS (SELECT scene FROM v_voxels UNION SELECT scene FROM v_after), j AS (SELECT scene, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed FROM k LEFT JOIN a USING (scene) LEFT JOIN r USING (scene))
    SELECT *, CASE WHEN added = 0 AND removed = 0 THEN 'UNCHANGED' WHEN removed = 0 THEN 'ADDED' WHEN added = 0 THEN 'REMOVED' ELSE 'MIXED_DELTA' END AS class FROM j""",
)
def so01(spark, sf_dir):
    return tables.delta(views.voxels(spark, sf_dir), views.voxels_after(spark, sf_dir), "scene")


@query(
    "so02_view_impact",
    f"""WITH p AS ({_VIEWS.format(v="v_voxels")}), q AS ({_VIEWS.format(v="v_after")}), a AS (SELECT scene, view, a, b, height FROM p), b AS (SELECT scene, view, a, b, height FROM q),
    d AS (SELECT DISTINCT scene, view FROM ((FROM a EXCEPT ALL FROM b) UNION ALL (FROM b EXCEPT ALL FROM a))), k AS (SELECT scene, view FROM a WHERE view <> 'all' UNION SELECT scene, view FROM b WHERE view <> 'all')
    SELECT scene, view, d.scene IS NOT NULL AS changed FROM k LEFT JOIN d USING (scene, view)""",
)
def so02(spark, sf_dir):
    return tables.view_impact(views.voxels(spark, sf_dir), views.voxels_after(spark, sf_dir), "scene")


@query(
    "so06_inventory_diff",
    """WITH s AS (SELECT DISTINCT p_size AS fig, concat(substr(p_brand, 7), p_partkey % 20) AS label FROM part WHERE p_partkey % 3 <> 0), t AS (SELECT DISTINCT p_size AS fig, concat(substr(p_brand, 7), p_partkey % 20) AS label FROM part WHERE p_partkey % 4 <> 0)
    SELECT fig, label, 'source' AS side FROM s ANTI JOIN t USING (fig, label) UNION ALL SELECT fig, label, 'spec' FROM t ANTI JOIN s USING (fig, label)""",
)
def so06(spark, sf_dir):
    named = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("fig"), F.concat(F.substring("p_brand", 7, 9), F.col("p_partkey") % 20).alias("label"))
    spec = named.where("p_partkey % 4 <> 0").withColumn("label", F.concat("label", F.lit("'")))
    return tables.inventory_diff(named.where("p_partkey % 3 <> 0"), spec, "fig")
