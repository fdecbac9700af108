"""Queries of the scoring operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import score
from quire.plans.registry import query
from quire.sources import views

_TOTALS = """WITH g AS (SELECT qid, grp, max(k) * max(points) AS best, count(*) AS n, max(k) AS k, min(points) AS lo, max(points) AS hi FROM v_sections WHERE grp <> '' GROUP BY ALL),
    o AS (SELECT qid, sum(best) AS optional, sum(k) AS asked, count(*) AS groups FROM g GROUP BY qid),
    m AS (SELECT qid, coalesce(sum(points) FILTER (grp = ''), 0) AS mandatory, max(total) AS total FROM v_sections GROUP BY qid),
    t AS (SELECT qid, cast(mandatory AS DOUBLE) AS mandatory, cast(coalesce(optional, 0) AS DOUBLE) AS optional, cast(mandatory + coalesce(optional, 0) AS DOUBLE) AS answered, cast(total AS DOUBLE) AS total,
        coalesce(asked, 0) AS asked, coalesce(groups, 0) AS groups FROM m LEFT JOIN o USING (qid))"""


def _doubles(df, *names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


@query("ag06_answered_total", f"{_TOTALS} SELECT qid, mandatory, optional, answered FROM t")
def ag06(spark, sf_dir):
    return _doubles(score.answered_total(views.sections(spark, sf_dir)), "mandatory", "optional", "answered")


@query(
    "ag07_score_issues",
    f"""{_TOTALS} SELECT qid, grp, 'no_choice' AS issue FROM g WHERE n <= k UNION ALL SELECT qid, grp, 'unequal_options' FROM g WHERE lo <> hi
    UNION ALL SELECT qid, '', 'total_mismatch' FROM t WHERE abs(answered - total) > 0.02 * greatest(1, asked)""",
)
def ag07(spark, sf_dir):
    return score.score_issues(views.sections(spark, sf_dir))


@query(
    "ag07_rubric_issues",
    """WITH s AS (SELECT qid, sec, cast(rubric_pct AS DOUBLE) AS rubric_pct, round(20 + 80 * cast(points AS DOUBLE) / sum(cast(points AS DOUBLE)) OVER (PARTITION BY qid), 4) AS target FROM v_sections)
    SELECT * FROM s WHERE abs(rubric_pct - target) > 0.5""",
)
def ag07_rubric(spark, sf_dir):
    rows = score.rubric_issues(_doubles(views.sections(spark, sf_dir), "points"), F.lit(20.0))
    return _doubles(rows.select("qid", "sec", "rubric_pct", "target"), "rubric_pct")


@query("ag08_route_check", f"{_TOTALS} SELECT qid, answered AS route, groups AS asked, abs(answered - 100) <= greatest(0.02, 0.005 * groups + 0.001) AS ok FROM t")
def ag08(spark, sf_dir):
    return _doubles(score.route_check(views.sections(spark, sf_dir)), "route")


@query(
    "ag32_completeness",
    """WITH s AS (SELECT qid, sec, points, CASE WHEN sec % 3 = 0 THEN ' ' ELSE 'x' END AS answer FROM v_sections WHERE sec % 4 <> 3),
    r AS (SELECT qid, sec, CASE WHEN sec % 5 = 0 THEN points + 1 ELSE points END AS given FROM v_sections WHERE sec < 7)
    SELECT v.qid, v.sec, s.qid IS NULL AS no_solution, coalesce(trim(answer) = '', false) AS empty_answer, r.qid IS NULL OR abs(given - v.points) > 0.05 AS rubric_off
    FROM v_sections v LEFT JOIN s USING (qid, sec) LEFT JOIN r USING (qid, sec)""",
)
def ag32(spark, sf_dir):
    sections = views.sections(spark, sf_dir)
    solutions = sections.where("sec % 4 <> 3").select("qid", "sec", F.when(F.col("sec") % 3 == 0, " ").otherwise("x").alias("answer"))
    rubric = sections.where("sec < 7").select("qid", "sec", F.when(F.col("sec") % 5 == 0, F.col("points") + 1).otherwise(F.col("points")).alias("points"))
    return score.completeness(sections, solutions, rubric)


@query(
    "wn07_allocate",
    """WITH p AS (SELECT qid, sec, total, CASE WHEN qid % 2 = 0 THEN round(100 * cast(points AS DOUBLE) / sum(cast(points AS DOUBLE)) OVER (PARTITION BY qid), 0) ELSE rubric_pct END AS pct FROM v_sections),
    c AS (SELECT qid, sec, total, cast(pct AS DECIMAL(18,2)) AS pct, lead(sec) OVER (PARTITION BY qid ORDER BY sec) IS NULL AS last FROM p),
    d AS (SELECT *, cast(round(total * pct / 100, 2) AS DECIMAL(18,2)) AS cents FROM c)
    SELECT qid, sec, cast(CASE WHEN last AND abs(sum(pct) OVER (PARTITION BY qid) - 100) <= 0.02 THEN total - (sum(cents) OVER (PARTITION BY qid) - cents) ELSE cents END AS DOUBLE) AS amount FROM d""",
)
def wn07(spark, sf_dir):
    rows = _doubles(views.sections(spark, sf_dir), "points")
    share = F.round(100 * F.col("points") / F.expr("sum(points) OVER (PARTITION BY qid)"), 0)
    rows = rows.withColumn("pct", F.when(F.col("qid") % 2 == 0, share).otherwise(F.col("rubric_pct").cast("double")).cast(score.CENTS))
    return _doubles(score.allocate(rows, "qid", "sec", "total", "pct").select("qid", "sec", "amount"), "amount")


@query(
    "wn07_split_evenly",
    """WITH s AS (SELECT qid, sec, total + 1 AS total, count(*) OVER (PARTITION BY qid) AS n, lead(sec) OVER (PARTITION BY qid ORDER BY sec) IS NULL AS last FROM v_sections),
    t AS (SELECT *, cast(round(cast(total AS DOUBLE) / n + 1e-9, 2) AS DECIMAL(18,2)) AS share FROM s)
    SELECT qid, sec, cast(CASE WHEN last THEN total - share * (n - 1) ELSE share END AS DOUBLE) AS amount FROM t""",
)
def wn07_even(spark, sf_dir):
    rows = views.sections(spark, sf_dir).withColumn("total", (F.col("total") + 1).cast(score.CENTS))
    return _doubles(score.split_evenly(rows, "qid", "sec", "total").select("qid", "sec", "amount"), "amount")


_POINTS = """w AS (SELECT *, CASE WHEN grp = '' THEN cast(points AS DOUBLE) ELSE avg(cast(points AS DOUBLE)) OVER (PARTITION BY qid, grp) END AS weight, count(*) OVER (PARTITION BY qid, grp) AS n FROM v_sections),
    a AS (SELECT *, sum(CASE WHEN grp = '' THEN weight ELSE weight * k / n END) OVER (PARTITION BY qid) AS a FROM w),
    r AS (SELECT *, cast(round(weight * cast(total AS DOUBLE) / a + 1e-9, 2) AS DECIMAL(18,2)) AS raw, lead(sec) OVER (PARTITION BY qid ORDER BY sec) IS NULL AND max(grp) OVER (PARTITION BY qid) = '' AS last FROM a),
    p AS (SELECT qid, sec, cast(CASE WHEN last THEN total - (sum(raw) OVER (PARTITION BY qid) - raw) ELSE raw END AS DOUBLE) AS new_points FROM r)"""


@query("wn08_rebalance", f"WITH {_POINTS} SELECT * FROM p")
def wn08(spark, sf_dir):
    return _doubles(score.rebalance(views.sections(spark, sf_dir)).select("qid", "sec", "new_points"), "new_points")


@query(
    "wn08_rubric",
    f"""WITH {_POINTS}, t AS (SELECT qid, sec, step, cast(CASE WHEN qid % 11 = 0 AND sec % 2 = 0 THEN 0 ELSE rubric_pct * step END AS DECIMAL(18,2)) AS pct FROM v_sections, (SELECT unnest([1, 2]) AS step) WHERE qid % 7 <> 0
        UNION ALL SELECT DISTINCT qid, 0, 1, cast(10 * (qid % 8) AS DECIMAL(18,2)) FROM v_sections WHERE qid % 3 = 0),
    q AS (SELECT qid, max(grp) <> '' AS grouped, cast(max(total) AS DOUBLE) AS total FROM v_sections GROUP BY qid),
    x AS (SELECT t.*, grouped, total, new_points, sum(cast(pct AS DOUBLE)) OVER (PARTITION BY t.qid) AS s, sum(CASE WHEN new_points IS NULL THEN cast(pct AS DOUBLE) ELSE 0 END) OVER (PARTITION BY t.qid) AS g, count(new_points) OVER (PARTITION BY t.qid) AS known,
        sum(cast(pct AS DOUBLE)) OVER (PARTITION BY t.qid, t.sec) AS own, count(*) OVER (PARTITION BY t.qid, t.sec) AS n, lead(step) OVER (PARTITION BY t.qid ORDER BY t.sec, step) IS NULL AS last FROM t LEFT JOIN p USING (qid, sec) LEFT JOIN q USING (qid)),
    y AS (SELECT *, cast(round(100 * cast(pct AS DOUBLE) / nullif(s, 0) + 1e-9, 2) AS DECIMAL(18,2)) AS new, (100 - least(g, 50)) * new_points / total AS share, NOT grouped OR known = 0 AS whole FROM x)
    SELECT qid, sec, step, cast(CASE WHEN whole AND s > 0 THEN CASE WHEN last THEN 100 - (sum(new) OVER (PARTITION BY qid) - new) ELSE new END WHEN whole OR new_points IS NULL THEN pct
        ELSE cast(round(CASE WHEN own > 0 THEN share * cast(pct AS DOUBLE) / own ELSE share / n END + 1e-9, 2) AS DECIMAL(18,2)) END AS DOUBLE) AS new_pct FROM y""",
)
def wn08_rubric(spark, sf_dir):
    sections = score.rebalance(views.sections(spark, sf_dir))
    pct = F.when((F.col("qid") % 11 == 0) & (F.col("sec") % 2 == 0), F.lit(0)).otherwise(F.col("rubric_pct") * F.col("step"))
    own = sections.where("qid % 7 <> 0").withColumn("step", F.explode(F.array(F.lit(1), F.lit(2)))).select("qid", "sec", "step", pct.cast(score.CENTS).alias("pct"))
    general = sections.where("qid % 3 = 0").select("qid").distinct().select("qid", F.lit(0).alias("sec"), F.lit(1).alias("step"), (10 * (F.col("qid") % 8)).cast(score.CENTS).alias("pct"))
    return _doubles(score.rebalance_rubric(sections, own.unionByName(general)).select("qid", "sec", "step", "new_pct"), "new_pct")


@query(
    "wn28_contiguous",
    """SELECT qid, grp, count(*) AS n, max(sec) - min(sec) + 1 = count(*) AS ok,
        CASE WHEN max(sec) - min(sec) + 1 = count(*) THEN '' ELSE string_agg(sec, ',' ORDER BY sec) END AS positions FROM v_sections WHERE grp <> '' GROUP BY qid, grp""",
)
def wn28(spark, sf_dir):
    return score.contiguous(views.sections(spark, sf_dir))
