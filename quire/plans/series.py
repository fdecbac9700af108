"""Queries of the series and point operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import series
from quire.plans.registry import query
from quire.sources import views
from quire.sources.tables import read


def _runs(condition: str) -> str:
    return f"""WITH n AS (SELECT *, coalesce({condition}, false) AS ok, row_number() OVER (PARTITION BY sid ORDER BY x) AS n FROM v_series), h AS (SELECT *, n - row_number() OVER (PARTITION BY sid ORDER BY x) AS run FROM n WHERE ok),
    i AS (SELECT sid, min(x) AS begin, max(x) AS "end", count(*) AS n FROM h GROUP BY sid, run)"""


@query(
    "wn04_islands",
    """WITH b AS (SELECT page, y0, CASE WHEN coalesce(y0 - lag(y0) OVER (PARTITION BY page ORDER BY y0) > 6, true) THEN 1 ELSE 0 END AS b FROM (SELECT DISTINCT page, y0 FROM v_boxes)),
    i AS (SELECT *, cast(sum(b) OVER (PARTITION BY page ORDER BY y0) AS BIGINT) AS island FROM b) SELECT page, island, min(y0) AS low, max(y0) AS high, round(avg(y0), 6) AS centre, count(*) AS n FROM i GROUP BY ALL""",
)
def wn04(spark, sf_dir):
    return series.islands(views.boxes(spark, sf_dir).select("page", "y0").distinct(), "page", "y0", 6)


@query("wn05_longest_run", f"{_runs('y > 0')} SELECT sid, begin, n FROM i QUALIFY row_number() OVER (PARTITION BY sid ORDER BY n DESC, begin) = 1")
def wn05(spark, sf_dir):
    return series.longest_run(views.series(spark, sf_dir), "sid", F.col("y") > 0)


@query("wn17_intervals", f'{_runs("y > -100")} SELECT sid, begin, "end", n FROM i')
def wn17(spark, sf_dir):
    return series.intervals(views.series(spark, sf_dir), "sid", F.col("y") > -100)


@query(
    "wn06_regular_spacing",
    """WITH g AS (SELECT o_custkey AS c, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS g FROM orders), m AS (SELECT c, g, quantile_cont(g, 0.5) OVER (PARTITION BY c) AS m FROM g WHERE g IS NOT NULL)
    SELECT c, count(*) AS gaps, max(m) AS median, round(max(abs(g - m)), 6) AS worst, round(max(abs(g - m)), 6) <= 0.06 * max(m) + 1.5 AS stable FROM m GROUP BY c""",
)
def wn06(spark, sf_dir):
    return series.regular_spacing(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), "o_orderkey"), "c", "o_orderkey")


@query(
    "wn15_crossings",
    """WITH l AS (SELECT *, lag(y) OVER w AS py, lag(x) OVER w AS px FROM v_series WINDOW w AS (PARTITION BY sid ORDER BY x))
    SELECT sid, round(px + (x - px) * py / (py - y), 6) AS x FROM l WHERE py * y < 0 AND abs(y - py) <= 400 UNION ALL SELECT sid, cast(x AS DOUBLE) FROM v_series WHERE y = 0""",
)
def wn15(spark, sf_dir):
    return series.crossings(views.series(spark, sf_dir), pole=400)


@query(
    "wn16_extrema",
    """WITH d AS (SELECT *, y - lag(y) OVER w AS a, lead(y) OVER w - y AS b FROM v_series WINDOW w AS (PARTITION BY sid ORDER BY x))
    SELECT sid, x, y, CASE WHEN a > 0 THEN 'max' ELSE 'min' END AS kind FROM d WHERE a > 0 AND b < 0 OR a < 0 AND b > 0""",
)
def wn16(spark, sf_dir):
    return series.extrema(views.series(spark, sf_dir))


@query(
    "wn18_branches",
    """WITH b AS (SELECT *, CASE WHEN y IS NULL OR lag(y) OVER w IS NULL OR abs(y - lag(y) OVER w) > 250 THEN 1 ELSE 0 END AS b FROM v_series WINDOW w AS (PARTITION BY sid ORDER BY x)),
    n AS (SELECT *, cast(sum(b) OVER (PARTITION BY sid ORDER BY x) AS BIGINT) AS branch FROM b) SELECT sid, branch, min(x) AS begin, max(x) AS "end", count(*) AS n FROM n WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 3""",
)
def wn18(spark, sf_dir):
    return series.branches(views.series(spark, sf_dir), "sid", 250)


@query(
    "wn19_landmark_issues",
    """WITH k AS (SELECT sid, x, y, CASE WHEN x % 5 = 0 THEN 'intercept' WHEN x % 2 = 0 THEN 'extremum' ELSE 'point' END AS kind FROM v_series WHERE y IS NOT NULL),
    d AS (SELECT *, lag(y) OVER w * y < 0 AS f, (y - lag(y) OVER w) * (lead(y) OVER w - y) < 0 AND kind <> 'extremum' AS t FROM k WINDOW w AS (PARTITION BY sid ORDER BY x))
    SELECT sid, count(*) FILTER (f) AS flips, count(*) FILTER (kind = 'intercept') AS marked, count(*) FILTER (t) AS turns, count(*) FILTER (f) > count(*) FILTER (kind = 'intercept') AS forced, count(*) FILTER (t) > 0 AS unmarked_turn FROM d GROUP BY sid""",
)
def wn19(spark, sf_dir):
    kind = F.when(F.col("x") % 5 == 0, "intercept").when(F.col("x") % 2 == 0, "extremum").otherwise("point")
    return series.landmark_issues(views.series(spark, sf_dir).where("y IS NOT NULL").withColumn("kind", kind), "sid")



@query("wn20_symmetry", "WITH m AS (SELECT sid, x, y FROM v_series WHERE y IS NOT NULL) SELECT sid, count(*) AS pairs, ['even', 'odd', 'none'][sid % 3 + 1] AS symmetry FROM m GROUP BY sid")
def wn20(spark, sf_dir):
    a = views.series(spark, sf_dir)
    y = F.when(F.col("sid") % 3 == 0, F.col("y")).when(F.col("sid") % 3 == 1, -F.col("y")).otherwise(F.col("y") + F.col("x") + 1000)
    return series.symmetry(a.unionByName(a.select("sid", (-F.col("x")).alias("x"), y.alias("y"))), "sid", 1e-6)


@query(
    "ag18_calibrate",
    """WITH t AS (SELECT p_brand AS k, cast(p_size AS DOUBLE) AS pixel, CASE WHEN p_brand = 'Brand#1' THEN abs(p_size - 20) * 2.0 WHEN p_brand = 'Brand#2' THEN (p_size % 7) * 3.0 ELSE p_size * 0.5 + 3 END AS value FROM part),
    z AS (SELECT k, min(pixel) FILTER (value = 0) AS z FROM t GROUP BY k), u AS (SELECT k, pixel, value, false AS flipped FROM t UNION ALL SELECT k, pixel, CASE WHEN pixel < z THEN -abs(value) ELSE value END, true FROM t JOIN z USING (k)),
    f AS (SELECT k, flipped, regr_slope(value, pixel) AS s, regr_intercept(value, pixel) AS i, regr_r2(value, pixel) AS r FROM u GROUP BY ALL)
    SELECT k, round(s, 6) AS slope, round(i, 6) AS intercept, round(r, 6) AS r2, flipped, r >= 0.999 AS ok FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY NOT r >= 0.999, flipped) = 1""",
)
def ag18(spark, sf_dir):
    size = F.col("p_size")
    value = F.when(F.col("p_brand") == "Brand#1", F.abs(size - 20) * 2.0).when(F.col("p_brand") == "Brand#2", (size % 7) * 3.0).otherwise(size * 0.5 + 3)
    return series.calibrate(read(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), size.cast("double").alias("pixel"), value.alias("value")), "k")


@query(
    "ag19_affine_fit",
    """WITH r AS (SELECT l_suppkey AS k, l_quantity AS x, l_discount * 100 AS y, l_extendedprice AS u FROM lineitem), m AS (SELECT k, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu FROM r GROUP BY k),
    s AS (SELECT k, n, mx, my, mu, sum((x - mx) ** 2) AS xx, sum((x - mx) * (y - my)) AS xy, sum((y - my) ** 2) AS yy, sum((x - mx) * (u - mu)) AS xu, sum((y - my) * (u - mu)) AS yu FROM r JOIN m USING (k) GROUP BY ALL),
    t AS (SELECT *, (xu * yy - yu * xy) / (xx * yy - xy * xy) AS a, (yu * xx - xu * xy) / (xx * yy - xy * xy) AS b FROM s WHERE n >= 3) SELECT k, n, round(a, 6) AS a, round(b, 6) AS b, round(mu - a * mx - b * my, 6) AS c FROM t""",
)
def ag19(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), F.col("l_extendedprice").alias("u"))
    return series.affine_fit(rows, "k")


_BINS = [0.0, 10.0, 25.0, 100.0, 250.0, 500.0]


@query(
    "ag20_histogram",
    """WITH b(bin, low, high) AS (VALUES (0, 0.0, 10.0), (1, 10.0, 25.0), (2, 25.0, 100.0), (3, 100.0, 250.0), (4, 250.0, 500.0))
    SELECT event_type, bin, cast(low AS DOUBLE) AS low, cast(high AS DOUBLE) AS high, count(*) AS n FROM events JOIN b ON value >= low AND (value < high OR bin = 4 AND value = high) GROUP BY ALL""",
)
def ag20(spark, sf_dir):
    return series.histogram(read(spark, sf_dir, "events"), "event_type", "value", _BINS)


@query(
    "ag21_shares",
    """WITH s AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, round(sum(c_acctbal), 2) AS v FROM customer GROUP BY ALL), t AS (SELECT *, sum(v) OVER w > 0 AND min(v) OVER w >= 0 AS ok, sum(v) OVER w AS t FROM s WINDOW w AS (PARTITION BY nation))
    SELECT nation, segment, round(CASE WHEN ok THEN v / t END, 6) AS share, ok FROM t""",
)
def ag21(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.round(F.sum("c_acctbal"), 2).alias("v"))
    return series.shares(rows, "nation", "segment", "v")


_REGIONS = """WITH s AS (SELECT o_custkey % 50 AS k, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY ALL),
    r AS (SELECT k, n, greatest(0, least(5, cast(floor((o_totalprice - m) / s * 2) AS BIGINT) + 3)) AS region FROM orders JOIN s ON o_custkey % 50 = k), p AS (SELECT k, region, round(count(*) / n, 6) AS share FROM r GROUP BY k, region, n)"""


def _priced(spark, sf_dir):
    return read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("k"), "o_totalprice")


@query("ag22_sigma_regions", f"{_REGIONS} SELECT k, region, share FROM p")
def ag22(spark, sf_dir):
    return series.sigma_regions(_priced(spark, sf_dir), "k", "o_totalprice", 6)


@query(
    "ag22_symmetric",
    f"{_REGIONS}, q AS (SELECT k, 5 - region AS region, share AS o FROM p) SELECT k, bool_and(abs(coalesce(share, 0) - coalesce(o, 0)) <= 0.05) AS symmetric FROM p FULL JOIN q USING (k, region) GROUP BY k",
)
def ag22_symmetric(spark, sf_dir):
    return series.symmetric(series.sigma_regions(_priced(spark, sf_dir), "k", "o_totalprice", 6), "k", 6, 0.05)


@query(
    "ag24_otsu",
    """WITH b AS (SELECT lang, n_chars % 256 AS level, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT lang, level, sum(n) OVER u AS w, sum(n * level) OVER u AS s, sum(n) OVER p AS t, sum(n * level) OVER p AS ts FROM b WINDOW p AS (PARTITION BY lang), u AS (PARTITION BY lang ORDER BY level)),
    v AS (SELECT lang, level, round(cast(w AS DOUBLE) * (t - w) * (s / w - (ts - s) / (t - w)) * (s / w - (ts - s) / (t - w)), 4) AS v FROM s WHERE w < t) SELECT lang, level AS threshold FROM v QUALIFY row_number() OVER (PARTITION BY lang ORDER BY v DESC, level) = 1""",
)
def ag24(spark, sf_dir):
    return series.otsu(read(spark, sf_dir, "documents").select("lang", (F.col("n_chars") % 256).alias("level_of")), "lang", "level_of")


@query(
    "ag30_kind_summary",
    """WITH d AS (SELECT *, y - lag(y) OVER w AS a, lead(y) OVER w - y AS b FROM v_series WINDOW w AS (PARTITION BY sid ORDER BY x)), e AS (SELECT sid, CASE WHEN a > 0 THEN 'max' ELSE 'min' END AS kind, concat('P', lpad(cast(x AS VARCHAR), 6, '0')) AS label FROM d WHERE a > 0 AND b < 0 OR a < 0 AND b > 0)
    SELECT sid, count(*) FILTER (kind = 'max') AS maxima, count(*) FILTER (kind = 'min') AS minima, string_agg(label, ',' ORDER BY label) AS labels FROM e GROUP BY sid""",
)
def ag30(spark, sf_dir):
    label = F.concat(F.lit("P"), F.lpad(F.col("x").cast("string"), 6, "0"))
    return series.kind_summary(series.extrema(views.series(spark, sf_dir)).withColumn("label", label), "sid")


_SHAPES = """WITH b AS (SELECT panel, CASE panel % 3 WHEN 0 THEN x WHEN 1 THEN -x ELSE x * 0.3 + 20 END AS x, CASE panel % 3 WHEN 2 THEN y + pid % 7 * 400 ELSE y END AS y FROM v_points), a AS (SELECT panel, x, y FROM v_points), m AS (SELECT panel, avg(x) AS mx, avg(y) AS my FROM a GROUP BY panel),
    s AS (SELECT panel, t, avg(CASE WHEN x >= mx AND y >= my THEN 1.0 ELSE 0 END) AS q0, avg(CASE WHEN x >= mx AND y < my THEN 1.0 ELSE 0 END) AS q1, avg(CASE WHEN x < mx AND y >= my THEN 1.0 ELSE 0 END) AS q2, avg(CASE WHEN x < mx AND y < my THEN 1.0 ELSE 0 END) AS q3, corr(x, y) AS c
        FROM (SELECT *, 'a' AS t FROM a UNION ALL SELECT *, 'b' FROM b) JOIN m USING (panel) GROUP BY ALL),
    p AS (SELECT a.panel, CASE WHEN a.q0 >= .2 AND b.q0 <= .02 OR b.q0 >= .2 AND a.q0 <= .02 OR a.q1 >= .2 AND b.q1 <= .02 OR b.q1 >= .2 AND a.q1 <= .02 OR a.q2 >= .2 AND b.q2 <= .02 OR b.q2 >= .2 AND a.q2 <= .02 OR a.q3 >= .2 AND b.q3 <= .02 OR b.q3 >= .2 AND a.q3 <= .02
        OR a.c * b.c < 0 AND abs(a.c - b.c) >= 0.5 THEN 'MISMATCH' WHEN greatest(abs(a.q0 - b.q0), abs(a.q1 - b.q1), abs(a.q2 - b.q2), abs(a.q3 - b.q3)) > 0.35 THEN 'LOW_CONFIDENCE' ELSE 'OK' END AS status FROM s a JOIN s b ON a.panel = b.panel AND a.t = 'a' AND b.t = 'b')"""


def _panels(spark, sf_dir):
    a = views.points(spark, sf_dir)
    kind = F.col("panel") % 3
    x = F.when(kind == 0, F.col("x")).when(kind == 1, -F.col("x")).otherwise(F.col("x") * 0.3 + 20)
    b = a.select("panel", x.alias("x"), F.when(kind == 2, F.col("y") + F.col("pid") % 7 * 400).otherwise(F.col("y")).alias("y"))
    return series.distribution_fidelity(a, b, "panel")


@query("ag36_distribution_fidelity", f"{_SHAPES} SELECT panel, status FROM p")
def ag36(spark, sf_dir):
    return _panels(spark, sf_dir)


@query("ag36_worst_panel", f"{_SHAPES} SELECT panel // 3 AS figure, arg_max(status, CASE status WHEN 'MISMATCH' THEN 2 WHEN 'LOW_CONFIDENCE' THEN 1 ELSE 0 END) AS status FROM p GROUP BY ALL")
def ag36_worst(spark, sf_dir):
    return series.worst(_panels(spark, sf_dir).withColumn("figure", F.floor(F.col("panel") / 3)), "figure")
