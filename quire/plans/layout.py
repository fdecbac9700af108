"""Queries of the page layout operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import layout
from quire.plans.registry import query
from quire.sources import views
from quire.sources.tables import read


@query(
    "prj06_clean_boxes",
    """WITH b AS (SELECT page, box_id, x0 * 2 - 300 AS x0, y0 AS y0, CASE WHEN box_id % 10 = 0 THEN x0 * 2 - 310 ELSE x1 * 2 - 300 END AS x1, y1 AS y1, box_id % 13 / 10.0 - 0.1 AS confidence FROM v_boxes),
    c AS (SELECT page, box_id, greatest(0, least(1000, x0)) AS a, greatest(0, least(1000, y0)) AS b, greatest(0, least(1000, x1)) AS c, greatest(0, least(1000, y1)) AS d, least(x0, y0, x1, y1) < 0 OR greatest(x0, y0, x1, y1) > 1000 AS o, confidence FROM b),
    r AS (SELECT *, CASE WHEN c <= a OR d <= b THEN 'invalid' WHEN o THEN 'clamped' ELSE 'ok' END AS reason FROM c)
    SELECT reason, count(*) AS n, cast(coalesce(sum(CASE WHEN reason <> 'invalid' THEN a + b + c + d END), 0) AS BIGINT) AS total, round(sum(greatest(0.0, least(1.0, confidence))), 3) AS confidence FROM r GROUP BY reason""",
)
def prj06(spark, sf_dir):
    x1 = F.when(F.col("box_id") % 10 == 0, F.col("x0") * 2 - 310).otherwise(F.col("x1") * 2 - 300)
    boxes = views.boxes(spark, sf_dir).select("page", "box_id", (F.col("x0") * 2 - 300).alias("x0"), "y0", x1.alias("x1"), "y1", (F.col("box_id") % 13 / 10.0 - 0.1).alias("confidence"))
    cleaned = layout.clean_boxes(boxes)
    return cleaned.groupBy("reason").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("x0") + F.col("y0") + F.col("x1") + F.col("y1")), F.lit(0)).alias("total"), F.round(F.sum("confidence"), 3).alias("confidence"))


@query("ag16_bbox_union", "SELECT page, box_id % 4 AS part, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM v_boxes GROUP BY ALL")
def ag16(spark, sf_dir):
    return layout.bbox_union(views.boxes(spark, sf_dir).withColumn("part", F.col("box_id") % 4), ["page", "part"])


@query(
    "ag17_lattice_filter",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 37 AS len FROM lineitem), c AS (SELECT cast(round(len) AS BIGINT) AS l FROM s GROUP BY 1 HAVING count(*) >= 40), d AS (SELECT DISTINCT unnest([l - 1, l, l + 1]) AS l FROM c)
    SELECT count(*) AS n, round(sum(len), 2) AS total FROM s WHERE cast(round(len) AS BIGINT) NOT IN (FROM d)""",
)
def ag17(spark, sf_dir):
    strokes = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 37).alias("len"))
    return layout.lattice_filter(strokes, 40, "len").agg(F.count("*").alias("n"), F.round(F.sum("len"), 2).alias("total"))


@query(
    "ag29_robust_filter",
    """WITH m AS (SELECT page, quantile_cont(y1 - y0, 0.5) AS m FROM v_boxes GROUP BY page)
    SELECT page, box_id FROM v_boxes JOIN m USING (page) WHERE y1 - y0 >= 0.45 * m AND y1 - y0 <= 5 * m AND x1 - x0 >= 1.2 * (y1 - y0)""",
)
def ag29(spark, sf_dir):
    return layout.robust_filter(views.boxes(spark, sf_dir)).select("page", "box_id")


@query(
    "ag29_alignment_edge",
    "WITH w AS (SELECT page, avg(x1 - x0) AS w FROM v_boxes GROUP BY page) SELECT page, round(quantile_cont(x1, 0.8), 6) AS edge FROM v_boxes JOIN w USING (page) WHERE x1 - x0 >= w GROUP BY page",
)
def ag29_edge(spark, sf_dir):
    return layout.alignment_edge(views.boxes(spark, sf_dir))


@query("st01_reading_order", "SELECT page, box_id, row_number() OVER (PARTITION BY page ORDER BY round(y0 / 40), x0 DESC, box_id) AS place FROM v_boxes")
def st01(spark, sf_dir):
    return layout.reading_order(views.boxes(spark, sf_dir)).select("page", "box_id", "place")


@query("st02_top1", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def st02(spark, sf_dir):
    return layout.top1(read(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "wn03_visual_lines",
    """WITH RECURSIVE f AS (SELECT page, x0 - 2 AS fx0, y0 - 2 AS fy0, x1 + 62 AS fx1, y1 + 42 AS fy1 FROM v_boxes WHERE box_id % 17 = 0), w AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS c FROM v_boxes WHERE box_id % 17 <> 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY c, box_id) AS i FROM w WHERE NOT EXISTS (FROM f WHERE f.page = w.page AND cx BETWEEN fx0 AND fx1 AND c BETWEEN fy0 AND fy1)),
    t AS (SELECT page, 0.55 * list_sort(list(y1 - y0))[count(*) // 2 + 1] AS tol FROM k GROUP BY page),
    g AS (SELECT page, box_id, x1, i, cast(1 AS BIGINT) AS line, c AS mean, cast(1 AS BIGINT) AS n FROM k WHERE i = 1
        UNION ALL SELECT k.page, k.box_id, k.x1, k.i, CASE WHEN abs(mean - c) <= tol THEN line ELSE line + 1 END, CASE WHEN abs(mean - c) <= tol THEN (mean * n + c) / (n + 1) ELSE c END, CASE WHEN abs(mean - c) <= tol THEN n + 1 ELSE 1 END
        FROM g JOIN k ON k.page = g.page AND k.i = g.i + 1 JOIN t ON t.page = k.page)
    SELECT page, line, string_agg(box_id, ' ' ORDER BY x1 DESC, box_id) AS text FROM g GROUP BY ALL""",
)
def wn03(spark, sf_dir):
    boxes = views.boxes(spark, sf_dir)
    figures = boxes.where("box_id % 17 = 0").select("page", F.col("x0").alias("f_x0"), F.col("y0").alias("f_y0"), (F.col("x1") + 60).alias("f_x1"), (F.col("y1") + 40).alias("f_y1"))
    return layout.visual_lines(boxes.where("box_id % 17 <> 0").withColumn("text", F.col("box_id").cast("string")), figures)


@query(
    "wn29_words",
    """WITH c AS (SELECT *, y0 // 12 AS band FROM v_boxes), g AS (SELECT *, CASE WHEN coalesce(x0 - lag(x1) OVER o >= greatest(4.0, 0.7 * (y1 - y0)), true) THEN 1 ELSE 0 END AS b FROM c WINDOW o AS (PARTITION BY page, band ORDER BY x0, box_id)),
    w AS (SELECT *, cast(sum(b) OVER (PARTITION BY page, band ORDER BY x0, box_id) AS BIGINT) AS word FROM g) SELECT page, band, word, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM w GROUP BY ALL""",
)
def wn29(spark, sf_dir):
    return layout.words(views.boxes(spark, sf_dir))


@query(
    "wn12_merge_rows",
    """WITH e AS (SELECT *, max(y1) OVER (PARTITION BY page ORDER BY y0, y1, box_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM v_boxes), b AS (SELECT *, CASE WHEN coalesce(least(e, y1) - y0 <= 0.5 * (y1 - y0), true) OR e IS NULL THEN 1 ELSE 0 END AS b FROM e),
    r AS (SELECT *, cast(sum(b) OVER (PARTITION BY page ORDER BY y0, y1, box_id) AS BIGINT) AS row FROM b) SELECT page, row, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM r GROUP BY ALL""",
)
def wn12(spark, sf_dir):
    return layout.merge_rows(views.boxes(spark, sf_dir))


@query(
    "wn13_clusters",
    """WITH RECURSIVE e AS (SELECT a.page, a.box_id AS a, b.box_id AS b FROM v_boxes a JOIN v_boxes b ON a.page = b.page AND a.x0 <= b.x1 + 6 AND b.x0 <= a.x1 + 6 AND a.y0 <= b.y1 + 6 AND b.y0 <= a.y1 + 6),
    r AS (SELECT page, box_id, box_id AS l FROM v_boxes UNION SELECT r.page, e.b, r.l FROM r JOIN e ON e.page = r.page AND e.a = r.box_id AND r.l < e.b) SELECT page, box_id, min(l) AS cluster FROM r GROUP BY ALL""",
)
def wn13(spark, sf_dir):
    return layout.clusters(views.boxes(spark, sf_dir), 6)


@query(
    "prj07_classify_clusters",
    """WITH m AS (SELECT page, box_id % 7 AS cluster, x0, y0, x1, y1, CASE WHEN box_id % 3 = 0 THEN 'word' ELSE 'stroke' END AS kind, x1 - x0 AS w, y1 - y0 AS h FROM v_boxes),
    c AS (SELECT page, cluster, count(*) FILTER (kind = 'stroke') AS s, count(*) FILTER (kind = 'stroke' AND least(w, h) <= 10) AS t, count(*) FILTER (kind = 'stroke' AND w > 20 AND h > 10) AS o, count(*) FILTER (kind = 'word') AS d,
        count(DISTINCT y0) AS r, count(DISTINCT x0) AS k, max(x1) - min(x0) AS w, max(y1) - min(y0) AS h FROM m GROUP BY ALL)
    SELECT page, cluster, split_part(x, ':', 1) AS role, split_part(x, ':', 2) AS reason, CASE WHEN x LIKE 'table%' THEN concat(r, 'x', k) ELSE '' END AS grid FROM (SELECT *, CASE WHEN w < 30 AND h < 15 THEN 'noise:small' WHEN t >= 3 AND d >= 3 THEN 'table:ruled words'
        WHEN o >= 2 AND d <= 2 THEN 'figure:oblique strokes' WHEN d > s THEN 'text:mostly words' WHEN s > 0 THEN 'drawing:strokes' ELSE 'unknown:' END AS x FROM c)""",
)
def prj07(spark, sf_dir):
    boxes = views.boxes(spark, sf_dir)
    return layout.classify_clusters(boxes.withColumn("cluster", F.col("box_id") % 7).withColumn("kind", F.when(F.col("box_id") % 3 == 0, "word").otherwise("stroke")), ["page", "cluster"])


@query(
    "wn14_option_groups",
    """WITH b AS (SELECT page, box_id, x0, y0, x1 - x0 AS w, y1 - y0 AS h FROM v_boxes WHERE box_id % 5 = 0), l AS (SELECT page, box_id AS label, x0 AS x, y0 AS y FROM v_boxes WHERE box_id % 5 = 1),
    g AS (SELECT a.page, a.box_id, a.x0, a.y0, min(o.box_id) AS grp FROM b a JOIN b o ON a.page = o.page AND abs(a.w - o.w) <= 0.3 * greatest(a.w, o.w) AND abs(a.h - o.h) <= 0.6 * greatest(a.h, o.h) GROUP BY ALL HAVING count(*) >= 2)
    SELECT g.page, grp AS "group", row_number() OVER (PARTITION BY g.page, grp ORDER BY round(y0 / 40), x0 DESC, box_id) AS place, box_id, (SELECT arg_min(label, struct_pack(d := (x - x0) ** 2 + (y - y0) ** 2, l := label)) FROM l WHERE l.page = g.page) AS label FROM g""",
)
def wn14(spark, sf_dir):
    boxes = views.boxes(spark, sf_dir)
    labels = boxes.where("box_id % 5 = 1").select("page", F.col("box_id").alias("label"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    return layout.option_groups(boxes.where("box_id % 5 = 0"), labels)


@query(
    "wn10_marker_sequence",
    """WITH RECURSIVE m AS (SELECT qid // 8 AS doc, qid % 8 AS page, sec AS y, cast(points AS BIGINT) % 5 + 1 AS number, count(*) OVER (PARTITION BY qid) AS n FROM v_sections), u AS (SELECT * FROM m WHERE n <= 8),
    s AS (SELECT p.doc, p.page AS start, u.number, row_number() OVER (PARTITION BY p.doc, p.page ORDER BY u.page, u.y, u.number) AS i FROM (SELECT DISTINCT doc, page FROM u) p JOIN u ON u.doc = p.doc AND u.page >= p.page),
    g AS (SELECT DISTINCT doc, start, cast(0 AS BIGINT) AS i, cast(0 AS BIGINT) AS seen FROM s UNION ALL SELECT g.doc, g.start, s.i, CASE WHEN s.number = seen + 1 THEN s.number ELSE seen END FROM g JOIN s ON s.doc = g.doc AND s.start = g.start AND s.i = g.i + 1),
    f AS (SELECT doc, start, max(seen) AS seen FROM g GROUP BY doc, start)
    SELECT doc, start, array_to_string(range(1, seen + 1), ',') AS numbers FROM f QUALIFY row_number() OVER (PARTITION BY doc ORDER BY seen DESC, start) = 1""",
)
def wn10(spark, sf_dir):
    marks = views.sections(spark, sf_dir).select(F.floor(F.col("qid") / 8).alias("doc"), (F.col("qid") % 8).alias("page"), F.col("sec").alias("y"), (F.col("points").cast("long") % 5 + 1).alias("number"))
    return layout.marker_sequence(marks, 8)


@query(
    "wn11_regions",
    """WITH m AS (SELECT DISTINCT o_custkey AS doc, o_orderkey % 3 + 1 AS number, o_orderkey % 12 AS page FROM orders), p AS (SELECT doc, unnest(range(0, 15)) AS page FROM (SELECT DISTINCT doc FROM m)),
    r AS (SELECT doc, page, CASE WHEN (doc + page * 7) % 5 < 3 THEN 'continuation' ELSE 'other' END AS role FROM p),
    s AS (SELECT *, greatest(page, coalesce(lead(page) OVER (PARTITION BY doc ORDER BY page, number) - 1, 14)) AS until FROM m), e AS (SELECT doc, number, page AS first, unnest(range(page, until + 1)) AS page FROM s),
    k AS (SELECT e.*, sum(CASE WHEN e.page > first AND role <> 'continuation' THEN 1 ELSE 0 END) OVER (PARTITION BY doc, number, first ORDER BY e.page) AS broken FROM e JOIN r USING (doc, page)) SELECT doc, number, page FROM k WHERE broken = 0""",
)
def wn11(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    markers = orders.select(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 3 + 1).alias("number"), (F.col("o_orderkey") % 12).alias("page")).distinct()
    role = F.when((F.col("doc") + F.col("page") * 7) % 5 < 3, "continuation").otherwise("other")
    pages = markers.select("doc").distinct().select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(14).cast("long"))).alias("page")).withColumn("role", role)
    return layout.regions(markers, pages)
