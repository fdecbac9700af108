"""Queries of the comparing joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import match
from quire.plans.registry import query
from quire.sources import views
from quire.sources.tables import read

_BAG = """WITH a AS (SELECT doc_id, tok, count(*) AS n_a FROM v_tokens_a GROUP BY ALL), b AS (SELECT doc_id, tok, count(*) AS n_b FROM v_tokens_b GROUP BY ALL),
    d AS (SELECT doc_id, tok, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM a FULL JOIN b USING (doc_id, tok))"""


@query("jn01_bag_diff", f"{_BAG} SELECT doc_id, tok, n_a, n_b, greatest(n_a - n_b, 0) AS missing, greatest(n_b - n_a, 0) AS extra FROM d")
def jn01(spark, sf_dir):
    return match.bag_diff(views.tokens_of_both(spark, sf_dir), None, ["doc_id", "tok"])


@query("ag01_bag_recall", f"{_BAG} SELECT doc_id, cast(sum(n_a) AS BIGINT) AS truth, cast(sum(least(n_a, n_b)) AS BIGINT) AS found, round(CASE WHEN sum(n_a) > 0 THEN sum(least(n_a, n_b)) / sum(n_a) END, 6) AS recall FROM d GROUP BY doc_id")
def ag01(spark, sf_dir):
    return match.bag_recall(views.tokens_of_both(spark, sf_dir), None, ["doc_id"], "tok")


@query(
    "ag02_silent_errors",
    f"""{_BAG}, f AS (SELECT doc_id, tok, count(*) AS f FROM v_tokens_b WHERE tok = 'teh' GROUP BY ALL), w AS (SELECT doc_id FROM documents WHERE doc_id % 9 = 0)
    SELECT doc_id, CASE WHEN doc_id IN (FROM w) THEN 0 ELSE cast(sum(greatest(greatest(n_a - n_b, 0) + greatest(n_b - n_a, 0) - coalesce(f, 0), 0)) AS BIGINT) END AS silent
    FROM d LEFT JOIN f USING (doc_id, tok) GROUP BY doc_id""",
)
def ag02(spark, sf_dir):
    b = views.tokens_b(spark, sf_dir)
    return match.silent_errors(views.tokens_of_both(spark, sf_dir), None, b.where("tok = 'teh'"), read(spark, sf_dir, "documents").where("doc_id % 9 = 0"), "doc_id", "tok")


@query(
    "jn02_reconcile_ids",
    """WITH r AS (SELECT l_orderkey + l_orderkey // 50 AS id FROM lineitem WHERE l_linenumber = 1), e AS (SELECT o_orderkey AS id FROM orders)
    SELECT id, 'missing' AS issue FROM e ANTI JOIN r USING (id) UNION ALL SELECT DISTINCT id, 'extra' FROM r ANTI JOIN e USING (id) UNION ALL SELECT id, 'duplicate' FROM r GROUP BY id HAVING count(*) > 1""",
)
def jn02(spark, sf_dir):
    returned = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select((F.col("l_orderkey") + F.floor(F.col("l_orderkey") / 50)).alias("id"))
    return match.reconcile_ids(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), returned, "id")


@query(
    "jn04_iou",
    """WITH b AS (SELECT page, box_id, x0 + 3 AS x0, y0 + 2 AS y0, x1 + 3 AS x1, y1 + 2 AS y1 FROM v_boxes WHERE box_id % 5 <> 0),
    p AS (SELECT a.page, a.box_id, b.box_id AS match_id, round(i / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - i), 6) AS iou
        FROM (SELECT a AS a, b AS b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i FROM v_boxes a JOIN b ON a.page = b.page AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1))
    SELECT page, box_id, match_id, iou FROM p QUALIFY row_number() OVER (PARTITION BY page, box_id ORDER BY iou DESC, match_id) = 1""",
)
def jn04(spark, sf_dir):
    boxes = views.boxes(spark, sf_dir)
    shifted = boxes.where("box_id % 5 <> 0").select("page", "box_id", (F.col("x0") + 3).alias("x0"), (F.col("y0") + 2).alias("y0"), (F.col("x1") + 3).alias("x1"), (F.col("y1") + 2).alias("y1"))
    return match.iou_join(boxes, shifted)


@query(
    "jn05_bind_regions",
    """WITH m AS (SELECT page, y0 AS y, min(box_id) AS region FROM v_boxes WHERE box_id % 8 = 1 GROUP BY ALL), i AS (SELECT * FROM v_boxes WHERE box_id % 8 <> 1),
    t AS (SELECT i.page, box_id, i.y1, region FROM i ASOF LEFT JOIN m ON i.page = m.page AND i.y0 >= m.y)
    SELECT t.page, box_id, coalesce(t.region, m.region) AS region FROM t ASOF LEFT JOIN m ON t.page = m.page AND t.y1 >= m.y""",
)
def jn05(spark, sf_dir):
    boxes = views.boxes(spark, sf_dir)
    markers = boxes.where("box_id % 8 = 1").groupBy("page", F.col("y0").alias("y")).agg(F.min("box_id").alias("region"))
    return match.bind_regions(boxes.where("box_id % 8 <> 1").select("page", "box_id", "y0", "y1"), markers).select("page", "box_id", "region")


def _greedy(left: str, right: str) -> str:
    """SQL that goes through the pairs p(k, i, ...) of each key k in order i and takes those of which neither end is taken."""
    return f"""g AS (SELECT DISTINCT k, cast(0 AS BIGINT) AS i, NULL AS {left}, NULL AS {right}, false AS took, cast([] AS VARCHAR[]) AS ls, cast([] AS VARCHAR[]) AS rs FROM p
        UNION ALL SELECT g.k, p.i, p.{left}, p.{right}, t, CASE WHEN t THEN list_append(ls, cast(p.{left} AS VARCHAR)) ELSE ls END, CASE WHEN t THEN list_append(rs, cast(p.{right} AS VARCHAR)) ELSE rs END
        FROM g JOIN p ON p.k = g.k AND p.i = g.i + 1, LATERAL (SELECT NOT list_contains(ls, cast(p.{left} AS VARCHAR)) AND NOT list_contains(rs, cast(p.{right} AS VARCHAR)) AS t))"""


@query(
    "jn06_tolerance_match",
    f"""WITH RECURSIVE q AS (SELECT a.panel AS k, a.pid, b.pid AS o, round((a.x - b.x) ** 2 + (a.y - b.y) ** 2, 9) AS d FROM v_points a JOIN v_detected b ON a.panel = b.panel AND abs(a.x - b.x) <= 1.1 AND abs(a.y - b.y) <= 3.1),
    p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, pid, o) AS i, count(*) OVER (PARTITION BY k, pid) > 1 OR count(*) OVER (PARTITION BY k, o) > 1 AS contested FROM q), {_greedy("pid", "o")},
    m AS (SELECT p.k AS panel, p.pid, p.o AS match_id, CASE WHEN contested THEN 'contested' ELSE 'matched' END AS status FROM g JOIN p USING (k, i) WHERE took)
    SELECT * FROM m UNION ALL SELECT panel, pid, NULL, 'unmatched' FROM v_points ANTI JOIN m USING (panel, pid)
    UNION ALL SELECT panel, NULL, d.pid, 'extra' FROM v_detected d WHERE NOT EXISTS (FROM m WHERE m.panel = d.panel AND m.match_id = d.pid)""",
)
def jn06(spark, sf_dir):
    return match.tolerance_match(views.points(spark, sf_dir), views.detected(spark, sf_dir), "panel", 1.1, 3.1)


@query("jn08_block_bind")
def jn08_blocks(spark, sf_dir):
    """Part names and names with a letter gone, bound by matching blocks; tested against all pairs."""
    part = read(spark, sf_dir, "part").select((F.col("p_partkey") % 200).alias("k"), F.col("p_name").alias("name"), "p_partkey")
    at = (F.col("p_partkey") % F.length("name")).cast("int")
    worn = part.select("k", F.concat(F.substring("name", F.lit(1), at), F.substring("name", at + 2, F.length("name"))).alias("name"))
    return match.block_bind(part, worn, "k")


@query(
    "jn07_nearest_owner",
    """WITH t AS (SELECT page, box_id AS token_id, x0 AS x, y0 AS y FROM v_boxes WHERE box_id % 3 <> 0), s AS (SELECT page, box_id AS seg_id, x0 AS x, y0 AS y FROM v_boxes WHERE box_id % 3 = 0),
    o AS (SELECT page, token_id, seg_id, (t.x - s.x) ** 2 + (t.y - s.y) ** 2 AS d FROM t JOIN s USING (page) QUALIFY row_number() OVER (PARTITION BY page, token_id ORDER BY d, seg_id) = 1)
    SELECT page, seg_id, token_id, cast(d AS BIGINT) AS d2 FROM o QUALIFY row_number() OVER (PARTITION BY page, seg_id ORDER BY d, token_id) = 1""",
)
def jn07(spark, sf_dir):
    """Every third box is a seg. Boxes are numbered by page, so they lie where they are compared."""
    boxes = views.boxes(spark, sf_dir)
    return match.nearest_of_points(boxes.select("page", (F.col("box_id") % 3 == 0).alias("seg"), F.col("box_id").alias("id"), F.col("x0").alias("x"), F.col("y0").alias("y")))


@query(
    "jn08_fuzzy_bind",
    f"""WITH RECURSIVE a AS (SELECT DISTINCT p_size AS k, concat(p_type, ' ', p_name) AS name FROM part), b AS (SELECT DISTINCT p_size AS k, replace(concat(p_type, ' ', p_name), 'O', 'Q') AS other FROM part WHERE p_partkey % 2 = 0),
    q AS (SELECT k, name, other, round(1 - levenshtein(name, other) / greatest(length(name), length(other)), 6) AS ratio FROM a JOIN b USING (k)),
    p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ratio DESC, name, other) AS i FROM q WHERE ratio >= 0.75), {_greedy("name", "other")}
    SELECT k AS key, p.name, p.other, ratio FROM g JOIN p USING (k, i) WHERE took""",
)
def jn08(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_size").alias("key"), F.concat_ws(" ", "p_type", "p_name").alias("name"), "p_partkey")
    return match.fuzzy_bind(part, part.where("p_partkey % 2 = 0").withColumn("name", F.replace("name", F.lit("O"), F.lit("Q"))), "key")


@query(
    "jn09_compare_cells",
    """WITH o AS (SELECT * FROM v_observed WHERE NOT (tid % 11 = 3 AND r = 'R')), s1 AS (SELECT tid, max(r) AS r, max(c) AS c, count(*) AS n FROM v_cells GROUP BY tid), s2 AS (SELECT tid, max(r) AS r, max(c) AS c, count(*) AS n FROM o GROUP BY tid),
    w AS (SELECT tid FROM s1 FULL JOIN s2 USING (tid) WHERE s1.r IS DISTINCT FROM s2.r OR s1.c IS DISTINCT FROM s2.c OR s1.n IS DISTINCT FROM s2.n)
    SELECT tid, r, c, v_cells.v AS spec, o.v AS observed FROM v_cells FULL JOIN o USING (tid, r, c) WHERE v_cells.v IS DISTINCT FROM o.v AND tid NOT IN (FROM w) UNION ALL SELECT tid, NULL, NULL, NULL, NULL FROM w""",
)
def jn09(spark, sf_dir):
    return match.compare_cells(views.cells(spark, sf_dir), views.observed_cells(spark, sf_dir).where("NOT (tid % 11 = 3 AND r = 'R')"), "tid", "v")


@query(
    "jn10_verify_values",
    """WITH d AS (SELECT p_brand AS chart, concat(p_type, p_size) AS cat, round(avg(p_retailprice), 2) AS value FROM part GROUP BY ALL),
    m AS (SELECT chart, cat, CASE WHEN length(cat) % 3 = 0 THEN value * 1.02 WHEN length(cat) % 3 = 1 THEN value * 1.05 ELSE value * 1.2 END AS got FROM d WHERE NOT (chart = 'Brand#1' AND cat LIKE '%7')),
    x AS (SELECT chart, cat, value, got, (SELECT count(*) FROM d a WHERE a.chart = d.chart) <> (SELECT count(*) FROM m b WHERE b.chart = d.chart) AS off, greatest(0.02 * 100, 0.03 * greatest(abs(value), 1.0), 6 * 0.5) AS l FROM d LEFT JOIN m USING (chart, cat))
    SELECT chart, cat, CASE WHEN off THEN 'CONFLICT' WHEN got IS NULL THEN 'UNAVAILABLE' WHEN abs(got - value) <= l THEN 'VERIFIED' WHEN abs(got - value) <= 2 * l THEN 'PARTIAL' ELSE 'CONFLICT' END AS status FROM x""",
)
def jn10(spark, sf_dir):
    declared = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("chart"), F.concat("p_type", "p_size").alias("cat")).agg(F.round(F.avg("p_retailprice"), 2).alias("value"))
    off = F.when(F.length("cat") % 3 == 0, 1.02).when(F.length("cat") % 3 == 1, 1.05).otherwise(1.2)
    measured = declared.where("NOT (chart = 'Brand#1' AND cat LIKE '%7')").withColumn("value", F.col("value") * off)
    return match.verify_values(declared, measured, "chart", 100.0, 0.5)


@query(
    "jn11_header_join",
    """WITH g AS (SELECT item, (seq - 1) // 4 AS r, (seq - 1) % 4 AS c, concat(status, vid) AS text FROM v_versions),
    h AS (SELECT item, r, string_agg(text, ' ' ORDER BY c) AS row_header FROM g WHERE c < 1 AND r >= 1 GROUP BY ALL), k AS (SELECT item, c, string_agg(text, ' ' ORDER BY r) AS col_header FROM g WHERE r < 1 AND c >= 1 GROUP BY ALL)
    SELECT item, r, c, text, row_header, col_header FROM g LEFT JOIN h USING (item, r) LEFT JOIN k USING (item, c) WHERE r >= 1 AND c >= 1""",
)
def jn11(spark, sf_dir):
    at = F.col("seq") - 1
    cells = views.versions(spark, sf_dir).select("item", F.floor(at / 4).alias("r"), (at % 4).alias("c"), F.concat("status", "vid").alias("text"))
    return match.header_join(cells, "item", 1, 1)


@query(
    "jn12_prefer_text",
    """WITH i AS (SELECT key, max(value) AS a FROM v_facts WHERE source = 'vision' GROUP BY key), t AS (SELECT key, max(value) AS b FROM v_facts WHERE source = 'question_text' AND fact_id % 3 = 0 GROUP BY key)
    SELECT key, coalesce(b, a) AS value, CASE WHEN b IS NOT NULL THEN 'text' ELSE 'image' END AS source, coalesce(a <> b, false) AS changed FROM i FULL JOIN t USING (key)""",
)
def jn12(spark, sf_dir):
    facts = views.facts(spark, sf_dir)
    best = lambda rows: rows.groupBy("key").agg(F.max("value").alias("value"))
    return match.prefer_text(best(facts.where("source = 'vision'")), best(facts.where("source = 'question_text' AND fact_id % 3 = 0")), "key")


@query(
    "jn13_arbitrate",
    """WITH c AS (SELECT key, fact_id AS item, value AS vision, CASE WHEN fact_id % 4 = 0 THEN concat(value[1:1], '.', value[2:]) ELSE cast(fact_id % 100 AS VARCHAR) END AS ocr FROM v_facts WHERE source = 'vision'),
    n AS (SELECT DISTINCT key, value AS number FROM v_facts WHERE source = 'question_text')
    SELECT key, item, vision, ocr, CASE WHEN replace(vision, '.', '') = replace(ocr, '.', '') THEN 'neither' WHEN EXISTS (FROM n WHERE n.key = c.key AND number = ocr) THEN 'wrong'
        WHEN EXISTS (FROM n WHERE n.key = c.key AND number = vision) THEN 'note' ELSE 'unresolved' END AS verdict FROM c""",
)
def jn13(spark, sf_dir):
    facts = views.facts(spark, sf_dir)
    ocr = F.when(F.col("fact_id") % 4 == 0, F.concat(F.substring("value", 1, 1), F.lit("."), F.expr("substring(value, 2)"))).otherwise((F.col("fact_id") % 100).cast("string"))
    conflicts = facts.where("source = 'vision'").select("key", F.col("fact_id").alias("item"), F.col("value").alias("vision"), ocr.alias("ocr"))
    return match.arbitrate(conflicts, facts.where("source = 'question_text'").select("key", F.col("value").alias("number")), "key")


@query(
    "jn14_adjacent",
    """WITH p AS (SELECT a.page, a.box_id AS first, b.box_id AS second, a.x1 = b.x0 AND a.y0 < b.y1 AND b.y0 < a.y1 AS h, a.y1 = b.y0 AND a.x0 < b.x1 AND b.x0 < a.x1 AS v FROM v_boxes a JOIN v_boxes b ON a.page = b.page AND a.box_id <> b.box_id)
    SELECT page, first, second, 'right' AS side FROM p WHERE h UNION ALL SELECT page, first, second, 'below' FROM p WHERE v""",
)
def jn14(spark, sf_dir):
    return match.adjacent(views.boxes(spark, sf_dir))


@query(
    "jn15_match_options",
    """WITH o AS (SELECT p_size AS q, p_partkey AS option, unnest(['brand', 'type', 'name']) AS key, unnest([p_brand, p_type, p_name]) AS value FROM part),
    t AS (SELECT q, key, value FROM o WHERE option IN (SELECT min(p_partkey) FROM part GROUP BY p_size) AND NOT (key = 'name' OR q % 2 = 0 AND key = 'type'))
    SELECT q, option FROM t JOIN o USING (q, key) GROUP BY q, option HAVING count(*) FILTER (t.value = o.value) = max((SELECT count(*) FROM t u WHERE u.q = o.q))""",
)
def jn15(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in (("brand", "p_brand"), ("type", "p_type"), ("name", "p_name")))))
    options = part.select(F.col("p_size").alias("q"), F.col("p_partkey").alias("option"), pairs.alias("p")).select("q", "option", "p.*")
    first = part.groupBy(F.col("p_size").alias("q")).agg(F.min("p_partkey").alias("option"))
    target = options.join(first, ["q", "option"], "left_semi").where("NOT (key = 'name' OR q % 2 = 0 AND key = 'type')").select("q", "key", "value")
    return match.match_options(target, options, "q")


_NUMBERS = [(w, i) for i, w in enumerate("one two three four five six seven eight nine ten".split(), 1)]


@query(
    "jn16_declared_vs_detected",
    r"""WITH s AS (SELECT doc_id, regexp_extract(lower(text), '(^|[^a-z0-9])([0-9]{1,4}|one|two|three|four|five|six|seven|eight|nine|ten)([^a-z0-9]|$)', 2) AS w FROM documents),
    d AS (SELECT doc_id, coalesce(list_position(['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'], w), try_cast(w AS BIGINT)) AS declared FROM s WHERE w <> ''),
    l AS (SELECT doc_id, count(*) AS n FROM v_lines GROUP BY doc_id)
    SELECT doc_id, cast(declared AS BIGINT) AS declared, coalesce(n, 0) AS detected FROM d LEFT JOIN l USING (doc_id) WHERE declared <> coalesce(n, 0)""",
)
def jn16(spark, sf_dir):
    words = spark.createDataFrame(_NUMBERS, "word string, number long")
    return match.declared_vs_detected(read(spark, sf_dir, "documents"), views.lines(spark, sf_dir), words)


_GRAMS = r"(SELECT {k}, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM {t})"


@query(
    "jn18_best_fragment",
    f"""WITH i AS (SELECT DISTINCT item_id, array_to_string(w[j:j + 4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS j FROM {_GRAMS.format(k="item_id", t="benchmark")} WHERE len(w) >= 5)),
    d AS (SELECT DISTINCT doc_id, array_to_string(w[j:j + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS j FROM {_GRAMS.format(k="doc_id", t="documents")} WHERE len(w) >= 5)),
    s AS (SELECT item_id, doc_id, count(*) AS shared FROM i JOIN d USING (g) GROUP BY ALL), t AS (SELECT item_id, count(*) AS total FROM i GROUP BY item_id)
    SELECT item_id, doc_id, shared, total, round(shared / total, 6) AS score FROM s JOIN t USING (item_id) WHERE round(shared / total, 6) >= 0.7 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(shared / total, 6) DESC, doc_id) = 1""",
)
def jn18(spark, sf_dir):
    return match.best_fragment(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), 5, 0.7)


@query(
    "jn21_bind_dimension",
    """WITH e AS (SELECT l_orderkey AS q, l_returnflag AS kind, sec AS entity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS sec FROM lineitem)),
    n AS (SELECT *, row_number() OVER (PARTITION BY q, kind ORDER BY entity) AS n FROM e), d AS (SELECT o_orderkey AS q, o_orderkey AS dim, CASE o_orderstatus WHEN 'P' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3 + 1 END AS ordinal FROM orders)
    SELECT q, dim, entity, count(*) OVER (PARTITION BY q, dim) > 1 AS ambiguous FROM d JOIN n USING (q, kind) WHERE ordinal IS NULL OR ordinal = n""",
)
def jn21(spark, sf_dir):
    entities = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("q"), F.col("l_returnflag").alias("kind"),
        F.expr(f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(views.ROWS_OF_LINEITEM)})").alias("entity"),
    )
    kind = F.when(F.col("o_orderstatus") == "P", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R")
    key = F.col("o_orderkey")
    return match.bind_dimension(read(spark, sf_dir, "orders").select(key.alias("q"), key.alias("dim"), kind.alias("kind"), F.when(key % 2 == 0, key % 3 + 1).alias("ordinal")), entities, "q")


_KINDS = "['collinear', 'between', 'midpoint', 'equal_length', 'parallel', 'perpendicular', 'right_angle', 'on_x_axis', 'on_y_axis']"


@query(
    "jn22_check_facts",
    f"""WITH p AS (SELECT panel, pid % 100 AS name, cast(x % 3 AS BIGINT) AS x, pid % 3 AS y FROM v_points),
    f AS (SELECT panel, pid AS fact_id, {_KINDS}[pid % 9 + 1] AS kind, pid % 100 AS p1, (pid + 1) % 100 AS p2, (pid + 2) % 101 AS p3, (pid + 3) % 100 AS p4 FROM v_points),
    j AS (SELECT f.panel, fact_id, kind, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, c.x AS x3, c.y AS y3, d.x AS x4, d.y AS y4 FROM f LEFT JOIN p a ON a.panel = f.panel AND a.name = p1 LEFT JOIN p b ON b.panel = f.panel AND b.name = p2
        LEFT JOIN p c ON c.panel = f.panel AND c.name = p3 LEFT JOIN p d ON d.panel = f.panel AND d.name = p4)
    SELECT panel, fact_id, kind, CASE kind WHEN 'collinear' THEN (x2 - x1) * (y3 - y1) = (y2 - y1) * (x3 - x1) WHEN 'between' THEN (x2 - x1) * (y3 - y1) = (y2 - y1) * (x3 - x1) AND (x1 - x2) * (x3 - x2) + (y1 - y2) * (y3 - y2) <= 0
        WHEN 'midpoint' THEN x1 + x3 = 2 * x2 AND y1 + y3 = 2 * y2 WHEN 'equal_length' THEN (x2 - x1) ** 2 + (y2 - y1) ** 2 = (x4 - x3) ** 2 + (y4 - y3) ** 2 WHEN 'parallel' THEN (x2 - x1) * (y4 - y3) = (y2 - y1) * (x4 - x3)
        WHEN 'perpendicular' THEN (x2 - x1) * (x4 - x3) + (y2 - y1) * (y4 - y3) = 0 WHEN 'right_angle' THEN (x1 - x2) * (x3 - x2) + (y1 - y2) * (y3 - y2) = 0 WHEN 'on_x_axis' THEN y1 = 0 WHEN 'on_y_axis' THEN x1 = 0 END AS holds FROM j""",
)
def jn22(spark, sf_dir):
    points, pid = views.points(spark, sf_dir), F.col("pid")
    named = points.select("panel", (pid % 100).alias("name"), (F.col("x") % 3).cast("long").alias("x"), (pid % 3).alias("y"))
    kinds = F.expr(f"element_at(array({_KINDS[1:-1]}), cast(pid % 9 + 1 AS INT))")
    stated = points.select("panel", pid.alias("fact_id"), kinds.alias("kind"), (pid % 100).alias("p1"), ((pid + 1) % 100).alias("p2"), ((pid + 2) % 101).alias("p3"), ((pid + 3) % 100).alias("p4"))
    return match.check_facts(stated, named, "panel")


@query(
    "jn23_tolerant_f1",
    """WITH a AS (SELECT DISTINCT panel, cast(x AS BIGINT) AS x, cast(floor(y) AS BIGINT) AS y FROM v_points), b AS (SELECT DISTINCT panel, x + y % 5 AS x, y + 1 AS y FROM a WHERE (x + y) % 4 <> 0),
    p AS (SELECT panel, round(avg(CASE WHEN EXISTS (FROM b WHERE b.panel = a.panel AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3) THEN 1 ELSE 0 END), 6) AS precision FROM a GROUP BY panel),
    r AS (SELECT panel, round(avg(CASE WHEN EXISTS (FROM a WHERE b.panel = a.panel AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3) THEN 1 ELSE 0 END), 6) AS recall FROM b GROUP BY panel)
    SELECT panel, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM p FULL JOIN r USING (panel)""",
)
def jn23(spark, sf_dir):
    a = views.points(spark, sf_dir).select("panel", F.col("x").cast("long").alias("x"), F.floor("y").alias("y")).distinct()
    b = a.where("(x + y) % 4 <> 0").select("panel", (F.col("x") + F.col("y") % 5).alias("x"), (F.col("y") + 1).alias("y"))
    return match.tolerant_f1(a, b, "panel", 3)


@query(
    "jn24_manifest_diff",
    """WITH e AS (SELECT tid, concat(r, c) AS key, v AS value FROM v_cells), g AS (SELECT tid, concat(r, c) AS key, v AS value FROM v_observed WHERE NOT (tid % 10 = 1 AND c = 'O')),
    a AS (SELECT tid, key, string_agg(value, ',' ORDER BY value) AS expected FROM e GROUP BY ALL), b AS (SELECT tid, key, string_agg(value, ',' ORDER BY value) AS got FROM g GROUP BY ALL)
    SELECT tid, key, expected, got FROM a FULL JOIN b USING (tid, key) WHERE expected IS DISTINCT FROM got""",
)
def jn24(spark, sf_dir):
    keyed = lambda cells: cells.select("tid", F.concat("r", "c").alias("key"), F.col("v").alias("value"))
    return match.manifest_diff(keyed(views.cells(spark, sf_dir)), keyed(views.observed_cells(spark, sf_dir).where("NOT (tid % 10 = 1 AND c = 'O')")), "tid")


@query(
    "jn25_equivalent",
    """WITH b AS (SELECT sid, x, CASE WHEN sid % 3 = 0 AND x <= 3 THEN NULL WHEN sid % 3 = 1 AND x = 2 THEN y + 1e-3 ELSE y + 1e-12 END AS o FROM v_series)
    SELECT sid, count(*) FILTER (y IS NOT NULL AND o IS NOT NULL) AS shared, count(*) FILTER ((y IS NULL) <> (o IS NULL)) AS unshared, coalesce(bool_and(abs(y - o) <= greatest(1e-9, 1e-7 * greatest(abs(y), abs(o)))), false)
        AND shared >= 5 AND unshared <= 2 AS equivalent FROM v_series FULL JOIN b USING (sid, x) GROUP BY sid""",
)
def jn25(spark, sf_dir):
    a = views.series(spark, sf_dir)
    y = F.when((F.col("sid") % 3 == 0) & (F.col("x") <= 3), None).when((F.col("sid") % 3 == 1) & (F.col("x") == 2), F.col("y") + 1e-3).otherwise(F.col("y") + 1e-12)
    return match.equivalent(a, a.withColumn("y", y), "sid")


@query(
    "jn26_series_relation",
    "SELECT sid, ['inversion', 'shift_y', 'shift_x', 'mirror', 'none'][sid % 5 + 1] AS relation FROM v_series GROUP BY sid",
)
def jn26(spark, sf_dir):
    a = views.series(spark, sf_dir).where("y IS NOT NULL").select("sid", F.col("x").cast("double").alias("x"), "y")
    k, x, y = F.col("sid") % 5, F.col("x"), F.col("y")
    b = a.select("sid", F.when(k == 2, x + 1).when(k == 3, -x).when(k == 4, x * 2).otherwise(x).alias("x"), F.when(k == 0, -y).when(k == 1, y + 7.5).when(k == 4, y * 3 + x).otherwise(y).alias("y"))
    return match.series_relation(a, b, "sid")


@query(
    "jn27_integrity_issues",
    """SELECT 'duplicate' AS issue, 'l_orderkey,l_linenumber' AS column, count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT 'dangling', 'l_partkey', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2) UNION ALL SELECT 'dangling', 'l_suppkey', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
    UNION ALL SELECT 'dangling', 'l_orderkey', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
    UNION ALL SELECT 'range', 'l_quantity', count(*) FILTER (NOT l_quantity BETWEEN 1 AND 45) FROM lineitem UNION ALL SELECT 'range', 'l_discount', count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.05) FROM lineitem""",
)
def jn27(spark, sf_dir):
    refs = [("l_partkey", read(spark, sf_dir, "part").where("p_size > 2"), "p_partkey"), ("l_suppkey", read(spark, sf_dir, "supplier"), "s_suppkey"), ("l_orderkey", read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'"), "o_orderkey")]
    return match.integrity_issues(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], refs, [("l_quantity", 1, 45), ("l_discount", 0, 0.05)])


@query(
    "jn28_grid_cells",
    """WITH r AS (SELECT page, y0 AS at, row_number() OVER (PARTITION BY page ORDER BY y0) - 1 AS row, lead(y0) OVER (PARTITION BY page ORDER BY y0) AS nxt FROM (SELECT DISTINCT page, y0 FROM v_boxes WHERE box_id % 9 = 0)),
    c AS (SELECT page, x0 AS at, row_number() OVER (PARTITION BY page ORDER BY x0) - 1 AS col, lead(x0) OVER (PARTITION BY page ORDER BY x0) AS nxt FROM (SELECT DISTINCT page, x0 FROM v_boxes WHERE box_id % 9 = 0))
    SELECT t.page, row, col, string_agg(box_id, ' ' ORDER BY y0, -x0, box_id) AS text FROM v_boxes t JOIN r ON r.page = t.page AND t.y0 >= r.at AND t.y0 < r.nxt JOIN c ON c.page = t.page AND t.x0 >= c.at AND t.x0 < c.nxt WHERE box_id % 9 <> 0 GROUP BY ALL""",
)
def jn28(spark, sf_dir):
    boxes = views.boxes(spark, sf_dir)
    rules, tokens = boxes.where("box_id % 9 = 0"), boxes.where("box_id % 9 <> 0")
    tokens = tokens.select("page", F.col("box_id").alias("token_id"), F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("box_id").cast("string").alias("text"))
    return match.grid_cells(tokens, rules.select("page", F.col("y0").alias("at")), rules.select("page", F.col("x0").alias("at")), "page", rtl=True)
