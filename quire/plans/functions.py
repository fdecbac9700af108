"""Queries that use the row-level expressions in a job over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import expressions as e
from quire.plans.registry import query
from quire.sources import views
from quire.sources.tables import read

_WORDS = "WITH w AS (SELECT lang, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents)"


@query("sc01_word_normaliser", _WORDS + r""" SELECT lang, count(DISTINCT w) AS before, count(DISTINCT lower(regexp_replace(w, '[.,;:!?\"''()\[\]*#$%&\x{0591}-\x{05C7}\x{05F3}\x{05F4}]', '', 'g'))) AS after FROM w GROUP BY lang""")
def sc01(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select("lang", F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    return words.groupBy("lang").agg(F.count_distinct("w").alias("before"), F.count_distinct(e.word(F.col("w"))).alias("after"))


@query(
    "sc02_number_normaliser",
    """WITH n AS (SELECT CASE l_orderkey % 3 WHEN 0 THEN concat(l_partkey % 900 + 1, ',', lpad(cast(l_suppkey % 1000 AS VARCHAR), 3, '0')) WHEN 1 THEN concat(l_partkey, ',', l_suppkey % 90) ELSE cast(l_partkey AS VARCHAR) END AS t FROM lineitem),
    m AS (SELECT CASE WHEN regexp_matches(t, '^-?[0-9]{1,3}(,[0-9]{3})+([.][0-9]+)?$') THEN replace(t, ',', '') ELSE replace(t, ',', '.') END AS t FROM n) SELECT t AS number, count(*) AS n FROM m GROUP BY t""",
)
def sc02(spark, sf_dir):
    kind = F.col("l_orderkey") % 3
    grouped = F.concat(F.col("l_partkey") % 900 + 1, F.lit(","), F.lpad((F.col("l_suppkey") % 1000).cast("string"), 3, "0"))
    text = F.when(kind == 0, grouped).when(kind == 1, F.concat("l_partkey", F.lit(","), F.col("l_suppkey") % 90)).otherwise(F.col("l_partkey").cast("string"))
    return read(spark, sf_dir, "lineitem").groupBy(e.number(text).alias("number")).agg(F.count("*").alias("n"))


@query("sc03_maths_normaliser", "SELECT concat('x^', p_size, '+', p_partkey % 50) AS formula, count(*) AS n FROM part WHERE p_size < 10 GROUP BY ALL UNION ALL SELECT concat('x^{', p_size, '}+', p_partkey % 50), count(*) FROM part WHERE p_size >= 10 GROUP BY ALL")
def sc03(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    spelling = F.concat(F.lit("$x^{"), "p_size", F.when(F.col("p_partkey") % 2 == 0, F.lit("} + ")).otherwise(F.lit(r"}\,+")), F.col("p_partkey") % 50, F.lit("$"))
    return part.groupBy(e.maths(spelling).alias("formula")).agg(F.count("*").alias("n"))


@query("sc04_tokeniser", r"""WITH t AS (SELECT unnest(regexp_extract_all(concat('solve ', a, ' or ', b), '\$\$[^$]+\$\$|\$[^$]+\$|[^\s$\x{05BE}]+')) AS t FROM v_formulas) SELECT CASE WHEN regexp_matches(t, '^\$\$?[^$]+\$\$?$') THEN 'M' ELSE 'W' END AS kind, count(*) AS n, count(DISTINCT t) AS tokens FROM t GROUP BY ALL""")
def sc04(spark, sf_dir):
    tokens = views.formulas(spark, sf_dir).select(F.explode(e.tokens(F.concat(F.lit("solve "), "a", F.lit(" or "), "b"))).alias("t"))
    return tokens.groupBy(e.token_kind(F.col("t")).alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("t").alias("tokens"))


@query(
    "sc05_numbers_in_context",
    """WITH v AS (SELECT unnest([cast(p_size AS VARCHAR), concat('-', p_partkey % 10), concat('1', lpad(cast(p_partkey % 1000 AS VARCHAR), 3, '0')), cast(p_partkey % 9 AS VARCHAR), concat('2', lpad(cast(p_partkey % 1000 AS VARCHAR), 3, '0'), '000'), '1', '200', concat('-', p_size)]) AS number FROM part) SELECT number, count(*) AS n FROM v GROUP BY number""",
)
def sc05(spark, sf_dir):
    text = F.concat(F.lit("at ("), "p_size", F.lit(", -"), F.col("p_partkey") % 10, F.lit(") is 1,"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit(" then x-"), F.col("p_partkey") % 9, F.lit(" or 2,"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit(",000 not (1,200) but −"), "p_size")
    return read(spark, sf_dir, "part").select(F.explode(e.numbers_in(text)).alias("number")).groupBy("number").agg(F.count("*").alias("n"))


@query("sc06_strip_label", "SELECT doc, line_no, ltrim(substr(line, instr(line, ')') + 1)) AS bare FROM v_marked WHERE starts_with(line, '(')")
def sc06(spark, sf_dir):
    return views.marked(spark, sf_dir).where("startswith(line, '(')").select("doc", "line_no", e.strip_label(F.col("line")).alias("bare"))


@query("sc07_section_id", "SELECT l_orderkey, concat('a', l_linenumber) AS section, count(*) AS n FROM lineitem GROUP BY ALL")
def sc07(spark, sf_dir):
    shape = F.col("l_suppkey") % 3
    spelling = F.when(shape == 0, F.concat(F.lit("(A"), "l_linenumber", F.lit(")"))).when(shape == 1, F.concat(F.lit(" a"), "l_linenumber", F.lit(". "))).otherwise(F.concat(F.lit("[a"), "l_linenumber", F.lit("]:")))
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey", e.section_id(spelling).alias("section")).agg(F.count("*").alias("n"))


@query("sc08_label_key", r"SELECT lower(trim(regexp_replace(concat(' ', p_type, '  ', p_name, ' '), '\s+', ' ', 'g'))) AS label, count(*) AS n FROM part GROUP BY ALL")
def sc08(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(e.label_key(F.concat(F.lit(" "), "p_type", F.lit("  "), "p_name", F.lit(" "))).alias("label")).agg(F.count("*").alias("n"))


@query("sc10_points_text", "SELECT rtrim(rtrim(cast(cast(l_quantity AS DECIMAL(18,2)) + cast(l_discount * 10 AS DECIMAL(18,2)) AS VARCHAR), '0'), '.') AS shown, count(*) AS n FROM lineitem GROUP BY ALL")
def sc10(spark, sf_dir):
    points = F.col("l_quantity") + F.round(F.col("l_discount") * 10, 2)
    return read(spark, sf_dir, "lineitem").groupBy(e.points_text(points).alias("shown")).agg(F.count("*").alias("n"))


@query("sc11_break_markers", r"WITH t AS (SELECT doc, string_agg(line, ' ' ORDER BY line_no) AS t FROM v_marked GROUP BY doc) SELECT doc, len(string_split(regexp_replace(t, '([^\n]) +(\([0-9]+\))', '\1' || chr(10) || '\2', 'g'), chr(10))) AS lines FROM t")
def sc11(spark, sf_dir):
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ")
    texts = views.marked(spark, sf_dir).groupBy("doc").agg(joined.alias("t"))
    return texts.select("doc", F.size(F.split(e.break_markers(F.col("t")), "\n")).cast("long").alias("lines"))


@query("sc12_plain_symbols", "SELECT CASE p_size % 3 WHEN 0 THEN concat('α', p_partkey % 20, ' ∠') WHEN 1 THEN concat('√', p_partkey % 20) ELSE concat('x', p_partkey % 20, 'π') END AS plain, count(*) AS n FROM part GROUP BY ALL")
def sc12(spark, sf_dir):
    kind, k = F.col("p_size") % 3, F.col("p_partkey") % 20
    text = F.when(kind == 0, F.concat(F.lit(r"\alpha{"), k, F.lit(r"} \angle"))).when(kind == 1, F.concat(F.lit(r"\sqrt{"), k, F.lit("}"))).otherwise(F.concat(F.lit(r"\text{x}"), k, F.lit(r"\pi")))
    return read(spark, sf_dir, "part").groupBy(e.plain_symbols(text).alias("plain")).agg(F.count("*").alias("n"))


def _noted():
    kind = F.col("p_partkey") % 4
    return F.when(kind == 0, F.concat(F.lit(r"\bar{x} = "), "p_size", F.lit(r" and \mu = 3"))).when(kind == 1, F.concat(F.lit("s^2 = "), "p_size")).when(kind == 2, F.lit("SD is 2")).otherwise(F.lit("x̄ only"))


@query("sc13_renotate", r"""SELECT CASE p_partkey % 4 WHEN 0 THEN concat('\mu = ', p_size, ' and \mu = 3') WHEN 1 THEN concat('\sigma^2 = ', p_size) WHEN 2 THEN '\sigma is 2' ELSE '\mu only' END AS text, count(*) AS n FROM part GROUP BY ALL""")
def sc13(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(e.renotate(_noted(), "greek").alias("text")).agg(F.count("*").alias("n"))


@query("sc13_notation_issues", "SELECT p_brand, 'mean' AS issue, count(*) AS n FROM part WHERE p_partkey % 4 = 0 GROUP BY p_brand")
def sc13_issues(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_brand", F.explode(e.notation_issues(_noted())).alias("issue")).groupBy("p_brand", "issue").agg(F.count("*").alias("n"))


@query("sc14_map_pairs", "SELECT 'k' AS key, json_extract_string(props, '$.k') AS value, count(*) AS n, true AS same FROM events GROUP BY ALL")
def sc14(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.from_json("props", "map<string,string>").alias("m"))
    pairs = rows.withColumn("pairs", e.to_pairs(F.col("m"))).withColumn("same", e.to_pairs(e.from_pairs(F.col("pairs"))) == F.col("pairs"))
    return pairs.select("same", F.explode("pairs").alias("p")).groupBy(F.col("p.key").alias("key"), F.col("p.value").alias("value"), "same").agg(F.count("*").alias("n"))


@query("sc15_fenced_json", "SELECT event_type, count(*) FILTER (event_id % 5 <> 0) AS valid, count(*) FILTER (event_id % 5 = 0) AS invalid FROM events GROUP BY event_type")
def sc15(spark, sf_dir):
    text = F.concat(F.lit("```json\n"), F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")), F.lit("\n```"))
    parsed = read(spark, sf_dir, "events").select("event_type", e.fenced_json(text, "k long")["k"].alias("k"))
    return parsed.groupBy("event_type").agg(F.count("k").alias("valid"), F.count_if(F.col("k").isNull()).alias("invalid"))


@query("sc16_undeclared", "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'b,c' ELSE 'c' END AS undeclared, count(*) AS n FROM part GROUP BY ALL")
def sc16(spark, sf_dir):
    formula = F.when(F.col("p_partkey") % 3 == 0, F.lit(r"\frac{a}{b} + c^2")).otherwise(F.lit(r"a + \sin c"))
    return read(spark, sf_dir, "part").groupBy(F.array_join(e.undeclared(formula, F.array(F.lit("a"))), ",").alias("undeclared")).agg(F.count("*").alias("n"))


@query(
    "sc17_vector_tests",
    """WITH p AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: cast(x AS DOUBLE)) AS a, list_transform(b.embedding, lambda x: cast(x AS DOUBLE)) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, round(list_dot_product(a, b), 5) AS dot, round(sqrt(list_dot_product(a, a)), 5) AS norm, round(degrees(acos(greatest(-1, least(1, list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)))))), 3) AS angle,
        abs(abs(list_dot_product(a, b)) - sqrt(list_dot_product(a, a) * list_dot_product(b, b))) <= 1e-9 AS parallel FROM p""",
)
def sc17(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    a, b = F.col("embedding"), F.col("b")
    return rows.join(after, "vec_id").select("vec_id", F.round(e.dot(a, b), 5).alias("dot"), F.round(e.norm(a), 5).alias("norm"), F.round(e.angle(a, b), 3).alias("angle"), e.parallel(a, b).alias("parallel"))


@query("sc18_coerced", "SELECT event_type, count(*) FILTER (event_id % 6 = 0) AS bad_numbers, count(*) FILTER (event_id % 4 = 0) AS empty_texts, count(*) FILTER (event_id % 3 = 1) AS flags FROM events GROUP BY event_type")
def sc18(spark, sf_dir):
    k = F.col("event_id")
    raw = read(spark, sf_dir, "events").select("event_type", F.when(k % 6 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("x"), F.when(k % 4 != 0, "t").alias("t"), F.when(k % 3 == 1, "true").when(k % 3 == 2, "no such").alias("f"))
    clean = raw.select("event_type", e.coerced(F.col("x"), "number").alias("x"), e.coerced(F.col("t"), "text").alias("t"), e.coerced(F.col("f"), "flag").alias("f"))
    return clean.groupBy("event_type").agg(F.count_if(F.col("x").isNull()).alias("bad_numbers"), F.count_if(F.col("t") == "").alias("empty_texts"), F.count_if("f").alias("flags"))
