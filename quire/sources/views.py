"""Views of the given tables with the shapes that the operators work on, in Spark and as SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.sources.tables import read

Source = Callable[[SparkSession, str], DataFrame]
ROWS_OF_LINEITEM = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _tokens(spark: SparkSession, sf_dir: str, text) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.regexp_extract_all(text, F.lit(r"\p{L}+"), 0)).alias("pos", "tok"))


def tokens_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, F.col("text"))


def second_reading() -> Column:
    return F.replace(F.replace("text", F.lit(" the "), F.lit(" teh ")), F.lit(" and "), F.lit(" "))


def tokens_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, second_reading())


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("pos"), "text")


def words_of_both() -> list[Column]:
    """The words of a text in either reading."""
    return [F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0)) for text in (F.col("text"), second_reading())]


def tokens_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of either reading with their side, a or b, those of a document in one task."""
    sides = F.array(*(F.struct(F.lit(side).alias("side"), F.regexp_extract_all(text, F.lit(r"\p{L}+"), 0).alias("toks")) for side, text in (("a", F.col("text")), ("b", second_reading()))))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(sides).alias("r")).select("doc_id", "r.side", F.explode("r.toks").alias("tok"))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr(
        """CASE l_linenumber % 5 WHEN 1 THEN concat('(', l_linenumber, ') compute ', l_partkey) WHEN 2 THEN concat('$$x=', cast(l_quantity AS BIGINT), '$$')
        WHEN 3 THEN '' WHEN 4 THEN concat('the value, ', l_suppkey, ' is small.') ELSE 'and so on' END"""
    )
    by = Window.partitionBy("l_orderkey").orderBy(*ROWS_OF_LINEITEM)
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.row_number().over(by).alias("line_no"), line.alias("line"))


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.expr("concat('$x^{', p_size, '}+', p_partkey, '$')")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("fid"), a.alias("a"), F.when(F.col("p_partkey") % 11 == 0, F.replace(a, F.lit("+"), F.lit("-"))).otherwise(a).alias("b"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = Window.partitionBy("qid")  # by its own name, so that rows stay where they are dealt for whatever works on questions
    return read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "qid").select(
        "qid", F.row_number().over(key.orderBy(*ROWS_OF_LINEITEM)).alias("sec"), F.col("l_quantity").cast("decimal(18,2)").alias("points"),
        F.when(F.col("l_returnflag") == "A", "g").otherwise("").alias("grp"), (F.count("*").over(key) * 10).cast("decimal(18,2)").alias("total"), F.lit(1).alias("k"),
        F.round(F.col("l_discount") * 100 + 1, 0).cast("decimal(18,2)").alias("rubric_pct"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    source = F.when(kind == "purchase", "teacher").when(kind == "signup", "question_text").when(kind == "click", "detection").when(kind == "view", "vision").otherwise("appearance")
    rank = F.when(kind == "purchase", 7).when(kind == "signup", 6).when(kind == "click", 4).when(kind == "view", 2).otherwise(1)
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("fact_id"), kind.alias("fact_type"), source.alias("source"), rank.alias("rnk"), F.get_json_object("props", "$.k").alias("value"),
        F.round(F.col("value") / 491, 3).alias("confidence"), (F.col("event_id") % 7 == 0).alias("ambiguous"), (F.col("event_id") % 5 == 0).alias("required"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 orders make a page, so that pages stay as full as they are however many rows there are. Places are worked out after
    rows are dealt by page, from columns that are dealt in any case."""
    page = F.floor(F.col("l_orderkey") / 16)
    by = Window.partitionBy("page").orderBy("l_orderkey", *ROWS_OF_LINEITEM)
    x0, y0 = F.col("l_partkey") % 900, (F.col("l_suppkey") * 9) % 900
    rows = read(spark, sf_dir, "lineitem").withColumn("page", page).withColumn("box_id", F.row_number().over(by))
    return rows.select("page", "box_id", x0.alias("x0"), y0.alias("y0"), (x0 + 10 + F.col("l_quantity").cast("long")).alias("x1"), (y0 + 8 + F.col("l_linenumber")).alias("y1"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid"), F.floor(F.col("p_partkey") / 100).alias("panel"), F.col("p_size").cast("double").alias("x"), F.round(F.col("p_retailprice") - 900, 2).alias("y"))


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("pid % 13 <> 0").select("pid", "panel", F.round(F.col("x") + 0.02, 2).alias("x"), F.round(F.col("y") + 0.02, 2).alias("y"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    y = F.when(F.col("event_type") != "error", F.round(F.col("value") - 250, 2))
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("sid"), F.row_number().over(by).alias("x"), y.alias("y"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("tid"), F.col("l_returnflag").alias("r"), F.col("l_linestatus").alias("c"))
    return grouped.agg(F.count("*").alias("v"))


def observed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("tid", "r", "c", (F.col("v") + F.when((F.col("tid") % 7 == 0) & (F.col("r") == "A"), 1).otherwise(0)).alias("v"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("item"), F.row_number().over(by).alias("seq"), F.col("o_orderkey").alias("vid"), F.col("o_orderstatus").alias("status"),
        F.sha2(F.concat("o_orderstatus", "o_orderpriority"), 256).alias("fp"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("rid"), F.col("user_id").alias("client"), F.col("event_type").alias("model"), "ts")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    z = F.explode(F.sequence(F.lit(0).cast("long"), F.col("p_partkey") % 4))
    return part.select(F.floor(F.col("p_partkey") / 50).alias("scene"), (F.col("p_size") % 5).cast("long").alias("x"), (F.col("p_partkey") % 5).alias("y"), z.alias("z")).distinct()


def voxels_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = voxels(spark, sf_dir)
    added = before.where("scene % 3 = 0").select("scene").distinct().select("scene", F.lit(9).cast("long").alias("x"), F.lit(9).cast("long").alias("y"), F.lit(0).cast("long").alias("z"))
    return before.where("z <> 3 OR scene % 2 = 1").unionByName(added)


_ROW = ", ".join(ROWS_OF_LINEITEM)
SQL = {
    "v_lines": "SELECT doc_id, lang, source, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents)",
    "v_tokens_a": r"SELECT doc_id, lang, unnest(range(len(l))) AS pos, unnest(l) AS tok FROM (SELECT doc_id, lang, regexp_extract_all(text, '\p{L}+') AS l FROM documents)",
    "v_tokens_b": r"SELECT doc_id, lang, unnest(range(len(l))) AS pos, unnest(l) AS tok FROM (SELECT doc_id, lang, regexp_extract_all(replace(replace(text, ' the ', ' teh '), ' and ', ' '), '\p{L}+') AS l FROM documents)",
    "v_marked": f"""SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ROW}) AS line_no, CASE l_linenumber % 5
        WHEN 1 THEN concat('(', l_linenumber, ') compute ', l_partkey) WHEN 2 THEN concat('$$x=', cast(l_quantity AS BIGINT), '$$')
        WHEN 3 THEN '' WHEN 4 THEN concat('the value, ', l_suppkey, ' is small.') ELSE 'and so on' END AS line FROM lineitem""",
    "v_formulas": "SELECT fid, a, CASE WHEN fid % 11 = 0 THEN replace(a, '+', '-') ELSE a END AS b FROM (SELECT p_partkey AS fid, concat('$x^{', p_size, '}+', p_partkey, '$') AS a FROM part)",
    "v_sections": f"""SELECT l_orderkey AS qid, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ROW}) AS sec, cast(l_quantity AS DECIMAL(18,2)) AS points,
        CASE WHEN l_returnflag = 'A' THEN 'g' ELSE '' END AS grp, cast(count(*) OVER (PARTITION BY l_orderkey) * 10 AS DECIMAL(18,2)) AS total, 1 AS k,
        cast(round(l_discount * 100 + 1) AS DECIMAL(18,2)) AS rubric_pct FROM lineitem""",
    "v_facts": """SELECT user_id AS key, event_id AS fact_id, event_type AS fact_type,
        CASE event_type WHEN 'purchase' THEN 'teacher' WHEN 'signup' THEN 'question_text' WHEN 'click' THEN 'detection' WHEN 'view' THEN 'vision' ELSE 'appearance' END AS source,
        CASE event_type WHEN 'purchase' THEN 7 WHEN 'signup' THEN 6 WHEN 'click' THEN 4 WHEN 'view' THEN 2 ELSE 1 END AS rnk, json_extract_string(props, '$.k') AS value,
        round(value / 491, 3) AS confidence, event_id % 7 = 0 AS ambiguous, event_id % 5 = 0 AS required FROM events""",
    "v_boxes": f"""SELECT page, row_number() OVER (PARTITION BY page ORDER BY l_orderkey, {_ROW}) AS box_id, x0, y0, x0 + 10 + cast(l_quantity AS BIGINT) AS x1, y0 + 8 + l_linenumber AS y1
        FROM (SELECT *, l_orderkey // 16 AS page, l_partkey % 900 AS x0, (l_suppkey * 9) % 900 AS y0 FROM lineitem)""",
    "v_points": "SELECT p_partkey AS pid, p_partkey // 100 AS panel, cast(p_size AS DOUBLE) AS x, round(p_retailprice - 900, 2) AS y FROM part",
    "v_detected": "SELECT pid, panel, round(x + 0.02, 2) AS x, round(y + 0.02, 2) AS y FROM v_points WHERE pid % 13 <> 0",
    "v_series": "SELECT user_id AS sid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x, CASE WHEN event_type <> 'error' THEN round(value - 250, 2) END AS y FROM events",
    "v_cells": "SELECT l_suppkey AS tid, l_returnflag AS r, l_linestatus AS c, count(*) AS v FROM lineitem GROUP BY ALL",
    "v_observed": "SELECT tid, r, c, v + CASE WHEN tid % 7 = 0 AND r = 'A' THEN 1 ELSE 0 END AS v FROM v_cells",
    "v_versions": """SELECT o_custkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, o_orderkey AS vid, o_orderstatus AS status,
        sha256(concat(o_orderstatus, o_orderpriority)) AS fp FROM orders""",
    "v_requests": "SELECT event_id AS rid, user_id AS client, event_type AS model, ts FROM events",
    "v_voxels": "SELECT DISTINCT p_partkey // 50 AS scene, cast(p_size % 5 AS BIGINT) AS x, p_partkey % 5 AS y, unnest(range(0, p_partkey % 4 + 1)) AS z FROM part",
    "v_after": "SELECT * FROM v_voxels WHERE z <> 3 OR scene % 2 = 1 UNION ALL SELECT DISTINCT scene, 9, 9, 0 FROM v_voxels WHERE scene % 3 = 0",
}


def oracle(sql: str) -> str:
    """sql with the views that it names put before it."""
    wanted = {name for name in SQL if name in sql}
    wanted |= {"v_points"} if "v_detected" in wanted else set()
    wanted |= {"v_cells"} if "v_observed" in wanted else set()
    wanted |= {"v_voxels"} if "v_after" in wanted else set()
    views = ", ".join(f"{name} AS ({SQL[name]})" for name in SQL if name in wanted)
    head, body = ("WITH RECURSIVE ", sql.split("WITH RECURSIVE ", 1)[1]) if sql.startswith("WITH RECURSIVE ") else ("WITH ", sql.split("WITH ", 1)[1] if sql.startswith("WITH ") else "")
    if not wanted:
        return sql
    return f"{head}{views}, {body}" if body else f"WITH {views} {sql}"
