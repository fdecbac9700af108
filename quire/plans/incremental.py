"""Queries of the sources, incremental work and version histories."""

from __future__ import annotations


from pyspark.sql import functions as F

from quire.operators.batching import read_batched
from quire.plans.registry import query
from quire.sources import incremental, page_json, pages, views
from quire.sources.tables import read


@query(
    "src01_segments",
    """WITH b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS block, string_split(text, ' ') AS l FROM conversations),
    s AS (SELECT conv_id AS page_id, block, unnest(range(len(l))) AS seg, unnest(l) AS value FROM b)
    SELECT page_id, 'question' AS page_type, block, -1 AS par, 0 AS line, seg, CASE WHEN regexp_matches(value, '[0-9]') THEN 'math' ELSE 'text' END AS type, value, false AS bold, false AS underline FROM s""",
)
def src01(spark, sf_dir):
    """Page JSON made of the conversations, written as text, read by the schema and flattened."""
    words = F.transform(F.split("text", " "), lambda w: F.struct(F.when(w.rlike("[0-9]"), "math").otherwise("text").alias("type"), w.alias("value"), F.lit(False).alias("bold"), F.lit(False).alias("underline")))
    none = F.lit(None)
    block = F.struct(F.lit("paragraph").alias("kind"), F.col("role").alias("label"), F.lit(0).alias("level"), F.array(words).alias("lines"), none.cast(f"array<array<array<{pages.SEGMENT}>>>").alias("paragraphs"), none.cast(f"array<array<array<{pages.SEGMENT}>>>").alias("rows"))
    turns = read(spark, sf_dir, "conversations").withColumn("block", block)
    made = turns.groupBy(F.col("conv_id").alias("page_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda x: x["block"]).alias("blocks"))
    path = f"{incremental.scratch(spark, 'pages')}/json"
    made.select(F.to_json(F.struct("page_id", F.lit("question").alias("page_type"), "blocks")).alias("value")).write.text(path)
    return pages.segments(pages.read_pages(spark, path))


@query(
    "src01_quarantine",
    """SELECT CASE WHEN conv_id % 5 IN (1, 2, 3) THEN NULL ELSE conv_id * 1000 + turn END AS page_id, CASE conv_id % 5 WHEN 1 THEN 'not JSON' WHEN 2 THEN 'page_id: not a bigint' WHEN 3 THEN 'blocks[0].lines: not a list' END AS reason,
    CASE conv_id % 5 WHEN 1 THEN replace(text, chr(10), ' ') WHEN 2 THEN concat('{"page_id":"', conv_id, '"}') WHEN 3 THEN concat('{"page_id":', conv_id * 1000 + turn, ',"blocks":[{"lines":"', role, '"}]}') END AS raw FROM conversations""",
)
def src01_quarantine(spark, sf_dir):
    """A line for each turn, three of five broken in ways of their own: all come out, with a page or a reason."""
    turns = read(spark, sf_dir, "conversations")
    page_id, kind = (F.col("conv_id") * 1000 + F.col("turn")).cast("string"), F.col("conv_id") % 5
    line = (
        F.when(kind == 1, F.replace("text", F.lit("\n"), F.lit(" "))).when(kind == 2, F.concat(F.lit('{"page_id":"'), "conv_id", F.lit('"}')))
        .when(kind == 3, F.concat(F.lit('{"page_id":'), page_id, F.lit(',"blocks":[{"lines":"'), "role", F.lit('"}]}'))).otherwise(F.concat(F.lit('{"page_id":'), page_id, F.lit("}")))
    )
    path = f"{incremental.scratch(spark, 'lines')}/json"
    turns.select(line.alias("value")).write.text(path)
    page_json.register(spark)
    return spark.read.format("page_json").option("split", 1 << 20).load(path).select("page_id", "reason", "raw")


@query("src02_select_ranges", "SELECT page_id, url FROM pages WHERE page_id BETWEEN 4 AND 70 OR page_id = 100 OR page_id BETWEEN 120 AND 1000000")
def src02(spark, sf_dir):
    return pages.select_ranges(read(spark, sf_dir, "pages"), "page_id", "4-70,100,120-1000000").select("page_id", "url")


@query("src03_include_types", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view', 'error')")
def src03(spark, sf_dir):
    return pages.include_types(read(spark, sf_dir, "events"), "event_type", ["click", "view"], True, ("error",)).select("event_id", "event_type")


@query(
    "src04_content_store",
    "SELECT doc_id, sha256(text) AS hash, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS n FROM documents",
)
def src04(spark, sf_dir):
    return incremental.content_store(read(spark, sf_dir, "documents"), "text", "doc_id")


@query(
    "src05_plan_misses",
    "SELECT doc_id, sha256(concat('v2', chr(31), lang, chr(31), text)) AS work_key FROM documents WHERE sha256(concat('v2', chr(31), lang, chr(31), text)) NOT IN (SELECT sha256(concat('v2', chr(31), lang, chr(31), text)) FROM documents WHERE doc_id % 3 = 0)",
)
def src05(spark, sf_dir):
    items = read(spark, sf_dir, "documents").select("doc_id", incremental.work_key(F.lit("v2"), F.col("lang"), F.col("text")).alias("work_key"))
    return incremental.plan_misses(items, items.where("doc_id % 3 = 0"))


@query("src06_compute_distinct", "SELECT fid, b, length(replace(replace(b, '{', ''), '}', '')) AS size FROM v_formulas")
def src06(spark, sf_dir):
    size = F.length(F.regexp_replace("b", "[{}]", ""))
    return incremental.compute_distinct(views.formulas(spark, sf_dir).select("fid", "b"), "b", "size", size)


@query("src07_export_bundle", "SELECT o_orderkey, o_orderstatus, o_custkey, concat('{\"price\":', cast(o_totalprice AS DECIMAL(18,2)), ',\"priority\":\"', o_orderpriority, '\"}') AS spec FROM orders")
def src07(spark, sf_dir):
    """Orders as a bundle of folders by status, one JSON spec an item, read back item by item."""
    orders = read(spark, sf_dir, "orders")
    spec = F.to_json(F.struct(F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.col("o_orderpriority").alias("priority")))
    bundle = incremental.export_bundle(orders.select("o_orderkey", "o_custkey", "o_orderstatus", spec.alias("spec")), f"{incremental.scratch(spark, 'bundle')}/items", "o_orderstatus")
    return bundle.select("o_orderkey", "o_orderstatus", "o_custkey", "spec")


@query(
    "src08_guard",
    r"SELECT coalesce(CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'scheme' WHEN length(html) > 6000 THEN 'size' WHEN regexp_matches(url, '#') THEN 'fragment' END, 'ok') AS reason, count(*) AS n FROM pages GROUP BY ALL",
)
def src08(spark, sf_dir):
    rules = [("scheme", ~F.col("url").rlike("^https?://")), ("size", F.length("html") > 6000), ("fragment", F.col("url").rlike("#"))]
    return incremental.guard(read(spark, sf_dir, "pages"), rules).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "src09_attach_evidence",
    """WITH e AS (SELECT fp, max(seq) AS edit, concat('r', min(vid)) AS region FROM v_versions WHERE item % 2 = 0 GROUP BY fp)
    SELECT item, seq, CASE WHEN v_versions.seq % 4 = e.edit % 4 THEN region END AS region FROM v_versions LEFT JOIN e USING (fp)""",
)
def src09(spark, sf_dir):
    versions = views.versions(spark, sf_dir)
    evidence = versions.where("item % 2 = 0").groupBy(F.col("fp").alias("hash")).agg((F.max("seq") % 4).alias("edit"), F.concat(F.lit("r"), F.min("vid")).alias("region"))
    return incremental.attach_evidence(versions.select("item", "seq", F.col("fp").alias("hash"), (F.col("seq") % 4).alias("edit")), evidence).select("item", "seq", "region")


@query(
    "so04_upsert",
    """WITH n AS (SELECT o_orderkey, 'X' AS o_orderstatus FROM orders WHERE o_orderkey % 5 = 0 AND o_orderstatus = 'P')
    SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL FROM n""",
)
def so04(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return incremental.upsert(orders, orders.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("X")), "o_orderkey", orders.where("o_orderstatus = 'P'"))


@query(
    "so05_reuse",
    """SELECT d.doc_id, d.doc_id % 4 > 0 AND p.doc_id IS NOT NULL AS reused, CASE WHEN d.doc_id % 4 > 0 AND p.doc_id IS NOT NULL THEN -1 ELSE length(d.text) END AS result
    FROM documents d LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0) p USING (doc_id)""",
)
def so05(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("input"))
    prior = docs.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.lit("old")).otherwise(F.col("input")).alias("input"), F.lit(-1).alias("result"))
    found = incremental.reuse_or_recompute(docs, prior, "doc_id", "input", "result", F.length("text"))
    return found.select("doc_id", F.coalesce("reused", F.lit(False)).alias("reused"), "result")


@query(
    "so07_append_renumbered",
    """WITH b AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS number, l_partkey AS item FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)), last AS (SELECT g, max(number) AS m FROM b GROUP BY g),
    p AS (SELECT o_orderkey AS g, unnest(range(3)) AS pos, unnest([o_orderkey % 3000, o_custkey, 7]) AS item FROM orders), k AS (SELECT p.* FROM p WHERE item IN (SELECT p_partkey FROM part))
    SELECT * FROM b UNION ALL SELECT g, coalesce(m, 0) + row_number() OVER (PARTITION BY g ORDER BY pos), item FROM k LEFT JOIN last USING (g)""",
)
def so07(spark, sf_dir):
    base = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_partkey").alias("item")).distinct()
    base = base.withColumn("number", F.expr("row_number() OVER (PARTITION BY g ORDER BY item)"))
    picks = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("g"), F.array(F.col("o_orderkey") % 3000, "o_custkey", F.lit(7).cast("long")).alias("picks"))
    return incremental.append_renumbered(base, read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item")), picks, "g")


@query(
    "wn23_history",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY seq DESC) - 1 AS age, lag(vid) OVER (PARTITION BY item ORDER BY seq) AS undo,
        coalesce(bool_or(status = 'F') OVER (PARTITION BY item ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS unknown FROM v_versions)
    SELECT item, vid, age, coalesce(undo, -1) AS undo, unknown FROM r WHERE age < 5""",
)
def wn23(spark, sf_dir):
    return incremental.history(views.versions(spark, sf_dir), 5).select("item", "vid", "age", F.coalesce("undo", F.lit(-1)).alias("undo"), "unknown")


@query(
    "wn24_approval_state",
    """WITH h AS (SELECT *, last_value(CASE WHEN status = 'O' THEN fp END IGNORE NULLS) OVER (PARTITION BY item ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM v_versions),
    s AS (SELECT *, CASE WHEN h IS NULL THEN 'pending' WHEN h = fp THEN 'approved' ELSE 'stale' END AS state FROM h) SELECT item, seq, state, state = 'approved' AND vid % 10 <> 0 AND vid % 7 <> 0 AS usable FROM s""",
)
def wn24(spark, sf_dir):
    rows = views.versions(spark, sf_dir).withColumns({"approved": F.col("status") == "O", "critical": F.col("vid") % 10 == 0, "missing": F.col("vid") % 7 == 0})
    return incremental.approval_state(rows)


@query(
    "ud01_read_batched",
    "SELECT doc_id, line_no, CASE WHEN trim(line) = '' OR (line_no % 18) = 17 THEN 'unreadable' ELSE concat(length(line), ':', line) END AS reading FROM v_lines",
)
def ud01(spark, sf_dir):
    """A reader that reads all but the eighteenth line of a batch and empty lines."""

    def reader(texts):
        return {i: f"{len(t)}:{t}" for i, t in enumerate(texts) if i != 17 and t.strip()}

    return read_batched(views.lines(spark, sf_dir), "doc_id", "line_no", "line", reader).select("doc_id", "line_no", "reading")
