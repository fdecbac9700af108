"""Queries of the request log operators, and their streaming twins over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources import views
from quire.sources.incremental import scratch
from quire.sources.tables import read
from quire.streaming import quota


@query(
    "ss01_quota_audit",
    """WITH r AS (SELECT *, count(*) OVER (PARTITION BY client, model ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS in_window FROM v_requests) SELECT rid, client, model, in_window FROM r WHERE in_window > 5""",
)
def ss01(spark, sf_dir):
    return quota.quota_audit(views.requests(spark, sf_dir), 86_400, 5).select("rid", "client", "model", "in_window")


_ADMIT = """WITH RECURSIVE r AS (SELECT rid, client, epoch_us(ts) AS t, row_number() OVER (PARTITION BY client ORDER BY ts, rid) AS i FROM v_requests),
    g AS (SELECT DISTINCT client, cast(0 AS BIGINT) AS i, cast(NULL AS BIGINT) AS rid, false AS accepted, cast(0 AS BIGINT) AS wait, cast([] AS BIGINT[]) AS held FROM r
        UNION ALL SELECT g.client, r.i, r.rid, len(h) < 5, CASE WHEN len(h) < 5 THEN 0 ELSE h[1] + 86400000000 - r.t END, CASE WHEN len(h) < 5 THEN list_append(h, r.t) ELSE h END
        FROM g JOIN r ON r.client = g.client AND r.i = g.i + 1, LATERAL (SELECT list_filter(g.held, lambda x: x > r.t - 86400000000) AS h))
    SELECT client, rid, accepted, wait FROM g WHERE i > 0"""


@query("ss02_admit", _ADMIT)
def ss02(spark, sf_dir):
    return quota.admit(views.requests(spark, sf_dir), 5, 86_400)


_ORDER = [("purchase", 60, 0), ("signup", 60, 1), ("click", 60, 2), ("view", 60, 3), ("error", 60, 4)]


@query(
    "ss03_daily_cap",
    """WITH c(model, cap, place) AS (VALUES ('purchase', 60, 0), ('signup', 60, 1), ('click', 60, 2), ('view', 60, 3), ('error', 60, 4)), r AS (SELECT *, date_trunc('day', ts) AS day, row_number() OVER (PARTITION BY date_trunc('day', ts), model ORDER BY ts, rid) AS k FROM v_requests),
    o AS (SELECT day, model, place, count(*) AS n, min(rid) FILTER (k = cap + 1) AS first_over FROM r JOIN c USING (model) GROUP BY ALL HAVING count(*) > max(cap)) SELECT cast(day AS TIMESTAMP) AS day, o.model, n, first_over, coalesce(c.model, '') AS next_model FROM o LEFT JOIN c ON c.place = o.place + 1""",
)
def ss03(spark, sf_dir):
    return quota.daily_cap(views.requests(spark, sf_dir), spark.createDataFrame(_ORDER, "model string, cap int, place int"))


@query("ss04_breaker", "SELECT event_id AS rid, user_id, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) >= 2 AS switched FROM events")
def ss04(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("rid"), "user_id", "ts", (F.col("event_type") == "error").alias("error"))
    return quota.breaker(rows, "user_id").select("rid", "user_id", "switched")


@query(
    "ss05_expire",
    "WITH l AS (SELECT user_id, max(ts) AS last FROM events WHERE event_type <> 'view' GROUP BY user_id) SELECT user_id, last FROM l WHERE last < (SELECT max(ts) FROM events) - INTERVAL 12 HOURS AND user_id NOT IN (SELECT user_id FROM events WHERE value > 489)",
)
def ss05(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return quota.expire(events.where("event_type <> 'view'"), events.where("value > 489"), "user_id", now)


@query("ss07_progress", "SELECT event_id AS rid, user_id, round(count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / nullif(count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id), 0), 6) AS share FROM events")
def ss07(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("rid"), "user_id", "ts", (F.col("event_type") == "purchase").alias("done"))
    return quota.progress(rows, "user_id", "done").select("rid", "user_id", "share")


def _streamed(spark, sf_dir, plan, mode: str):
    """Run plan on the events as a stream of files, a fifth of the time after the other and unordered within, until all are read;
    return what it wrote. Each part is written by many tasks and taken up by a run that goes on where the last one ended."""
    events = read(spark, sf_dir, "events").select(F.col("event_id").alias("rid"), F.col("user_id").alias("client"), F.col("event_type").alias("model"), F.col("ts").cast("timestamp").alias("ts"))
    base = scratch(spark, "stream")
    first, last = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    slices = 5
    for i in range(slices):
        of_slice = F.least(F.floor((F.unix_micros("ts") - first) * slices / max(1, last - first)), F.lit(slices - 1)) == i
        events.where(of_slice).repartition(F.xxhash64("rid")).sortWithinPartitions(F.xxhash64("rid")).write.mode("append").parquet(f"{base}/in")
        stream = plan(spark.readStream.schema(events.schema).parquet(f"{base}/in"))
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


# What a stream has put out when it has read all: what ends before the watermark, ten minutes before the last event.
_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTES FROM events)"


_CLOSED_US = "(SELECT epoch_us(max(ts)) - 600000000 FROM events)"


@query("ss02_admit_stream", f"SELECT a.* FROM ({_ADMIT}) a JOIN v_requests USING (rid) WHERE epoch_us(ts) < {_CLOSED_US}")
def ss02_stream(spark, sf_dir):
    """All requests that the watermark has passed, out of order in several batches, judged as the batch form judges them."""
    return _streamed(spark, sf_dir, lambda s: quota.admit_stream(s, 5, 86_400, late="10 minutes"), "append")


_FIRSTS = """WITH RECURSIVE r AS (SELECT event_id AS rid, user_id AS client, event_type AS model, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
    g AS (SELECT client, model, i, rid, t AS done, true AS fresh FROM r WHERE i = 1
        UNION ALL SELECT r.client, r.model, r.i, r.rid, CASE WHEN r.t >= g.done + 86400000000 THEN r.t ELSE g.done END, r.t >= g.done + 86400000000 FROM g JOIN r ON r.client = g.client AND r.model = g.model AND r.i = g.i + 1)
    SELECT client, model, rid FROM g WHERE fresh"""


@query("ss06_dedupe", _FIRSTS)
def ss06_batch(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(F.col("event_id").alias("rid"), F.col("user_id").alias("client"), F.col("event_type").alias("model"), "ts")
    return quota.dedupe_stream(events, ["client", "model"], 86_400)


@query("ss06_dedupe_stream", f"SELECT f.* FROM ({_FIRSTS}) f JOIN events ON rid = event_id WHERE epoch_us(ts) < {_CLOSED_US}")
def ss06(spark, sf_dir):
    """The first of each kind of work, and again a day after it was done: retention passes between batches."""
    return _streamed(spark, sf_dir, lambda s: quota.dedupe_stream(s, ["client", "model"], 86_400), "append")


@query(
    "ss01_quota_stream",
    f"""WITH w AS (SELECT time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 12 HOURS AS s, user_id AS client, event_type AS model FROM events, (SELECT unnest([0, 1]) AS k))
    SELECT s AS start, s + INTERVAL 24 HOURS AS "end", client, model, count(*) AS n FROM w WHERE s + INTERVAL 24 HOURS <= {_CLOSED} GROUP BY ALL HAVING count(*) > 2""",
)
def ss01_stream(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda s: quota.quota_stream(s, "1 day", "12 hours", 2), "append")


@query(
    "ss05_sessions_stream",
    f"""WITH l AS (SELECT user_id AS client, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOURS, true) AS new FROM events), s AS (SELECT *, sum(cast(new AS INT)) OVER (PARTITION BY client ORDER BY ts) AS k FROM l)
    SELECT min(ts) AS start, max(ts) + INTERVAL 12 HOURS AS "end", client, count(*) AS n FROM s GROUP BY client, k HAVING max(ts) + INTERVAL 12 HOURS <= {_CLOSED}""",
)
def ss05_stream(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda s: quota.sessions_stream(s, "client"), "append")


@query(
    "ss07_progress_stream",
    f"SELECT cast(date_trunc('day', ts) AS TIMESTAMP) AS start, user_id AS client, count(*) FILTER (event_type = 'purchase') AS done, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {_CLOSED} GROUP BY ALL",
)
def ss07_stream(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda s: quota.progress_stream(s.withColumn("done", F.col("model") == "purchase"), "client", "done"), "append")


@query(
    "ss08_ingest_stream",
    "SELECT conv_id * 1000 + turn AS page_id, 'question' AS page_type, 0 AS block, -1 AS par, 0 AS line, 0 AS seg, 'text' AS type, text AS value, false AS bold, false AS underline FROM conversations",
)
def ss08(spark, sf_dir):
    """Conversations as page JSON files, ingested as a stream twice: the second run adds nothing."""
    from quire.sources.pages import SEGMENT
    from quire.streaming.ingest import committed, ingest_stream

    base = scratch(spark, "ingest")
    segment = F.struct(F.lit("text").alias("type"), F.col("text").alias("value"), F.lit(False).alias("bold"), F.lit(False).alias("underline"))
    nested = F.lit(None).cast(f"array<array<array<{SEGMENT}>>>")
    block = F.struct(F.lit("paragraph").alias("kind"), F.col("role").alias("label"), F.lit(0).alias("level"), F.array(F.array(segment)).alias("lines"), nested.alias("paragraphs"), nested.alias("rows"))
    page_id = F.col("conv_id") * 1000 + F.col("turn")
    read(spark, sf_dir, "conversations").select(F.to_json(F.struct(page_id.alias("page_id"), F.lit("question").alias("page_type"), F.array(block).alias("blocks"))).alias("value")).write.text(f"{base}/in")
    for run in ("first", "second"):
        ingest_stream(spark, f"{base}/in", f"{base}/out", f"{base}/{run}").awaitTermination()
    return committed(spark, f"{base}/out").drop("work_key", "commit")
