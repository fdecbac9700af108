"""Request logs: sliding quotas, admission, daily caps, breakers, expiry, duplicate work and progress; batch and stream."""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _micros():
    return F.unix_micros(F.col("ts").cast("timestamp"))


def quota_audit(requests: DataFrame, seconds: int, limit: int) -> DataFrame:
    """SS-01: requests of which more than `limit` of their client and model fall in the `seconds` up to them, with that
    number. Time is cut in pieces of that length, and each piece sees the one before too, so a client with most of the
    requests is counted in many tasks."""
    us = seconds * 1_000_000
    own = F.floor(_micros() / us)
    dealt = requests.withColumn("_t", _micros()).withColumn("_own", own).withColumn("_piece", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    by = Window.partitionBy("client", "model", "_piece").orderBy("_t").rangeBetween(-us + 1, 0)
    return dealt.withColumn("in_window", F.count("*").over(by)).where((F.col("_piece") == F.col("_own")) & (F.col("in_window") > limit)).drop("_t", "_own", "_piece")


def quota_stream(requests: DataFrame, window: str, slide: str, limit: int, late: str = "10 minutes") -> DataFrame:
    """SS-01 on a stream: sliding windows of a client and model with more than `limit` requests."""
    counted = requests.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "client", "model").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > limit).select("window.start", "window.end", "client", "model", "n")


def admit(requests: DataFrame, n: int, seconds: int) -> DataFrame:
    """SS-02: (client, rid, accepted, wait): a request is accepted if fewer than n of its client were accepted in the
    `seconds` before; else it waits until the oldest of those leaves. The requests of a client are sorted by time and
    streamed through; what is held is the last n accepted times, however many requests there are."""
    us = seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque = deque()
        last = object()
        for batch in batches:
            accepted, wait = [], []
            for client, t in zip(batch.column("client").to_pylist(), batch.column("t").to_pylist(), strict=True):
                if client != last:
                    held, last = deque(), client
                while held and held[0] <= t - us:
                    held.popleft()
                accepted.append(len(held) < n)
                wait.append(0 if accepted[-1] else held[0] + us - t)
                if accepted[-1]:
                    held.append(t)
            yield pa.RecordBatch.from_arrays([batch.column("client"), batch.column("rid"), pa.array(accepted, pa.bool_()), pa.array(wait, pa.int64())], names=["client", "rid", "accepted", "wait"])

    timed = requests.select(F.col("client").cast("bigint").alias("client"), F.col("rid").cast("bigint").alias("rid"), _micros().alias("t"))
    return timed.repartition("client").sortWithinPartitions("client", "t", "rid").mapInArrow(run, "client bigint, rid bigint, accepted boolean, wait bigint")


BUCKETS = 1024


def _in_order(requests: DataFrame, keys: list[str], n: int, seconds: int, late: str) -> DataFrame:
    """(keys..., rid, accepted, wait) of a stream of (keys..., rid, ts), judged as admit does, in order of time whatever the
    order of arrival: requests wait in the state until the watermark has passed them. Keys are dealt to BUCKETS by hash and
    a state holds those of a bucket, so a batch makes as many calls however many keys there are. It has of each key the
    requests that wait and the last accepted times; a key goes when nothing waits and no accepted time counts any more."""
    us = seconds * 1_000_000
    key = requests.select(F.struct(*keys).alias("k")).schema["k"].dataType

    def run(bucket, frames: Iterator, state) -> Iterator:
        import pandas as pd

        held = pickle.loads(state.get[0]) if state.exists else {}  # key: accepted times, and (time, rid) of those that wait
        for frame in frames:
            for k, t, rid in zip(frame["k"].tolist(), frame["t"].tolist(), frame["rid"].tolist(), strict=True):
                held.setdefault(k, ([], []))[1].append((t, rid))
        now = state.getCurrentWatermarkMs() * 1000
        rows, next_at = [], None
        for k, (times, waiting) in list(held.items()):
            waiting.sort()
            accepted, done = deque(times), bisect_left(waiting, (now,))
            for t, rid in waiting[:done]:
                while accepted and accepted[0] <= t - us:
                    accepted.popleft()
                ok = len(accepted) < n
                rows.append((k, rid, ok, 0 if ok else accepted[0] + us - t))
                if ok:
                    accepted.append(t)
            if done < len(waiting) or accepted and accepted[-1] + us > now:
                held[k] = (list(accepted), waiting[done:])
                at = waiting[done][0] if done < len(waiting) else accepted[-1] + us
                next_at = at if next_at is None else min(next_at, at)
            else:
                del held[k]
        if held:
            state.update((pickle.dumps(held),))
            state.setTimeoutTimestamp(max(next_at, now) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["k", "rid", "accepted", "wait"])

    timed = requests.select(*keys, F.col("rid").cast("bigint").alias("rid"), "ts").withWatermark("ts", late)
    dealt = timed.select(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("bucket"), F.to_json(F.struct(*keys), _EXACT).alias("k"), "rid", "ts", _micros().alias("t"))
    judged = dealt.groupBy("bucket").applyInPandasWithState(run, "k string, rid bigint, accepted boolean, wait bigint", "held binary", "append", "EventTimeTimeout")
    return judged.select(F.from_json("k", key, _EXACT).alias("k"), "rid", "accepted", "wait").select("k.*", "rid", "accepted", "wait")


_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def admit_stream(requests: DataFrame, n: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """SS-02 on a stream: (client, rid, accepted, wait) as admit gives them, once the watermark has passed a request, however
    requests are spread over batches and frames. Later ones than `late` are dropped."""
    return _in_order(requests, ["client"], n, seconds, late)


def daily_cap(requests: DataFrame, caps: DataFrame) -> DataFrame:
    """SS-03: (day, model, n, first_over, next_model) of the days on which a model had more requests than its cap, with the
    first one over it and the model after it in the order of caps(model, cap, place).

    Requests are counted by minute first; only the minute in which the cap is crossed is put in order, so no task sorts a
    day of a model."""
    rows = requests.select("model", F.date_trunc("day", "ts").alias("day"), F.date_trunc("minute", "ts").alias("_minute"), "ts", "rid")
    minutes = rows.groupBy("day", "model", "_minute").agg(F.count("*").alias("_c")).join(caps, "model")
    by = Window.partitionBy("day", "model")
    upto = F.sum("_c").over(by.orderBy("_minute"))
    crossed = minutes.withColumns({"n": F.sum("_c").over(by), "_at": F.col("cap") + 1 - (upto - F.col("_c")), "_in": upto > F.col("cap")}).where("n > cap AND _in AND _at > 0")
    nth = rows.join(crossed, ["day", "model", "_minute"]).withColumn("_k", F.row_number().over(Window.partitionBy("day", "model", "_minute").orderBy("ts", "rid"))).where("_k = _at")
    after = caps.select((F.col("place") - 1).alias("place"), F.col("model").alias("next_model"))
    return nth.join(after, "place", "left").select("day", "model", "n", F.col("rid").alias("first_over"), F.coalesce("next_model", F.lit("")).alias("next_model"))


def _running_count(rows: DataFrame, key: str, flag: str, name: str) -> DataFrame:
    """rows(key, ts, rid, flag) plus how many flagged ones of the key there are up to each. Days are counted first and then
    summed, so the rows of a key are put in order a day at a time."""
    rows = rows.withColumn("_day", F.coalesce(F.date_trunc("day", "ts"), F.lit("0001-01-01").cast("timestamp_ntz")).cast("date"))
    days = rows.groupBy(key, "_day").agg(F.count_if(flag).alias("_c"))
    days = days.withColumn("_before", F.sum("_c").over(Window.partitionBy(key).orderBy("_day")) - F.col("_c")).drop("_c")
    upto = Window.partitionBy(key, "_day").orderBy("ts", "rid").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(days, [key, "_day"]).withColumn(name, F.col("_before") + F.count_if(flag).over(upto)).drop("_day", "_before")


def breaker(events: DataFrame, key: str, n: int = 2) -> DataFrame:
    """SS-04: events plus switched: from the n-th error of the key on. Null keys are left out."""
    return _running_count(events, key, "error", "_errors").withColumn("switched", F.col("_errors") >= n).drop("_errors")


def expire(sessions: DataFrame, active: DataFrame, key: str, now, hours: int = 12) -> DataFrame:
    """SS-05: (key, last) of sessions without activity for longer than `hours`, never the active ones."""
    last = sessions.groupBy(key).agg(F.max("ts").alias("last"))
    old = last.where(F.col("last") < now - F.expr(f"INTERVAL {hours} HOURS"))
    return old.join(active.select(key).distinct(), key, "left_anti")


def sessions_stream(events: DataFrame, key: str, gap: str = "12 hours", late: str = "10 minutes") -> DataFrame:
    """SS-05 on a stream: sessions that ended because nothing came for `gap`."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return found.select("session_window.start", "session_window.end", key, "n")


def dedupe_stream(work: DataFrame, keys: list[str], retention: int, late: str = "10 minutes") -> DataFrame:
    """SS-06: (keys..., rid) of the work(keys..., rid, ts) that is to be done: the first of the same keys by time, and again the first
    that comes `retention` seconds or more after one that was done. On a stream in order of time too, and a row comes out once
    the watermark has passed it; on a batch the rows of a key are sorted and streamed through."""
    if work.isStreaming:
        judged = _in_order(work, keys, 1, retention, late)
    else:
        named = work.select(F.xxhash64(*keys).alias("client"), "rid", "ts")
        judged = admit(named, 1, retention).where("accepted").select("rid").join(work, "rid").withColumn("accepted", F.lit(True))
    return judged.where("accepted").select(*keys, "rid")


def progress(events: DataFrame, job: str, done: str) -> DataFrame:
    """SS-07: events plus share: how much of the job's finishing events have come so far. Null jobs are left out."""
    every = events.groupBy(job).agg(F.count_if(done).alias("_all"))
    counted = _running_count(events, job, done, "_done").join(every, job)
    return counted.withColumn("share", F.round(F.col("_done") / F.nullif("_all", F.lit(0)), 6)).drop("_done", "_all")


def progress_stream(events: DataFrame, job: str, done: str, every: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """SS-07 on a stream: finished and all events of a job by tumbling window."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", every), job).agg(F.count_if(F.col(done)).alias("done"), F.count("*").alias("n"))
    return counted.select("window.start", job, "done", "n")
