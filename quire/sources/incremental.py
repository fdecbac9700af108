"""Content stores, cache plans, merges and version histories: computing again only what has changed."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only if unset in local mode, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes at the end of the application."""
    path = f"{shared_folder(spark)}/quire/{name}-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(folder)
    system.deleteOnExit(folder)
    return path


def stored_checkpoint(df: DataFrame) -> DataFrame:
    """df written in the shared folder and read back."""
    path = f"{scratch(df.sparkSession, 'checkpoint')}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def content_store(df: DataFrame, content: str, key: str) -> DataFrame:
    """SRC-04: (key, hash, first_id, n) for every row: equal content is stored once under its first id, and the rows of
    other ids are its aliases. Aliases are rows, so that content that a third of all rows have is no list of them."""
    rows = df.select(key, F.sha2(F.col(content), 256).alias("hash"))
    return rows.join(rows.groupBy("hash").agg(F.min(key).alias("first_id"), F.count("*").alias("n")), "hash").select(key, "hash", "first_id", "n")


def work_key(version: Column, params: Column, content: Column) -> Column:
    """The key of a piece of work: version, parameters and content."""
    return F.sha2(F.concat_ws("\x1f", version, params, content), 256)


def plan_misses(items: DataFrame, done: DataFrame, key: str = "work_key") -> DataFrame:
    """SRC-05: items whose key has no result yet."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def compute_distinct(df: DataFrame, column: str, result: str, expression: Column) -> DataFrame:
    """SRC-06: df plus result, computed once for each distinct value of the column."""
    return df.join(df.select(column).distinct().withColumn(result, expression), column, "left")


def guard(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """SRC-08: df plus reason: the first rule that a row breaks, null if none. Rows with a reason go to quarantine."""
    return df.withColumn("reason", reduce(lambda chain, rule: chain.when(rule[1], rule[0]), rules[1:], F.when(rules[0][1], rules[0][0])))


def attach_evidence(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """SRC-09: items(item, hash, edit) plus region: their evidence(hash, edit, region) by content hash, never by number; empty
    when the edit has changed."""
    found = evidence.select("hash", F.col("edit").alias("_edit"), F.col("region").alias("_region"))
    joined = items.join(found, "hash", "left")
    return joined.withColumn("region", F.when(F.col("edit") == F.col("_edit"), F.col("_region"))).drop("_edit", "_region")


def export_bundle(df: DataFrame, path: str, partition: str) -> DataFrame:
    """SRC-07: write a folder for each item and read the bundle back."""
    df.write.mode("overwrite").partitionBy(partition).parquet(path)
    return df.sparkSession.read.parquet(path)


def upsert(existing: DataFrame, new: DataFrame, key: str, only: DataFrame | None = None) -> DataFrame:
    """SO-04: existing rows with those of `new` in place of theirs; with `only`, new rows of other keys are ignored."""
    taken = new if only is None else new.join(only.select(key).distinct(), key, "left_semi")
    return existing.join(taken.select(key).distinct(), key, "left_anti").unionByName(taken)


def reuse_or_recompute(items: DataFrame, prior: DataFrame, key: str, input_key: str, result: str, expression: Column) -> DataFrame:
    """SO-05: items plus result and reused: the prior result where the input is unchanged, else the expression."""
    before = prior.select(key, F.col(input_key).alias("_input"), F.col(result).alias("_result"))
    same = F.col("_input").eqNullSafe(F.col(input_key)) & F.col("_input").isNotNull()
    joined = items.join(before, key, "left")
    return joined.withColumn(result, F.when(same, F.col("_result")).otherwise(expression)).withColumn("reused", same).drop("_input", "_result")


def append_renumbered(base: DataFrame, pool: DataFrame, picks: DataFrame, group: str) -> DataFrame:
    """SO-07: base(group, number, item) and then the picked items of pool(item) in picking order, numbered on from the last
    number. picks(group, picks array); picks that the pool lacks are skipped."""
    last = base.groupBy(group).agg(F.max("number").alias("_last"))
    chosen = picks.select(group, F.posexplode("picks").alias("_pos", "item")).join(pool.select("item").distinct(), "item", "left_semi").join(last, group, "left")
    number = F.coalesce("_last", F.lit(0)) + F.row_number().over(Window.partitionBy(group).orderBy("_pos"))
    return base.select(group, "number", "item").unionByName(chosen.select(group, number.alias("number"), "item"))


def history(versions: DataFrame, keep: int = 20) -> DataFrame:
    """WN-23: the last `keep` versions of each item, newest first (age 0), with the version an undo leads to. A version
    older than those kept, or any after a failed one ("F" by status), has an unknown chain."""
    by = Window.partitionBy("item").orderBy("seq")
    age = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("seq"))) - 1
    rows = versions.withColumns({"age": age, "undo": F.lag("vid").over(by), "unknown": F.coalesce(F.bool_or(F.col("status") == "F").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))})
    return rows.where(F.col("age") < keep)


def approval_state(versions: DataFrame) -> DataFrame:
    """WN-24: (item, seq, state, usable) of versions(item, seq, fp, approved, critical, missing): an approval holds as long as
    the fingerprint is the approved one's; then the version is usable if nothing is critical or missing."""
    by = Window.partitionBy("item").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("approved"), F.col("fp")), ignorenulls=True).over(by)
    state = F.when(held.isNull(), "pending").when(held == F.col("fp"), "approved").otherwise("stale")
    return versions.withColumn("state", state).select("item", "seq", "state", ((F.col("state") == "approved") & ~F.col("critical") & ~F.col("missing")).alias("usable"))
