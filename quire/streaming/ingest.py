"""A stream of page files that computes what is missing and commits each batch once."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.sources.incremental import plan_misses, work_key
from quire.sources.pages import PAGE, segments

_KEYS = "work_key string, page_id bigint, commit string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    spark.createDataFrame([], schema).write.mode("append").partitionBy("commit").parquet(path)
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def _rows_schema(spark: SparkSession) -> str:
    return f"work_key string, {', '.join(f'{n} {t}' for n, t in segments(spark.createDataFrame([], PAGE)).dtypes)}, commit string"


def committed(spark: SparkSession, results: str) -> DataFrame:
    """SS-08: (work_key, segment columns..., commit): the rows of batches that were committed. What a batch wrote before it
    failed doesn't count."""
    done = _read(spark, f"{results}/manifest", _KEYS).select("commit").distinct()
    return _read(spark, f"{results}/rows", _rows_schema(spark)).join(done, "commit", "left_semi")


def commit(keys: DataFrame, results: str, name: str) -> None:
    """Put the keys of a batch in the manifest: from now on its rows count, and its pages are done, with segments or without."""
    keys.select("work_key", "page_id", F.lit(name).alias("commit")).coalesce(1).write.mode("append").partitionBy("commit").parquet(f"{results}/manifest")


def merge_batch(batch: DataFrame, results: str, name: str, version: str) -> None:
    """Write the segments of a batch's pages whose key isn't in the manifest, in a folder of the batch's own that a second
    try replaces, and then commit. A batch that is in the manifest is left as it is."""
    spark = batch.sparkSession
    manifest = _read(spark, f"{results}/manifest", _KEYS)
    if not manifest.where(F.col("commit") == name).isEmpty():
        return
    keyed = batch.withColumn("work_key", work_key(F.lit(version), F.lit("pages"), F.to_json(F.struct(*batch.columns)))).dropDuplicates(["work_key"])
    misses = plan_misses(keyed, manifest).persist()
    try:
        segments(misses, "work_key").write.mode("overwrite").parquet(f"{results}/rows/commit={name}")
        commit(misses, results, name)
    finally:
        misses.unpersist()


def ingest_stream(spark: SparkSession, path: str, results: str, checkpoint: str, version: str = "v1", files: int = 1000) -> StreamingQuery:
    """SS-08: read page JSON as it comes, `files` files a batch, and add the segments of pages whose key has no result yet; read
    them by `committed`. Pages are keyed by version and content, so two contents of a page are two pieces of work, and a
    page without segments is done too. A batch counts when its name, that of the checkpoint and the batch, is in the
    manifest: one that fails half-way or runs again neither repeats nor loses rows. Only keys are read of what is done.
    Ends when all files at hand are read."""
    run = f"{zlib.crc32(checkpoint.encode()):08x}"
    stream = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files).json(path)
    merge = lambda batch, number: merge_batch(batch, results, f"{run}-{number}", version)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
