"""Helpers that the training-data operators share: tables in the shared folder and vectorised substring hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only an unset setting in local mode gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once in the shared folder and read it back: a short lineage that outlives lost executors. The table goes
    when the driver's file system is closed, at the end of the application."""
    path = f"{shared_folder(df.sparkSession)}/quire/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    context = df.sparkSession.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Rows are whole texts, so that the usual 10,000 of them would fill a worker's memory: from now on batches for Python
    hold BATCH_ROWS rows, unless the session has a number of its own."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, BATCH_ROWS)


def fold(doc_id, folds: int):
    """crc32 of the id as text, modulo folds (null id: the crc32 of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def utf8_rows(column: pa.Array) -> list[bytes]:
    """Whole texts as UTF-8 bytes; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunked(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, one text at least."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16) * 5 // 4
        steps = np.full(size, _BASE if kind == "up" else _BASE_INVERSE, dtype=np.uint64)
        steps[0] = 1
        _powers[kind] = have = np.multiply.accumulate(steps)
    return have[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Substrings:
    """Hashes of any substrings of a buffer in constant time each, from one running polynomial sum."""

    def __init__(self, codes: np.ndarray):
        self.running = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(codes * _power("up", len(codes)), out=self.running[1:])

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.running[end] - self.running[begin]) * _power("down", len(self.running))[begin]
        return mix64(h + (end - begin).astype(np.uint64) * _BASE)


def byte_hashes(data: np.ndarray) -> Substrings:
    return Substrings(_BYTE_CODES[data])


class Words:
    """The white-space words of a chunk of texts, joined by single spaces in one buffer."""

    def __init__(self, texts: list[bytes]):
        lists = [t.split() for t in texts]
        self.counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        self.bounds = np.concatenate(([0], np.cumsum(self.counts)))
        self.buffer = b" ".join(chain.from_iterable(lists))
        data = np.frombuffer(self.buffer, dtype=np.uint8)
        gaps = np.flatnonzero(data == 32)
        self.begin = np.concatenate(([0], gaps + 1)) if len(data) else np.zeros(0, dtype=np.int64)
        self.end = np.concatenate((gaps, [len(data)])) if len(data) else np.zeros(0, dtype=np.int64)
        self.substrings = byte_hashes(data)
        self.row = np.repeat(np.arange(len(lists)), self.counts)

    def hashes(self, n: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words within one text, and the index of each run's first word."""
        if len(self.begin) < n:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        first = np.arange(len(self.begin) - n + 1)
        first = first[self.row[first] == self.row[first + n - 1]]
        return self.substrings.hash(self.begin[first], self.end[first + n - 1]), first


BLOCK_BITS = 20


def set_bits(positions: DataFrame, n_bits: int) -> np.ndarray:
    """A bit array of n_bits (a multiple of 2**BLOCK_BITS) with the bits in column `position` set.

    A block of 2**BLOCK_BITS bits is built from its distinct positions, at most as many; the array that reaches the
    driver has n_bits / 8 bytes, whatever the input.
    """

    def block(frame):
        import pandas as pd

        bits = np.zeros(1 << BLOCK_BITS, dtype=np.uint8)
        bits[frame["position"].to_numpy() & ((1 << BLOCK_BITS) - 1)] = 1
        return pd.DataFrame({"block": [int(frame["position"].iloc[0]) >> BLOCK_BITS], "bits": [np.packbits(bits).tobytes()]})

    grouped = positions.select("position").distinct().groupBy(F.shiftright("position", BLOCK_BITS).alias("b"))
    out = np.zeros((n_bits >> BLOCK_BITS, 1 << (BLOCK_BITS - 3)), dtype=np.uint8)
    for row in grouped.applyInPandas(block, "block long, bits binary").collect():
        out[row["block"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out.reshape(-1)


def has_bits(bits: np.ndarray, position: np.ndarray) -> np.ndarray:
    return (bits[(position >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (position & np.uint64(7)).astype(np.uint8))) & 1 == 1
