"""Media columns: content-addressed payloads in tar shards, described by digest, offset and length."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import bounded_batches, set_bits, shared_folder, stored, utf8_rows

UNIT_BYTES = 64
SHARD_BYTES = 128 << 20
SEEN_DIGESTS, FILTER_BITS = 100_000, 27
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(text: bytes) -> bytes:
    """The bytes, then zeros up to a positive multiple of UNIT_BYTES."""
    return text + bytes(-len(text) % UNIT_BYTES if text else UNIT_BYTES)


def payload_digest(text: Column) -> tuple[Column, Column]:
    """(bytes of the UTF-8 text, SHA-256 of its padded payload) as built-in expressions."""
    data = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    n = F.octet_length(data)
    pad = F.when(n == 0, UNIT_BYTES).otherwise(F.pmod(-n, F.lit(UNIT_BYTES)))
    return n.cast("long"), F.sha2(F.concat(data, F.unhex(F.repeat(F.lit("00"), pad))), 256)


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A lossless grey image of one line whose 8-bit samples are the payload."""
    header = struct.pack(">IIBBBBB", len(payload), 1, 8, 0, 0, 0, 0)
    return _SIGNATURE + _part(b"IHDR", header) + _part(b"IDAT", zlib.compress(b"\0" + payload, 6)) + _part(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits a sample) from the first HEADER_BYTES bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of an image that to_png wrote."""
    width, height, _ = png_header(data)
    at, packed = 8, []
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        if data[at + 4 : at + 8] == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    lines = zlib.decompress(b"".join(packed))
    if len(lines) != height * (width + 1) or any(lines[i * (width + 1)] for i in range(height)):
        raise ValueError("only unfiltered lines are read")
    return b"".join(lines[i * (width + 1) + 1 : (i + 1) * (width + 1)] for i in range(height))


class _Shards:
    """Writes images into tar shards of a folder, under names of its own."""

    def __init__(self, folder: str):
        self.folder, self.out, self.at, self.shard = folder, None, 0, ""
        self.fs, self.base = pyarrow.fs.FileSystem.from_uri(folder)

    def add(self, digest: str, image: bytes) -> tuple[str, str, int, int, str]:
        if self.out is None or self.at > SHARD_BYTES:
            self.close()
            self.fs.create_dir(self.base, recursive=True)
            self.shard, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.base}/{self.shard}")
        member = tarfile.TarInfo(f"{digest}.png")
        member.size = len(image)
        self.out.write(member.tobuf(tarfile.USTAR_FORMAT))
        self.out.write(image)
        self.out.write(bytes(-len(image) % 512))
        row = (digest, f"{self.folder}/{self.shard}", self.at + 512, len(image), hashlib.sha256(image).hexdigest())
        self.at += 512 + len(image) + -len(image) % 512
        return row

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()


_INDEX = pa.schema([("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("media_sha256", pa.string())])
_IMAGES = pa.schema([("digest", pa.string()), ("image", pa.binary())])
_INDEX_SQL = "digest string, shard string, offset long, length long, media_sha256 string"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], names=schema.names)


def store_payloads(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store each distinct payload of docs(text) once; the index (digest, shard, offset, length, media_sha256).

    A first scan counts digests and sets the bits of the repeated ones in a filter of fixed size, 2**FILTER_BITS bits. A
    second one writes the payloads whose bit isn't set where it reads them. A third takes the others, once a task as far
    as SEEN_DIGESTS remembers them, to be shuffled by digest and written once; so many copies of one payload don't meet.

    A task writes tar shards of about SHARD_BYTES under names of its own; the stored index lists those of the tasks that
    succeeded, so a task that is lost and run again does no harm. folder: a shared one that Arrow's file systems reach,
    by default below spark.checkpoint.dir.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/quire/media-{uuid.uuid4().hex}"
    _, digest = payload_digest(F.col("text"))
    repeated = docs.groupBy(digest.alias("digest")).agg(F.count("*").alias("n")).where("n > 1")
    position = F.shiftright(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), 32 - FILTER_BITS)
    bits = spark.sparkContext.broadcast(set_bits(repeated.select(position.alias("position")), 1 << FILTER_BITS))
    def occurs_once(digest: bytes) -> bool:
        place = int.from_bytes(digest[:4], "big") >> (32 - FILTER_BITS)
        return not bits.value[place >> 3] >> (7 - (place & 7)) & 1

    def write_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(folder)
        for batch in batches:
            payloads = [padded(t) for t in utf8_rows(batch.column("text"))]
            digests = [hashlib.sha256(p) for p in payloads]
            yield _batch([shards.add(d.hexdigest(), to_png(p)) for p, d in zip(payloads, digests, strict=True) if occurs_once(d.digest())], _INDEX)
        shards.close()

    def encode_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for payload in map(padded, utf8_rows(batch.column("text"))):
                digest = hashlib.sha256(payload).digest()
                if digest not in seen and not occurs_once(digest):
                    if len(seen) >= SEEN_DIGESTS:
                        seen.clear()
                    seen.add(digest)
                    rows.append((digest.hex(), to_png(payload)))
            yield _batch(rows, _IMAGES)

    def write_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, last = _Shards(folder), None
        for batch in batches:
            rows = []
            for digest, image in zip(batch.column("digest").to_pylist(), batch.column("image").to_pylist(), strict=True):
                if digest != last:
                    rows.append(shards.add(digest, image))
                last = digest
            yield _batch(rows, _INDEX)
        shards.close()

    texts = docs.select(F.col("text").cast("string"))
    single = texts.mapInArrow(write_single, _INDEX_SQL)
    repeated_images = texts.mapInArrow(encode_repeated, "digest string, image binary").repartition("digest").sortWithinPartitions("digest")
    return stored(single.unionAll(repeated_images.mapInArrow(write_once, _INDEX_SQL)), "media-index")


def _read(index: DataFrame, columns: str, types: list[pa.DataType], row) -> DataFrame:
    """index plus `columns`, which row(open file, offset, length) returns; a shard is opened once a run of its rows."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file = None, None
        for batch in batches:
            found = []
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if shard != opened:
                    fs, path = pyarrow.fs.FileSystem.from_uri(shard)
                    opened, file = shard, fs.open_input_file(path)
                found.append(row(file, offset, length))
            values = zip(*found, strict=True) if found else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, t) for v, t in zip(values, types, strict=True))], names=[*batch.schema.names, *names])

    schema = ", ".join(f"{n} {t}" for n, t in index.dtypes)
    return index.mapInArrow(run, f"{schema}, {columns}")


def with_metadata(index: DataFrame) -> DataFrame:
    """index plus width, height and depth; of each image only the header's bytes are read."""
    return _read(index, "width long, height long, depth long", [pa.int64()] * 3, lambda file, offset, length: png_header(file.read_at(min(length, HEADER_BYTES), offset)))


def with_features(index: DataFrame) -> DataFrame:
    """index plus what the stored bytes hold: size and SHA-256 of the payload, CRC-32 of its last UNIT_BYTES bytes, and
    as feature how many samples have each value of their high four bits."""

    def row(file, offset: int, length: int) -> tuple:
        payload = from_png(file.read_at(length, offset))
        counts = np.bincount(np.frombuffer(payload, dtype=np.uint8) >> 4, minlength=16)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT_BYTES:]), ",".join(map(str, counts.tolist()))

    columns = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"
    return _read(index, columns, [pa.int64(), pa.string(), pa.int64(), pa.string()], row)


def media_columns(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): n_bytes and the address, metadata and features of its stored payload.

    Null texts are empty; an empty text has a payload of UNIT_BYTES zeros. Equal payloads, and so repeated rows, share
    one stored image. Null ids are kept. Other columns are not read.
    """
    media = stored(with_features(with_metadata(store_payloads(docs))), "media-features")
    n, digest = payload_digest(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n_bytes"), digest.alias("digest")).join(media, "digest")
