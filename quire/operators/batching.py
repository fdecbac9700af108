"""Batches of rows: those of whole keys, and a pluggable reader that is given batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType


def changes(k: pa.Array) -> np.ndarray:
    """The rows whose value isn't that of the row before; nulls are one value."""
    x, y = k.slice(1), k.slice(0, max(len(k) - 1, 0))
    return np.flatnonzero(pc.or_(pc.fill_null(pc.not_equal(x, y), False), pc.xor(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False)) + 1


def whole_keys(batches: Iterator[pa.RecordBatch], key: str, sizes: Callable[[pa.RecordBatch], np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, some of size `most` in all at a time and the rest of the key that they end in."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        upto, begin = np.cumsum(np.append(0, sizes(batch))), 0
        ends = changes(batch.column(key))
        if held and held[-1].column(key)[-1] != batch.column(key)[0]:
            ends = np.append(0, ends)
        while len(full := ends[(ends >= begin) & (size + upto[ends] - upto[begin] > most)]):
            held += [batch.slice(begin, full[0] - begin)] if full[0] > begin else []
            yield joined()
            held, size, begin = [], 0, int(full[0])
        held.append(batch.slice(begin))
        size += int(upto[-1] - upto[begin])
    if held:
        yield joined()


def read_batched(rows: DataFrame, key: str, order: str, text: str, reader: Callable[[list[str]], dict[int, str]], n: int = 18) -> DataFrame:
    """UD-01: rows plus reading: what the reader returns for its place in a batch of n rows of its key, and `unreadable`
    where it returns nothing. The reader runs on the executors, a batch at a time, and must pickle.

    Rows are dealt by key once and stream through in order; what is held is a batch of n rows beside Arrow's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def read() -> list[str]:
            got = reader(held)
            out = [got.get(i, "unreadable") for i in range(len(held))]
            held.clear()
            return ["unreadable" if x is None else x for x in out]

        waiting, readings = None, []  # rows up to the last batch that is not full, and what is read of them
        for batch in batches:
            waiting = batch if waiting is None else pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
            for k, t in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True):
                if held and (k != last or len(held) == n):
                    readings += read()
                last = k
                held.append(t)
            done = len(readings)
            if done:
                yield pa.RecordBatch.from_arrays([*waiting.slice(0, done).columns, pa.array(readings, pa.string())], names=[*waiting.schema.names, "reading"])
                waiting, readings = waiting.slice(done), []
        if held:
            yield pa.RecordBatch.from_arrays([*waiting.columns, pa.array(read(), pa.string())], names=[*waiting.schema.names, "reading"])

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, StructType([*rows.schema.fields, StructField("reading", StringType())]))
