"""Python over batches of rows, in bounded memory."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that Spark puts into a batch of texts, unless the session says otherwise, and bytes that Python works on at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def regrouped(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes, or one longer row; small ones are joined."""
    held, size = [], 0
    for b in batches:
        own = b.nbytes
        parts = [b] if own <= 2 * most else _cut(b, most)
        for part in parts:
            if held and size + part.nbytes > most:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def _cut(batch: pa.RecordBatch, most: int) -> list[pa.RecordBatch]:
    if batch.num_rows < 2 or batch.nbytes <= most:
        return [batch]
    half = batch.num_rows // 2
    return _cut(batch.slice(0, half), most) + _cut(batch.slice(half), most)


#: Freed bytes that a worker may keep during a task: by default, and for work that makes and drops large arrays all the time.
FREED_BYTES, FREED_BYTES_OF_ARRAYS = 1 << 20, 32 << 20


@functools.cache
def _c_library() -> ctypes.CDLL:
    """The C library; on the first call, Arrow's arrays come to be its own too."""
    pa.set_memory_pool(pa.system_memory_pool())
    return ctypes.CDLL(None)


def _lean_worker(freed: int = FREED_BYTES) -> None:
    """Arrays larger than `freed` bytes come from the system and go back to it when they are freed.

    By default the C library keeps ever larger ones for later, and Arrow keeps all: a worker's size
    would be the sum of its largest moments. But the system zeroes each page that it hands out, so
    loops over arrays of some megabytes set a larger limit; the task's end gives back what is kept.
    """
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        _c_library().mallopt(-3, freed)
        _c_library().mallopt(-1, freed if freed > FREED_BYTES else 128 << 10)


def by_arrow(run: Callable, schema: str, freed: int = FREED_BYTES) -> Callable[[DataFrame], DataFrame]:
    """mapInArrow in bounded memory, for DataFrame.transform().

    Spark fills batches by rows, and 10,000 texts make large ones on both sides; so a session that
    keeps that default gets BATCH_ROWS, and run sees batches of about BATCH_BYTES. A worker keeps at
    most `freed` freed bytes at the end of its heap; after a task, it gives back what the C library
    holds for later.
    """

    def wrapped(batches):
        _lean_worker(freed)
        try:
            yield from run(regrouped(batches))
        finally:
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                _c_library().malloc_trim(0)

    def mapped(df: DataFrame) -> DataFrame:
        conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        if conf.get(name) == "10000":
            conf.set(name, BATCH_ROWS)
        return df.mapInArrow(wrapped, schema)

    return mapped


def by_rows(start: Callable[[], Callable[[list[list]], Iterator[tuple]]], schema: str) -> Callable[[DataFrame], DataFrame]:
    """by_arrow for functions from a batch's columns, as lists, to rows, which start() gives once a task.

    Rows leave in batches of a quarter of BATCH_BYTES, or of one longer row, as they take more room here than there.
    """

    def mapped(df: DataFrame) -> DataFrame:
        kind = to_arrow_schema(StructType.fromDDL(schema))

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            run = start()
            for b in batches:
                held, size = [], 0
                for row in run([c.to_pylist() for c in b.columns]):
                    held.append(row)
                    size += sum(len(x) if isinstance(x, str) else 16 for x in row)
                    if size > BATCH_BYTES // 4:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kind, strict=True)], schema=kind)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kind, strict=True)], schema=kind)

        return df.transform(by_arrow(parts, schema))

    return mapped
