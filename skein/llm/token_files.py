"""Token-ID output: documents as ORC files of subword ids, in ascending order of document id.

Layout: the i-th file holds the i-th range of ids. Its rows are doc_id, n_tokens, start_in_file and
token_ids (integer run-length encoding is ORC's own for integer columns), its stripes have row
indexes and a Bloom filter on doc_id. Readers split files at stripes, and a filter on doc_id prunes
stripes and row groups by statistics and Bloom filters before ids are read.

A document's global start is the sum of what all earlier files hold plus its start in its file; the
sums take one row a file, from the n_tokens column alone.

Defined cases: a null text is empty and holds only the end id. Rows with a null id come first. Rows
with equal ids, null ones too, all stay, ordered by a hash of their text, which also deals them out
to files if they are many. An empty table gives an empty file. Other columns of the
input don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import FREED_BYTES_OF_ARRAYS, by_arrow, fresh_path, lists_of, shuffle_partitions, table
from skein.llm.subwords import default_tokenizer, subwords

SCHEMA = "file_no int, doc_id long, n_tokens long, start_in_file long, token_ids array<int>"


def write_token_orc(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    partitions: int | None = None,
    stripe_bytes: int = 16 << 20,
    row_index_stride: int = 1000,
    bloom_fpp: float = 0.01,
) -> None:
    """Encode whole texts, append end_id to each, and write the files at `path`.

    One shuffle, of the raw texts: they are smaller than their ids. Sampling for the ranges reads
    the table once more but encodes nothing.
    """
    tokenizer = tokenizer or default_tokenizer()
    n = partitions or shuffle_partitions(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, file_no, position = subwords(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            for first, ids, offsets in enc.encode_column(b.column(1), end_id):
                sizes = np.diff(offsets)
                doc_ids = b.column(0).slice(first, len(sizes))
                lists = lists_of(offsets, pa.array(ids.view("<i4")))
                columns = [pa.array(np.full(len(sizes), file_no, np.int32)), doc_ids, pa.array(sizes), pa.array(position + offsets[:-1]), lists]
                yield pa.RecordBatch.from_arrays(columns, ["file_no", "doc_id", "n_tokens", "start_in_file", "token_ids"])
                position += len(ids)

    (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .withColumn("hash", F.xxhash64("text"))
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "hash")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "hash", "text")
        .select("doc_id", "text")
        .transform(by_arrow(encode, SCHEMA, FREED_BYTES_OF_ARRAYS))
        .write.option("compression", "zstd")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", row_index_stride)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", bloom_fpp)
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; with doc_ids, a filter that ORC prunes stripes and row groups by."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def with_starts(rows: DataFrame) -> DataFrame:
    """Add start, the ids of all documents before. The window and the broadcast have a row a file."""
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("_held"))
    files = files.select(F.col("file_no").alias("_file"), F.coalesce(F.sum("_held").over(before.orderBy("file_no")), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(files), F.col("file_no") == F.col("_file")).withColumn("start", F.col("_before") + F.col("start_in_file")).drop("_file", "_before")


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids as little-endian 32-bit integers."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<i4", copy=False)
            data = memoryview(np.ascontiguousarray(values)).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "token_ids").transform(by_arrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long", FREED_BYTES_OF_ARRAYS))


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-orc")
    write_token_orc(table(spark, sf_dir, "documents"), path)
    return digest(with_starts(read_token_orc(spark, path)))
