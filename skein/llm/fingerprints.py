"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

A paragraph (a line) is hashed to a wide vector of 32-bit lanes, and a text's fingerprint is the sum
of its paragraphs' vectors modulo 2**32. So the order of paragraphs doesn't matter, and a paragraph
is inserted by adding its vector and deleted by subtracting it, without the rest of the text.

The first lanes of a paragraph's vector are drawn uniformly from a keyed hash of its bytes; they
tell unequal multisets apart. The other lanes are a signed count sketch of the paragraph's pairs of
neighbouring words (of its word, if it has one only): the dot product of two texts' sketches
estimates that of their pair counts, and the likeness of two fingerprints is that product over the
larger of the two squared lengths, held within 0 and 1; equal fingerprints have likeness 1. A lane of
a sketch is read as a signed number, which holds any text of less than 2**31 pairs.

The query edits each text with the front of the text that follows in descending order of id. Ids
alone are sorted into ranges first; the first document of each range is also sent to the range
before it, so a single shuffle of the texts, by range, brings every document next to its successor.

Defined cases: a null text is empty, and an empty text is one empty paragraph. Null ids sort last.
Rows with equal ids are ordered by text, so all occurrences get a successor. A single row is its own
successor. An empty table gives no row. Other columns of the input don't matter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import by_arrow, shuffle_partitions, table

EXACT_LANES, SKETCH_LANES = 32, 192
LANES = EXACT_LANES + SKETCH_LANES
_KEY = b"skein paragraph"


def paragraph_exact(paragraph: bytes) -> np.ndarray:
    return np.frombuffer(hashlib.shake_128(_KEY + paragraph).digest(4 * EXACT_LANES), "<u4")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str) -> np.ndarray:
    """The lanes of a whole text."""
    paragraphs = text.encode().split(b"\n")
    exact = np.zeros(EXACT_LANES, np.uint32)
    hashes: list[np.ndarray] = []
    for p in paragraphs:
        exact += paragraph_exact(p)
        h = np.fromiter(map(crc32, words := p.split()), np.uint64, len(words))
        hashes.append((h[:-1] << np.uint64(32)) | h[1:] if len(h) > 1 else h)
    pairs = _mixed(np.concatenate(hashes))
    lane = (pairs % np.uint64(SKETCH_LANES)).astype(np.int64)
    sign = 1 - 2 * ((pairs >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
    sketch = np.bincount(lane, weights=sign, minlength=SKETCH_LANES).astype(np.int64).astype(np.uint32)
    return np.concatenate([exact, sketch])


def inserted(lanes: np.ndarray, paragraph: str) -> np.ndarray:
    return lanes + fingerprint(paragraph)


def deleted(lanes: np.ndarray, paragraph: str) -> np.ndarray:
    return lanes - fingerprint(paragraph)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[EXACT_LANES:].astype(np.int32).astype(np.float64) for v in (a, b))
    most = max(x @ x, y @ y)
    return float(min(1.0, max(0.0, (x @ y) / most))) if most else 0.0


def written_out(lanes: np.ndarray) -> str:
    return base64.b64encode(lanes.astype("<u4").tobytes()).decode()


def edited_text(text: str, following: str) -> str:
    """The last half of the code points, rounded down, replaced by the first as many of another text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint (base64 of little-endian 32-bit lanes) of each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([written_out(fingerprint(t or "")) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(by_arrow(run, "doc_id long, fingerprint string"))


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text, range, peek: each range's rows, and the first row of the next range as a peek.

    Ranges count from the highest id; equal ids share a range. The last range peeks at the first.
    """
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = thin.select("doc_id").where(F.col("doc_id").isNotNull()).stat.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    cuts = sorted({int(c) for c in cuts}, reverse=True)  # fewer than `ranges`
    # How many cuts lie above the id: steps of a binary search over one constant array.
    bounds = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>")
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
    above = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.try_element_at(bounds, at + step) > F.col("doc_id")), at + step).otherwise(at)) if cuts else F.lit(0)
    placed = thin.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(above).cast("int"))
    # The first row of each range: the highest id, and of its texts the least.
    tops = placed.select("range", "doc_id").groupBy("range").agg(F.max("doc_id").alias("top"))
    order = Window.orderBy("range")
    tops = tops.withColumn("before", F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy())))
    tops = tops.select(F.col("range").alias("_r"), "top", "before")  # a row a range
    firsts = placed.join(F.broadcast(tops), (F.col("range") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("top")))
    firsts = firsts.groupBy("_r", "before", "doc_id").agg(F.min("text").alias("text"))
    peeks = firsts.select("doc_id", "text", F.col("before").alias("range"), F.lit(True).alias("peek"))
    return placed.withColumn("peek", F.lit(False)).unionByName(peeks)


def with_edits(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """A row for each document: its fingerprint, its edited text's, and their likenesses."""
    ranges = ranges or shuffle_partitions(docs.sparkSession)
    rows = in_ranges(docs, ranges)
    rows = rows.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "peek", F.col("doc_id").desc_nulls_last(), "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # id, text, range, lanes

        def row(doc_id: int | None, text: str, lanes: np.ndarray, following: str, next_lanes: np.ndarray) -> tuple:
            edited = edited_text(text, following)
            changed = fingerprint(edited)
            return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), written_out(lanes), written_out(changed), likeness(lanes, changed), likeness(lanes, next_lanes)

        for b in batches:
            out = []
            for doc_id, text, k, peek in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lanes = fingerprint(text)
                if held and held[2] == k:
                    out.append(row(held[0], held[1], held[3], text, lanes))
                held = None if peek else (doc_id, text, k, lanes)
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return rows.select("doc_id", "text", "range", "peek").transform(by_arrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(table(spark, sf_dir, "documents"))
