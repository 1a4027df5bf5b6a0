"""Packing documents into training sequences by online sum-of-squares placement.

Every document is its ids and an end id. Full windows are cut off its front; the rest, shorter than
a window, is placed where the sum of squared counts of partially filled windows, taken over fill
levels, becomes least: an array holds how many open windows each fill level has, and one pass over
that array finds the best level (or a new window). When the input of a task ends, or `open_limit`
windows are open, the emptiest open windows are cut up to fill the others, and what is left over
becomes sequences whose lengths are powers of two, which need no padding. So no sequence is padded.

Tasks pack their own rows, without a shuffle; a task that is run again reads the same rows in the
same order and gives the same sequences. A task holds the ids of its open windows alone.

Defined cases: a null text is empty and gives one piece, the end id. Null ids and repeated rows are
packed like others. An empty table gives no piece. Other columns of the input don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import by_arrow, lists_of, table
from skein.llm.subwords import default_tokenizer, subwords

#: A piece in a window: document id, ids of the document before it, id bytes, ids of the document.
Piece = tuple[int | None, int, bytes, int]

#: sequence_id is the task's number times this, plus the sequence's number in the task.
TASK_STRIDE = 1 << 40


class SumOfSquares:
    """Open windows by fill level, and the closed ones not yet taken."""

    def __init__(self, width: int, open_limit: int = 4096):
        self.width, self.open_limit = width, open_limit
        self.count = np.zeros(width + 1, np.int64)
        self.level: list[list[list[Piece]]] = [[] for _ in range(width + 1)]
        self.open = 0
        self.closed: list[list[Piece]] = []

    def best_level(self, size: int) -> int:
        """The fill level that an item of `size` joins; 0 opens a window. Ties go to the fullest."""
        room = self.width - size
        levels = self.count[1 : room + 1]
        after = self.count[1 + size : self.width + 1].copy()
        after[-1:] = 0  # a full window is no longer counted
        change = 2 * (after - levels) + 2
        change[-1:] -= 1
        change = np.where(levels > 0, change, np.iinfo(np.int64).max)
        fresh = 2 * self.count[size] + 1
        if not len(change):
            return 0
        k = len(change) - 1 - int(np.argmin(change[::-1]))
        return 0 if change[k] > fresh or levels[k] == 0 else k + 1

    def put(self, piece: Piece) -> None:
        size = len(piece[2]) // 4
        if size == self.width:
            self.closed.append([piece])
            return
        h = self.best_level(size)
        if h:
            window = self.level[h].pop()
            self.count[h] -= 1
            self.open -= 1
        else:
            window = []
        window.append(piece)
        if h + size == self.width:
            self.closed.append(window)
        else:
            self.level[h + size].append(window)
            self.count[h + size] += 1
            self.open += 1
            if self.open >= self.open_limit:
                self.flush(last=False)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        for start in range(0, n, self.width):
            self.put((doc_id, start, ids[4 * start : 4 * min(n, start + self.width)], n))

    def flush(self, last: bool = True) -> None:
        """Close all open windows: cut the emptiest to fill the rest, then cut powers of two.

        Unless it is the last flush, what fills no window stays open.
        """
        windows = [w for h in range(self.width - 1, 0, -1) for w in self.level[h]]
        total = sum(len(p[2]) for w in windows for p in w) // 4
        keep = total // self.width
        pool = [p for w in windows[keep:] for p in w]
        self.level = [[] for _ in range(self.width + 1)]
        self.count[:] = 0
        self.open = 0

        def take(size: int) -> list[Piece]:
            out = []
            while size:
                doc_id, start, ids, n = pool.pop()
                if len(ids) // 4 > size:
                    pool.append((doc_id, start + size, ids[4 * size :], n))
                    ids = ids[: 4 * size]
                out.append((doc_id, start, ids, n))
                size -= len(ids) // 4
            return out

        for w in windows[:keep]:
            self.closed.append(w + take(self.width - sum(len(p[2]) for p in w) // 4))
        rest = sum(len(p[2]) for p in pool) // 4
        if last:
            for bit in range(rest.bit_length() - 1, -1, -1):
                if rest >> bit & 1:
                    self.closed.append(take(1 << bit))
        elif rest:
            self.level[rest] = [pool]
            self.count[rest] = 1
            self.open = 1

    def taken(self) -> list[list[Piece]]:
        out, self.closed = self.closed, []
        return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame,
    width: int = 1024,
    tokenizer: str | None = None,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    open_limit: int = 4096,
    with_ids: bool = False,
) -> DataFrame:
    """A row for each piece; with_ids adds token_ids, the piece's ids."""
    tokenizer = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, sequence = subwords(tokenizer), SumOfSquares(width, open_limit), TaskContext.get().partitionId() * TASK_STRIDE

        def rows(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal sequence
            columns: list[list] = [[] for _ in range(7)]
            parts = []
            for w in windows:
                offset = 0
                for doc_id, start, ids, n in w:
                    for c, v in zip(columns, (doc_id, start, len(ids) // 4, zlib.crc32(ids), n, sequence, offset), strict=True):
                        c.append(v)
                    offset += len(ids) // 4
                    parts.append(ids)
                sequence += 1
            arrays = [pa.array(c, pa.int64()) for c in columns]
            if with_ids:
                arrays.append(lists_of(np.cumsum([0, *(len(p) // 4 for p in parts)]), pa.array(np.frombuffer(b"".join(parts), "<i4"))))
            return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SCHEMA.split(", ")] + ["token_ids"] * with_ids)

        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for first, ids, offsets in enc.encode_column(b.column(1), end_id):
                cuts = offsets.tolist()
                for k, (at, to) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    packer.add(doc_ids[first + k], ids[at:to].tobytes())
                if packer.closed:
                    yield rows(packer.taken())
        packer.flush()
        if packer.closed:
            yield rows(packer.taken())

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return thin.transform(by_arrow(run, SCHEMA + ", token_ids array<int>" * with_ids))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
