"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

A text is compressed in pieces with either dictionary. The difference of the two compressed sizes,
over the text's size, is high where the good dictionary helps more; a short text is drawn towards
what good texts usually have. A logistic curve fitted to labelled rows turns it into a score.

Fitting takes a bounded sample of labelled rows: `sample_rows` of each class, chosen by a hash of
their ids. The whole texts of two thirds of them build the dictionaries, those of the others fit the
curve. Nothing but the text is
an input. Scoring reads every whole text in its own task, without a shuffle.

Defined cases: a null text is empty; an empty text scores as the curve says for a usual good text of
no length. A null id counts as held out. Repeated rows score alike. With too few labelled rows for a
trained dictionary, the raw text is the dictionary; with none of a class, compression takes none;
with too few for a curve, a fixed one is taken. An empty table gives no row. Other columns of the
input don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import by_arrow, byte_texts, crc32_of_id, table

FOLDS = 5
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    trained: tuple[bool, bool]
    usual: float
    slope: float
    offset: float
    piece: int
    level: int
    drawn: int = 64

    def compressors(self):
        import zstandard

        out = []
        for content, trained in zip((self.good, self.bad), self.trained, strict=True):
            d = None
            if content:
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def difference(self, text: bytes, compressors) -> float:
        good, bad = compressors
        gain = 0
        for at in range(0, len(text), self.piece):
            part = text[at : at + self.piece]
            gain += len(bad.compress(part)) - len(good.compress(part))
        return (gain + self.drawn * self.usual) / (len(text) + self.drawn)

    def score(self, difference: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.slope * difference + self.offset))))


def pieces(texts: list[bytes], size: int, least: int = 16) -> list[bytes]:
    """The texts in pieces of `size` bytes; what is too short to train on is joined to what comes before."""
    out: list[bytes] = []
    for t in texts:
        for at in range(0, len(t), size):
            part = t[at : at + size]
            if out and (len(part) < least or len(out[-1]) < least):
                out[-1] += part
            else:
                out.append(part)
    return out


def _dictionary(pieces: list[bytes], size: int, level: int) -> tuple[bytes, bool]:
    import zstandard

    if not pieces:
        return b"", False
    try:
        return zstandard.train_dictionary(size, pieces, level=level).as_bytes(), True
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:], False


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset by Newton's method on x scaled to unit spread."""
    mean, spread = x.mean(), x.std() or 1.0
    a = np.stack([(x - mean) / spread, np.ones_like(x)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    sample_rows: int = 2000,
    dictionary_bytes: int = 64 << 10,
    piece: int = 1024,
    level: int = 3,
    seed: int = 5,
) -> Model:
    """labels: doc_id and the label, of the rows that may be learnt from. docs: doc_id and text."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"))
    chosen = None
    for y in (0, 1):
        part = labels.where((F.col(label_col) == y) & F.col("doc_id").isNotNull()).select("doc_id", F.lit(y).alias("y"), order.alias("h")).distinct().orderBy("h").limit(sample_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    picked = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most 2 * sample_rows ids

    third = F.conv(F.substring("h", 1, 4), 16, 10).cast("int") % 3 == 0
    rows = picked.where(~third).select("h", "y", F.col("text").cast("binary").alias("text")).collect()  # at most 2 * sample_rows texts
    rows.sort(key=lambda r: (r["h"], r["text"] or b""))
    by_class = [pieces([bytes(r["text"]) for r in rows if r["y"] == y and r["text"]], piece) for y in (0, 1)]
    (bad, bad_trained), (good, good_trained) = (_dictionary(p, dictionary_bytes, level) for p in by_class)
    model = Model(good, bad, (good_trained, bad_trained), 0.0, 1.0, 0.0, piece, level, drawn=0)
    fitted = [(r["y"], r["difference"], r["n"]) for r in scored(picked.where(third), model, "y").select("y", "difference", "n").collect()]
    y = np.array([r[0] for r in fitted], float)
    raw, n = np.array([r[1] for r in fitted], float), np.array([r[2] for r in fitted], float)
    seen = raw[(y == 1) & (n > 0)]
    usual = float(np.median(seen)) if len(seen) else 0.0
    drawn = 64
    x = (raw * n + drawn * usual) / (n + drawn)
    if min((y == 0).sum(), (y == 1).sum()) >= 5:
        slope, offset = _logistic(x, y)
    else:
        slope, offset = 100.0, 1.0 - 50.0 * usual
    return Model(good, bad, (good_trained, bad_trained), usual, max(slope, 1e-6), offset, piece, level, drawn)


def scored(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, what is kept, difference, n (bytes) and score of every whole text."""
    fields = [docs.schema[c] for c in ("doc_id", *keep)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", difference double, n long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for b in batches:
            texts = byte_texts(b.column(b.num_columns - 1))
            difference = [model.difference(t, compressors) if t or model.drawn else 0.0 for t in texts]
            more = [pa.array(difference, pa.float64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([model.score(d) for d in difference], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], [f.name for f in fields] + ["difference", "n", "score"])

    return docs.select("doc_id", *keep, F.col("text").cast("string").alias("_text")).transform(by_arrow(run, schema))


def held_out() -> Column:
    return F.coalesce(crc32_of_id("doc_id", FOLDS) == 0, F.lit(True))


def fit_on_labels(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(docs, labels.where(~held_out()))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on_labels(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
