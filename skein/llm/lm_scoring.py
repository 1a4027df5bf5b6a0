"""Language-model scoring with a causal self-attention model trained in numpy on subword ids.

Texts are lower-cased (A-Z) and cut into words; an end follows the last. The model's units are the
end and the ids that a public byte-level BPE gives each word, as after a space. Every unit has a
learnt probability in every context (attention.py), so known and unknown words are scored alike, and
a text's score is the sum over its units.

Preparing: one pass splits and encodes every text, counts the training words, and writes the texts with
their units to the shared folder, where training and scoring read them.

Training: a start on a bounded sample of windows on the driver, from a table of unit counts over the
whole training corpus; then one round in which every training document gives all its windows to its
task, so that each of its units is a target once. Tasks train from the start, block by block. What
they changed is averaged, weighted by windows, in two levels of streaming sums.

Scoring: windows of 32 units that overlap by half; each unit is scored once, with at least 16 units
of context where the text has them, in batches under a causal mask.

Base score: exact counts of all training words come from a shuffle by word. The counts of the most
frequent ones travel as a broadcast of bounded size; occurrences of other words meet theirs in a
shuffle join, so the bound changes speed alone.

Defined cases: a null text is empty and holds the end alone. A null id counts as training text, as
its remainder isn't 2. Repeated rows score alike. Without training text, the base gives each token
log10(1 / 1) = 0 and the model is nearly uniform. An empty table gives no row. Other columns of the
input don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.attention import BATCH, Attention, Layout, Trainer, text_scores, training_windows
from skein.llm.common import FREED_BYTES_OF_ARRAYS, Tables, by_arrow, crc32_of_id, table
from skein.llm.subwords import Subwords, default_tokenizer, subwords, taken

FOLDS, HELD = 7, 2
#: Words whose counts are broadcast for the base score.
LEXICON_MOST = 1 << 19
#: Documents and windows of the start's sample.
START_ROWS, START_WINDOWS = 4096, 16384
START_RATE, RATE = 0.02, 0.01
#: Windows that a task shuffles and trains on at once.
BLOCK = 8192
#: Weights that travel as one row, and branches of the first level of sums.
SLOTS, BRANCHES = 4096, 64


def held_out() -> Column:
    return F.coalesce(crc32_of_id("doc_id", FOLDS) == HELD, F.lit(False))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of lower-cased texts, the words' numbers among them, and bounds by text."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    bounds = words.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    flat = words.flatten()
    distinct = flat.dictionary_encode()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    numbers = distinct.indices.to_numpy()[real] if len(flat) else np.zeros(0, np.int32)
    return distinct.dictionary, numbers, np.concatenate([[0], np.cumsum(real)])[bounds]


def units_of(enc: Subwords, distinct: pa.Array, numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of all texts, each with its end, and bounds by text."""
    ids, sizes = enc.encode_distinct(distinct)
    items = np.insert(numbers.astype(np.int64), bounds[1:], len(sizes))
    units, ends = taken(np.append(ids.astype(np.int32) + 1, np.int32(0)), np.append(sizes, 1), items)
    return units, np.concatenate([[0], ends])[bounds + np.arange(len(bounds))]


def prepared(docs: DataFrame, tokenizer: str, most_held: int = 600_000) -> DataFrame:
    """docs: doc_id, text and learnt (whether it is training text). The same with each text's units,
    and, in rows of their own, words and their counts in training texts; tasks add up in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, held = subwords(tokenizer), {}

        def emit() -> pa.RecordBatch:
            k = len(held)
            out = pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.binary()), pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names)
            held.clear()
            return out

        for b in batches:
            distinct, numbers, bounds = words_of(b.column(1))
            learnt = np.repeat(b.column(2).to_numpy(zero_copy_only=False), np.diff(bounds))
            counts = np.bincount(numbers[learnt], minlength=len(distinct))
            for w, n in zip(distinct.to_pylist(), counts.tolist(), strict=True):
                if n:
                    held[w] = held.get(w, 0) + n
            units = packed(*units_of(enc, distinct, numbers, bounds), enc.size)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), units, pa.nulls(len(units), pa.string()), pa.nulls(len(units), pa.int64())], names)
            if len(held) > most_held:
                yield emit()
        if held:
            yield emit()

    names = ["doc_id", "text", "learnt", "units", "word", "n"]
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "learnt")
    return thin.transform(by_arrow(run, "doc_id long, text string, learnt boolean, units binary, word string, n long", FREED_BYTES_OF_ARRAYS))


def packed(units: np.ndarray, bounds: np.ndarray, size: int) -> pa.Array:
    """Units by text, two bytes each where the tokenizer's ids and the end allow it, else four."""
    kind = np.dtype("<u2" if size < 1 << 16 else "<u4")
    data = np.ascontiguousarray(units.astype(kind))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * kind.itemsize).astype(np.int32)), pa.py_buffer(data)])


def unpacked(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What packed() took: units and bounds."""
    kind = np.dtype("<u2" if size < 1 << 16 else "<u4")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    units = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if data is not None else np.zeros(0, kind)
    return units.astype(np.int32), (ends - ends[0]) // kind.itemsize


def lexicon(counts: DataFrame, most: int) -> pa.Table:
    """The words at least as frequent as a limit that at most `most` words reach, and their counts."""
    by_count = {r["n"]: r["words"] for r in counts.where("n > 1").groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(most).collect()}  # a row each distinct count
    limit, total = None, 0
    for n in sorted(by_count, reverse=True):
        if total + by_count[n] > most:
            break
        limit, total = n, total + by_count[n]
    limit = limit if limit is not None else 1 << 62
    return counts.where(F.col("n") >= limit).toArrow()


def unit_counts(counts: DataFrame, ends: int, tokenizer: str) -> np.ndarray:
    """Counts of all units over the counted words; at most a row for each id reaches the driver."""
    size = subwords(tokenizer).size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, total = subwords(tokenizer), np.zeros(size)
        for b in batches:
            ids, sizes = enc.encode_distinct(b.column(0))
            total += np.bincount(ids, weights=np.repeat(b.column(1).to_numpy(), sizes), minlength=size)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own].astype(np.int64))], ["id", "n"])

    got = counts.select("word", "n").transform(by_arrow(run, "id long, n long")).groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.full(1 + size, 0.05)
    out[0] += ends
    out[1 + got.column("id").to_numpy()] += got.column("n").to_numpy()
    return out


def sample_windows(training: DataFrame, tokenizer: str, rows: int = START_ROWS, most: int = START_WINDOWS) -> np.ndarray:
    """At most `most` windows, by a hash, of the documents with the `rows` least hashes of ids."""
    picked = training.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id", F.lit(31)), "doc_id").limit(rows)
    texts = training.join(F.broadcast(picked), "doc_id").select("units")  # at most `rows` ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = subwords(tokenizer).size
        for b in batches:
            for w in training_windows(*unpacked(b.column(0), size)):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([lists], ["window"])

    found = texts.transform(by_arrow(run, "window array<int>")).orderBy(F.xxhash64("window"), "window").limit(most).toArrow()
    return np.array(found.column("window").to_pylist(), np.int32)


def averaged(training: DataFrame, start: Attention, tokenizer: str, rate: float = RATE) -> Attention:
    """The model after every task has trained from `start` on all windows of its texts; those have units, or get them."""
    begun = training.sparkSession.sparkContext.broadcast(start)
    shapes = [w.shape for w in start.weights]
    if "units" not in training.columns:
        training = prepared(training.withColumn("learnt", F.lit(True)), tokenizer).where("units IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, trainer = subwords(tokenizer).size, Trainer(begun.value.copy(), rate)
        held: list[np.ndarray] = []
        for b in batches:
            for part in training_windows(*unpacked(b.column(0), size)):
                held.append(part)
                if sum(map(len, held)) >= BLOCK:
                    trainer.train(np.concatenate(held))
                    held = []
        if held:
            trainer.train(np.concatenate(held))
        if trainer.seen:
            change = np.concatenate([(w.astype(np.float64) - w0).ravel() for w, w0 in zip(trainer.model.weights, begun.value.weights, strict=True)]) * trainer.seen
            change = np.pad(change, (0, -len(change) % SLOTS)).reshape(-1, SLOTS)
            own = np.flatnonzero(change.any(1))
            rows = [change[k].tobytes() for k in own]
            branch = np.full(len(own) + 1, TaskContext.get().partitionId() % BRANCHES, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(own, -1).astype(np.int32)), pa.array(branch), pa.array([*rows, np.array([trainer.seen], np.float64).tobytes()])], ["block", "branch", "change"])

    sums = training.select("units").transform(by_arrow(run, "block int, branch int, change binary", FREED_BYTES_OF_ARRAYS))
    for keys in (["block", "branch"], ["block"]):
        sums = sums.repartition(*keys).sortWithinPartitions(*keys).transform(by_arrow(_summed, "block int, branch int, change binary"))
    got = {r["block"]: np.frombuffer(r["change"], np.float64) for r in sums.collect()}  # a row for each block of weights
    begun.destroy()
    if -1 not in got:
        return start
    seen, flat = got.pop(-1)[0], np.concatenate([w.ravel() for w in start.weights]).astype(np.float64)
    flat = np.pad(flat, (0, -len(flat) % SLOTS)).reshape(-1, SLOTS)
    for block, change in got.items():
        flat[block] += change / seen
    ends = np.cumsum([math.prod(x) for x in shapes])
    return Attention(start.layout, [part.reshape(x).astype(np.float32) for part, x in zip(np.split(flat.ravel()[: ends[-1]], ends[:-1]), shapes, strict=True)])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal block and branch: rows come sorted, and one sum is held."""
    key, total = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()])], ["block", "branch", "change"])
    for b in batches:
        for block, branch, change in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            change = np.frombuffer(change.as_buffer(), np.float64)
            if (block, branch) == key:
                total += change
                continue
            if key is not None:
                yield row()
            key, total = (block, branch), change.copy()
    if key is not None:
        yield row()


def trained(training: DataFrame, counts: np.ndarray, tokenizer: str) -> Attention:
    model = Attention.start(Layout.of(counts), counts)
    sample = sample_windows(training, tokenizer)
    if not len(sample):
        return model
    Trainer(model, START_RATE).train(sample, max(4, min(30, -(-400 * BATCH // len(sample)))))
    return averaged(training, model, tokenizer)


def score(docs: DataFrame, training: DataFrame | Column, tokenizer: str | None = None, lexicon_most: int = LEXICON_MOST) -> DataFrame:
    """docs and training: doc_id and text. doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Where training is a condition on docs instead, each text is split and encoded once for both.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    tables = Tables(spark)
    within = isinstance(training, Column)
    texts = tables.written(prepared(docs.withColumn("learnt", training if within else F.lit(False)), tokenizer), "lm-texts")
    learnt = texts if within else tables.written(prepared(training.withColumn("learnt", F.lit(True)), tokenizer), "lm-training")
    counts = tables.written(learnt.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    training = learnt.where("learnt").select("doc_id", "units")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = training.count()
    n, v = sums["n"] + ends, sums["v"] + (ends > 0)
    model = trained(training, unit_counts(counts, ends, tokenizer), tokenizer)
    words = lexicon(counts, lexicon_most)
    shared = spark.sparkContext.broadcast((model, words.column("word").combine_chunks(), words.column("n").to_numpy().astype(np.int64)))
    whole = float(n + v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lexicon_words, word_counts = shared.value
        ids_size, row = subwords(tokenizer).size, TaskContext.get().partitionId() << 33
        log_counts = np.append(np.log10((word_counts + 1) / whole), 0.0)  # the last for words outside
        for b in batches:
            distinct, numbers, bounds = words_of(b.column(1))
            at = pc.fill_null(pc.index_in(distinct, value_set=lexicon_words), len(word_counts)).to_numpy(zero_copy_only=False)
            size = np.diff(bounds)
            text = np.repeat(np.arange(len(size)), size)
            known = at < len(word_counts)
            base = np.bincount(text, weights=log_counts[at][numbers], minlength=len(size)) + math.log10((ends + 1) / whole)
            n_known = np.bincount(text[known[numbers]], minlength=len(size)) + (ends > 0)
            scores = text_scores(model, *unpacked(b.column(2), ids_size)) / math.log(10)
            ids = row + np.arange(len(size))
            row += len(size)
            yield pa.RecordBatch.from_arrays([pa.array(ids), b.column(0), pa.array(size + 1), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(scores), pa.nulls(len(size), pa.string()), b.column(3), b.column(4)], names)
            # Other words, once each text, for the join with their counts.
            other = ~known[numbers]
            pairs, times = np.unique(text[other] * len(distinct) + numbers[other], return_counts=True)
            k = len(pairs)
            if k:
                yield pa.RecordBatch.from_arrays([pa.array(ids[pairs // len(distinct)]), pa.nulls(k, pa.int64()), pa.array(times.astype(np.int64)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), distinct.take(pa.array(pairs % len(distinct))), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names)

    names = ["row", "doc_id", "n_tokens", "n_known", "base", "score", "word", "hash", "other"]
    whole_text = F.coalesce("text", F.lit(""))
    thin = texts.where("units IS NOT NULL").select("doc_id", "text", "units", F.xxhash64(whole_text).alias("hash"), F.xxhash64(whole_text, F.lit(1)).alias("other"))
    both = tables.written(thin.transform(by_arrow(run, "row long, doc_id long, n_tokens long, n_known long, base double, score double, word string, hash long, other long", FREED_BYTES_OF_ARRAYS)), "lm-scores")
    rare = both.where(F.col("word").isNotNull()).select("row", F.col("n_tokens").alias("k"), "word").join(counts, "word", "left")
    c = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.col("k") * F.log10((c + 1) / F.lit(whole))).alias("more"), F.sum(F.when(c > 0, F.col("k")).otherwise(F.lit(0))).alias("more_known"))
    scored = both.where(F.col("word").isNull())
    # A text's place in a batch may change the last digits of its score; equal texts take the least.
    apart = scored.groupBy("hash", "other").agg(F.min("score").alias("least"), F.max("score").alias("most")).where("least < most").drop("most")
    out = scored.join(apart, ["hash", "other"], "left").join(rare, "row", "left")
    out = out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), F.coalesce("least", "score").alias("score")
    )
    return tables.result(out, "lm-result")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, ~held_out()).withColumn("held_out", held_out()).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
