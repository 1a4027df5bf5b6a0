"""URL filter: rules first, and a character language-model ratio where no rule fits.

A rule fits its host and all subdomains, if the path starts with the rule's path; the longest rule
wins. Rules are column expressions.

Models: two smoothed variable-order Markov models over the characters of URLs, one of accepted and
one of rejected URLs. A context of up to `order` characters belongs to a model if it holds at least
1/`contexts` of the model's characters, so a model has at most `contexts` contexts of each length, on
any corpus. A character's probability is interpolated from no context to the longest that belongs:
its count after the context, plus `prior` times the shorter context's probability, over the
context's count plus `prior`. Counts are exact sums of a shuffle by context and character; a
context's count is the sum over its characters, so each distribution sums to one. Digits count as
one character, as do cases of a letter. The score is the difference of the two log-likelihoods over
the URL's length.

URLs that rules decide are the labelled ones: four fifths train the models, one fifth, held out by a
hash of the URL, calibrates the threshold, which is the score where the smaller of the shares of
held-out URLs judged rightly, of either class, is greatest (the middle of the best scores).

Defined cases: a null URL is empty; a URL without "://" has empty host and path, and the method
judges its whole text; an empty URL scores 0. Null ids and repeated rows give a row each. Without
labelled URLs of both classes every score is compared with 0. An empty table gives no row. Other
columns of the input don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import Tables, by_arrow, byte_texts, table

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_CALIBRATION_BINS = 4001
_SPAN = 4.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The fitting rule's text and verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def contexts_of(urls: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every character of every URL: names of its contexts (order + 1, characters), the character; lengths.

    A URL is preceded by starts, so its first characters have contexts of every length too.
    """
    texts = [b"\x01" * order + u for u in urls]
    sizes = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    chars = np.where((chars >= 48) & (chars <= 57), np.uint64(48), chars)
    chars = np.where((chars >= 65) & (chars <= 90), chars + np.uint64(32), chars)
    starts = np.cumsum(sizes) - sizes
    real = np.ones(len(chars), bool)
    for k in range(order):
        real[starts + k] = False
    at = np.flatnonzero(real)
    context, out = np.zeros(len(at), np.uint64), []
    for k in range(order + 1):
        if k:
            context = _spread(context + chars[at - k] + np.uint64(1))
        out.append(context)
    return np.stack(out), chars[at], sizes - order


def gram_of(context: np.ndarray, char: np.ndarray) -> np.ndarray:
    return _spread(context ^ _spread(char + np.uint64(0x9E3779B97F4A7C15)))


@dataclass(frozen=True)
class Markov:
    """Sorted names and counts of contexts, and of contexts with a character."""

    contexts: np.ndarray
    totals: np.ndarray
    grams: np.ndarray
    counts: np.ndarray
    prior: float

    def probabilities(self, contexts: np.ndarray, char: np.ndarray) -> np.ndarray:
        p = np.full(len(char), 1 / 256)
        for own in contexts:
            total = _counted(self.contexts, self.totals, own)
            count = _counted(self.grams, self.counts, gram_of(own, char))
            p = np.where(total > 0, (count + self.prior * p) / (total + self.prior), p)
        return p


def _counted(names: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(names):
        return np.zeros(len(asked))
    distinct, of = np.unique(asked, return_inverse=True)
    at = np.minimum(np.searchsorted(names, distinct), len(names) - 1)
    return np.where(names[at] == distinct, counts[at], 0.0)[of]


@dataclass(frozen=True)
class Ratio:
    accepted: Markov
    rejected: Markov
    order: int
    threshold: float = 0.0

    def scores(self, urls: list[bytes]) -> np.ndarray:
        if not urls:
            return np.zeros(0)
        contexts, char, sizes = contexts_of(urls, self.order)
        logs = np.log(self.accepted.probabilities(contexts, char)) - np.log(self.rejected.probabilities(contexts, char))
        ends = np.cumsum(sizes)
        sums = np.concatenate([[0.0], np.cumsum(logs)])
        return (sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1)


def count_models(labelled: DataFrame, order: int, contexts: int, prior: float) -> tuple[Markov, Markov]:
    """labelled: rejected (int 0 or 1), url. The driver gets at most `contexts` contexts of each length and class, and their characters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rejected, urls = b.column(0).to_numpy(zero_copy_only=False), byte_texts(b.column(1))
            for y in (0, 1):
                own = [u for u, r in zip(urls, rejected, strict=True) if r == y and u]
                if own:
                    names, char, _ = contexts_of(own, order)
                    for k in range(order + 1):
                        grams, first, n = np.unique(gram_of(names[k], char), return_index=True, return_counts=True)
                        columns = [np.full(len(n), y, np.int32), np.full(len(n), k, np.int32), names[k][first].view(np.int64), grams.view(np.int64), n.astype(np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["y", "k", "context", "gram", "n"])

    tables = Tables(labelled.sparkSession)
    grams = labelled.select("rejected", "url").transform(by_arrow(count, "y int, k int, context long, gram long, n long"))
    grams = tables.written(grams.groupBy("y", "k", "context", "gram").agg(F.sum("n").alias("n")), "url-grams")
    size = {r["y"]: r["n"] for r in grams.where("k = 0").groupBy("y").agg(F.sum("n").alias("n")).collect()}  # two rows
    least = F.when(F.col("y") == 1, F.lit(size.get(1, 0) / contexts)).otherwise(F.lit(size.get(0, 0) / contexts))
    totals = tables.written(grams.groupBy("y", "k", "context").agg(F.sum("n").alias("total")).where(F.col("total") >= least), "url-contexts")
    kept = grams.join(totals.select("y", "k", "context"), ["y", "k", "context"], "left_semi")
    out = []
    for y in (0, 1):
        parts = []
        for df, name, n in ((totals, "context", "total"), (kept, "gram", "n")):
            got = df.where(F.col("y") == y).select(name, n).toArrow()
            names = got.column(name).to_numpy().view(np.uint64)
            by_name = np.argsort(names)
            parts += [names[by_name], got.column(n).to_numpy()[by_name].astype(np.float64)]
        out.append(Markov(*parts, prior))
    tables.dropped(grams, totals)
    return out[0], out[1]


def with_scores(urls: DataFrame, model: Ratio, *keep: str) -> DataFrame:
    """The kept columns and the score of each URL."""
    fields = [urls.schema[c] for c in keep]
    shared = urls.sparkSession.sparkContext.broadcast(model)  # bounded by the number of contexts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(shared.value.scores(byte_texts(b.column(b.num_columns - 1))), pa.float64())], [*keep, "score"])

    return urls.select(*keep, F.coalesce("url", F.lit("")).alias("_url")).transform(by_arrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"))


def fit(labelled: DataFrame, order: int = 5, contexts: int = 1 << 16, prior: float = 4.0) -> Ratio:
    """labelled: url and rejected (0 or 1)."""
    held = F.crc32(F.col("url").cast("binary")) % 5 == 0
    model = Ratio(*count_models(labelled.where(~held), order, contexts, prior), order)
    cell = F.least(F.greatest(F.floor((F.col("score") + _SPAN) / (2 * _SPAN) * _CALIBRATION_BINS), F.lit(0)), F.lit(_CALIBRATION_BINS - 1)).cast("int")
    table_ = np.zeros((2, _CALIBRATION_BINS))
    for r in with_scores(labelled.where(held), model, "rejected").groupBy("rejected", cell.alias("cell")).count().collect():  # at most 2 * 4001 rows
        table_[r["rejected"], r["cell"]] = r["count"]
    threshold = 0.0
    if (table_.sum(1) > 0).all():
        above = 1 - np.concatenate([[0], np.cumsum(table_[0])]) / table_[0].sum()
        below = np.concatenate([[0], np.cumsum(table_[1])]) / table_[1].sum()
        worth = np.minimum(above, below)
        best = np.flatnonzero(worth >= worth.max() - 1e-12)
        threshold = float(best[len(best) // 2] / _CALIBRATION_BINS * 2 * _SPAN - _SPAN)
    return Ratio(model.accepted, model.rejected, order, threshold)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, order: int = 5, contexts: int = 1 << 16, prior: float = 4.0) -> DataFrame:
    """id, host, path, rule, verdict and score of each row."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("by_rule", verdict)
    labelled = rows.where(F.col("by_rule").isNotNull()).select("url", (F.col("by_rule") == "block").cast("int").alias("rejected"))
    model = fit(labelled, order, contexts, prior)
    judged = with_scores(rows, model, "page_id", "host", "path", "rule", "by_rule")
    by_method = F.when(F.col("score") >= model.threshold, F.lit("allow")).otherwise(F.lit("block"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
