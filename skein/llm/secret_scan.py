"""Secret scans: three fixed patterns, and the guess cost of values in credential contexts.

Patterns, leftmost and non-overlapping for each kind:

* assign: a credential keyword, a colon or equals sign, a value of 6 or more characters
* access: an access key id of 20 or more characters
* hex: a run of 24 or more lower-case hex digits

Guess cost: a value that follows a credential word is segmented by dynamic programming into ranked
words, dates, repeats, keyboard walks and brute-force spans, so that the estimated number of guesses
is least. A value whose cost reaches `least_cost` (a power of ten) becomes a span of the kind guess,
which covers the value alone. Values of letters alone are costed like others: ranked words keep
prose cheap. A repeat, a run or a walk reaches back as far as it goes on. The program looks back as
far as the longest ranked word, so a long value takes time in proportion to it.

Positions are code points, ends exclusive. Every task works on its own rows; nothing is shuffled.

Defined cases: a null or empty text has no span. Null ids and repeated rows give a row each. An
empty table gives no row. Other columns of the input don't matter.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import by_arrow, table
from skein.llm.subwords import default_tokenizer

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|authorization|bearer)["']?\x20*(?:[:=]>?|\x20is\x20)\x20*(?:bearer\x20+)?("[^"\n]+"|'[^'\n]+'|[^\s"'<>,;]+)""",
    re.ASCII | re.IGNORECASE,
)
#: A text without any of these has neither an assign span nor a context.
CONTEXT_WORDS = ("passw", "passphrase", "passcode", "pwd", "secret", "token", "key", "credential", "authorization", "bearer")

ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")


def _neighbours() -> set[tuple[str, str]]:
    at = {c: (r, k + r * 0.5) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
    return {(a, b) for a, (r, x) in at.items() for b, (s, y) in at.items() if abs(r - s) <= 1 and abs(x - y) <= 1 and a != b}


_ADJACENT = _neighbours()


class Ranks(dict):
    """Ranks of words, and the longest word's length."""

    longest = 0


@lru_cache(maxsize=2)
def ranked_words(path: str) -> Ranks:
    """Words of three letters or more, ranked by their order in a tokenizer's vocabulary."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = Ranks()
    for piece in sorted(vocab, key=vocab.get):
        word = piece.lstrip("Ġ").lower()
        if len(word) >= 3 and word.isascii() and word.isalpha() and word not in words:
            words[word] = len(words) + 1
            words.longest = max(words.longest, len(word))
    return words


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() else 33


def guess_cost(value: str, words: dict[str, int]) -> float:
    """log10 of the guesses that the cheapest segmentation takes; each segment costs a factor 2."""
    n, low = len(value), value.lower() if value.isascii() else "".join(c.lower() if c.isascii() else c for c in value)
    longest = words.longest if isinstance(words, Ranks) else max(map(len, words), default=0)
    step = math.log10(2)
    best = [0.0] + [math.inf] * n  # any last segment
    brute = [math.inf] * (n + 1)  # last segment brute force
    run = walk = 1
    told = {unit: [1] * (n + 1) for unit in range(2, 5)}  # how often the block that ends here is told in a row
    for i in range(1, n + 1):
        c = math.log10(_alphabet(value[i - 1]))
        brute[i] = min(brute[i - 1] + c, best[i - 1] + step + c)
        cost = brute[i]
        if i > 1:
            run = run + 1 if value[i - 1] == value[i - 2] else 1
            walk = walk + 1 if (low[i - 2], low[i - 1]) in _ADJACENT else 1
        if run >= 3:
            cost = min(cost, best[i - run] + step + math.log10(_alphabet(value[i - 1]) * run))
        if walk >= 3:
            cost = min(cost, best[i - walk] + step + math.log10(47 * 2 * walk))
        for unit, times in told.items():  # a block told again
            if i >= 2 * unit and value[i - 2 * unit : i - unit] == value[i - unit : i]:
                k = times[i] = times[i - unit] + 1
                cost = min(cost, best[i - (k - 1) * unit] + step + math.log10(k))
        for size in range(3, min(longest, i) + 1):
            rank = words.get(low[i - size : i])
            if rank:
                upper = sum(x.isupper() for x in value[i - size : i])
                cost = min(cost, best[i - size] + step + math.log10(rank) + (step if upper else 0) + step * min(upper, 3) * (upper not in (0, 1, size)))
        for size, guesses in ((4, 120), (6, 36525), (8, 43830), (10, 43830)):
            if i >= size and _is_date(value[i - size : i]):
                cost = min(cost, best[i - size] + step + math.log10(guesses))
        best[i] = cost
    return best[n]


_DATE = re.compile(r"(?:19|20)\d\d|\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])\d\d|(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d", re.ASCII)


def _is_date(s: str) -> bool:
    return _DATE.fullmatch(s) is not None


def find_spans(text: str, words: dict[str, int], least_cost: float) -> list[tuple[int, int, int, float | None]]:
    """(start, kind's number, end, cost) by start, then kind."""
    spans: list[tuple[int, int, int, float | None]] = []
    low = text.lower()
    if any(w in low for w in CONTEXT_WORDS):
        spans += [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        for m in CONTEXT.finditer(text):
            value, start = m[1], m.start(1)
            if value[0] in "\"'" and len(value) > 1:
                value, start = value[1:-1], start + 1
            else:
                value = value.rstrip(".)]}:!?")
            if len(value) >= 6:
                cost = guess_cost(value, words)
                if cost >= least_cost:
                    spans.append((start, 3, start + len(value), cost))
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: s[:3])


SPANS = "array<struct<kind: string, start: long, end: long, cost: double>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_cost: float = 8.0, tokenizer: str | None = None, mask: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, spans and kept columns; with `mask`, also text, in which a mask stands for each stretch of spans."""
    tokenizer = tokenizer or default_tokenizer()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ranked_words(tokenizer)
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [find_spans(t, words, least_cost) if t else [] for t in texts]
            columns = [b.column(0), pa.array([[{"kind": KINDS[k], "start": s, "end": e, "cost": c} for s, k, e, c in x] for x in found], kind)]
            columns += b.columns[2:]
            if mask is not None:
                columns.append(pa.array([masked(t, x, mask) if x else t for t, x in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spans", *keep, "text"][: len(columns)])

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return thin.transform(by_arrow(run, f"doc_id long, spans {SPANS}{kept}" + ", text string" * (mask is not None)))


def masked(text: str, spans: list[tuple[int, int, int, float | None]], mask: str) -> str:
    out, at = [], 0
    for start, _, end, _ in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = joined(F.filter("spans", lambda s: s["kind"] != "guess"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("guess"))
