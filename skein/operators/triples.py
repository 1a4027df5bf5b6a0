"""Triples from attributes, from distant labels and from tagged text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import match_norm, normalize_key, split_value, strip, strip_special_tokens


def attribute_triples(docs: DataFrame, mapping: DataFrame, order: str | None = None) -> DataFrame:
    """Triples of mapped infobox entries: docs has title, infobox, and optionally file for blank titles.

    The mapping (key, mapped) is a table of relation names, small by nature; it is joined by key.
    """
    title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.col("file") if "file" in docs.columns else F.lit(""))
    e = docs.select(title.alias("head"), *([order] if order else []), F.posexplode(F.map_entries("infobox")).alias("entry", "e"))
    e = e.withColumns({"key": normalize_key(F.col("e.key")), "value": F.replace(F.coalesce("e.value", F.lit("")), F.lit(" "), F.lit(" "))})
    e = e.join(mapping.select("key", F.col("mapped").alias("relation")), "key")
    t = e.select("head", *([order] if order else []), "entry", "relation", "e", F.posexplode(split_value(F.col("value"), F.col("relation"))).alias("part", "tail"))
    t = t.where(F.length("tail").between(2, 200))
    return t.select(
        *([order] if order else []), "entry", "part", "head", F.lit("").alias("head_qid"), "relation", "tail", F.lit("").alias("tail_qid"), F.lit(1.0).alias("confidence"), F.concat_ws(": ", "e.key", "e.value").alias("sentence"), F.col("head").alias("doc"), F.lit("infobox").alias("provenance")
    )


def _grams(c: Column, size: int) -> Column:
    """The distinct runs of `size` characters."""
    n = F.length(c) - (size - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(c, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def _containing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer): texts of three characters or more and those that hold them.

    A text is looked up by the one of its trigrams that fewest outer texts have, so the join is by
    key; what it finds is checked.
    """
    own = outer.select("outer", F.explode(_grams(F.col("outer"), 3)).alias("gram"))
    often = own.groupBy("gram").count()
    rarest = inner.select("inner", F.explode(_grams(F.col("inner"), 3)).alias("gram")).join(often, "gram").groupBy("inner").agg(F.min_by("gram", F.struct("count", "gram")).alias("gram"))
    return rarest.join(own, "gram").where(F.contains("outer", "inner")).select("inner", "outer")


def related_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b): names of three characters or more of which either holds the other."""
    a, b = (df.select(name).where(F.length(name) >= 3).distinct() for df, name in ((a, "a"), (b, "b")))
    first = _containing(a.select(F.col("a").alias("inner")), b.select(F.col("b").alias("outer"))).select(F.col("inner").alias("a"), F.col("outer").alias("b"))
    second = _containing(b.select(F.col("b").alias("inner")), a.select(F.col("a").alias("outer"))).select(F.col("outer").alias("a"), F.col("inner").alias("b"))
    return first.union(second).distinct()


def distant_labels(candidates: DataFrame, facts: DataFrame, key: str = "cand_seq") -> DataFrame:
    """candidates (key, head, tail) with relation: the first fact whose names match, else 'none'.

    Names match if either holds the other; tails need three characters at least. A forward match
    goes before a reverse one, then an equal key, then the longest key, then the first fact.

    Names are compared once for each distinct pair, and no join is without a key: heads of three
    characters or more meet fact heads by trigrams, and what is shorter on either side meets by
    tails, of which the shorter ones are looked up among the tails' parts.
    """
    c = candidates.select("head", "tail").distinct().withColumns({"_h": match_norm(F.col("head")), "_t": match_norm(F.col("tail"))})
    ways = [c.select("head", "tail", F.lit(d).alias("_dir"), F.col(p).alias("_p"), F.col(q).alias("_q")) for d, p, q in ((0, "_h", "_t"), (1, "_t", "_h"))]
    ways = ways[0].union(ways[1]).where(F.length("_q") >= 3)
    # Of facts that match alike the first one counts.
    f = facts.select("fact_seq", "relation", match_norm(F.col("head")).alias("_k"), match_norm(F.col("tail")).alias("_v"))
    f = f.groupBy("_k", "_v").agg(F.min_by("relation", "fact_seq").alias("relation"), F.min("fact_seq").alias("fact_seq"))
    within = lambda x, y: F.contains(x, y) | F.contains(y, x)
    heads = related_names(ways.select(F.col("_p").alias("a")), f.select(F.col("_k").alias("b")))
    tails = related_names(ways.select(F.col("_q").alias("a")), f.select(F.col("_v").alias("b")))
    short = (F.length("_p") < 3) | (F.length("_k") < 3)
    columns = ("head", "tail", "_dir", "_p", "_k", "relation", "fact_seq")
    by_head = ways.join(heads, F.col("_p") == F.col("a")).join(f, F.col("b") == F.col("_k")).where(within(F.col("_q"), F.col("_v")))
    by_tail = ways.join(tails, F.col("_q") == F.col("a")).join(f, F.col("b") == F.col("_v")).where(short & within(F.col("_p"), F.col("_k")))
    parts = ways.withColumn("_part", F.explode(F.concat(F.array(F.lit("")), _grams(F.col("_q"), 1), _grams(F.col("_q"), 2))))
    by_part = parts.join(f.where(F.length("_v") < 3), F.col("_part") == F.col("_v")).where(short & within(F.col("_p"), F.col("_k")))
    j = by_head.select(*columns).union(by_tail.select(*columns)).union(by_part.select(*columns))
    rank = F.struct(F.col("_dir"), (F.col("_k") != F.col("_p")).cast("int"), -F.length("_k"), F.col("fact_seq"))
    best = j.groupBy("head", "tail").agg(F.min_by("relation", rank).alias("relation"))
    return candidates.join(best, ["head", "tail"], "left").withColumn("relation", F.coalesce("relation", F.lit("none")))


def silver_triples(silver: DataFrame) -> DataFrame:
    """Triples of the positive labels."""
    have = lambda c, d: F.coalesce(c, d) if c in silver.columns else d
    return silver.where(F.col("relation") != "none").select(
        *[c for c in ("cand_seq",) if c in silver.columns], "head", have("head_qid", F.lit("")).alias("head_qid"), "relation", "tail", have("tail_qid", F.lit("")).alias("tail_qid"), have("confidence", F.lit(0.8)).alias("confidence"), "sentence", "doc", F.lit("silver").alias("provenance")
    )


def parse_tagged(text: Column) -> Column:
    """array<struct<subject, predicate, object>> of generated text.

    A part reads: subject <subj> object <obj> predicate; a further tag ends the predicate.
    """
    form = r"^(.+?)\s*<subj>\s*(.+?)\s*<obj>\s*(.+)"
    parts = F.filter(F.transform(F.split(text, "<triplet>"), strip), lambda p: p != "")
    one = lambda p: F.struct(
        strip(F.regexp_extract(p, form, 1)).alias("subject"), strip(F.regexp_replace(strip(F.regexp_extract(p, form, 3)), r"\s*</?[a-z]+>.*", "")).alias("predicate"), strip(F.regexp_extract(p, form, 2)).alias("object")
    )
    return F.filter(F.transform(parts, one), lambda t: (t["subject"] != "") & (t["predicate"] != "") & (t["object"] != ""))


#: A generator turns sentences into tagged texts.
Generator = Callable[[list[str]], list[str]]


def generate(sentences: DataFrame, factory: Callable[[], Generator], batch: int = 4, retries: int = 4) -> DataFrame:
    """sentence and generated of each distinct sentence; a batch that runs out of memory is halved."""

    def run(batches):
        model = factory()
        for b in batches:
            todo, out, size, failed = b["sentence"].tolist(), [], batch, 0
            while len(out) < len(todo):
                try:
                    out += model(todo[len(out) : len(out) + size])
                except MemoryError:
                    failed += 1
                    if failed >= retries:
                        raise
                    size = max(1, size // 2)
            yield pd.DataFrame({"sentence": todo, "generated": out})

    raw = sentences.select("sentence").distinct().mapInPandas(run, "sentence string, generated string")
    return raw.withColumn("generated", strip_special_tokens(F.col("generated")))


def pattern_generator(pattern: str = r"([A-Z]\w+(?: [A-Z]\w+)*) (is|was|of|in|at) (?:the |a )?([A-Z]\w+(?: [A-Z]\w+)*)") -> Callable[[], Generator]:
    """The default generator: subject, linking word and object of a pattern, as tagged text."""
    import re

    def make() -> Generator:
        form = re.compile(pattern)
        return lambda texts: ["".join(f"<triplet> {m[1]} <subj> {m[3]} <obj> {m[2]} " for m in form.finditer(t)) for t in texts]

    return make


def extracted(generated: DataFrame) -> DataFrame:
    """sentence, gen_pos, subject, predicate, object."""
    return generated.select("sentence", F.posexplode(parse_tagged(F.col("generated"))).alias("gen_pos", "t")).select("sentence", "gen_pos", "t.subject", "t.predicate", "t.object")


def align(found: DataFrame, candidates: DataFrame, key: str = "cand_seq") -> DataFrame:
    """Extracted triples with the first candidate of their sentence whose names match.

    Forward goes before reverse within a candidate; a reverse match swaps head and tail.
    Sentences are compared by text, so equal sentences of several documents pool their candidates.
    """
    c = candidates.withColumns({"_h": match_norm(F.col("head")), "_t": match_norm(F.col("tail"))})
    f = found.withColumns({"_s": match_norm(F.col("subject")), "_o": match_norm(F.col("object"))})
    same = lambda a, b: (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))
    forward = same(F.col("_s"), F.col("_h")) & same(F.col("_o"), F.col("_t"))
    reverse = same(F.col("_s"), F.col("_t")) & same(F.col("_o"), F.col("_h"))
    j = f.join(c, "sentence").where(forward | reverse).withColumn("_dir", F.when(forward, F.lit(0)).otherwise(F.lit(1)))
    first = Window.partitionBy("sentence", "gen_pos").orderBy(key, "_dir")
    j = j.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    swap = F.col("_dir") == 1
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    qid = "head_qid" in candidates.columns
    return j.select(
        "sentence", "gen_pos", key, pick("head", "tail").alias("head"), *([pick("head_qid", "tail_qid").alias("head_qid")] if qid else []), F.col("predicate").alias("relation"), pick("tail", "head").alias("tail"), *([pick("tail_qid", "head_qid").alias("tail_qid")] if qid else []),
        F.col("subject").alias("head_mention"), F.col("object").alias("tail_mention"), *([F.col("doc")] if "doc" in candidates.columns else []),
    )


def first_triples(t: DataFrame, *order: str) -> DataFrame:
    """The first row of each (head, relation, tail)."""
    first = Window.partitionBy("head", "relation", "tail").orderBy(*order)
    return t.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
