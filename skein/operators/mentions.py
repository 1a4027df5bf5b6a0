"""Mentions: detection, links to a knowledge base, and candidate pairs within sentences."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.batches import by_rows
from skein.config import LOW_VALUE_TYPES
from skein.functions.text import cosine, link_score, split_sentences

#: A detector turns texts into lists of (mention, type, start, end).
Detector = Callable[[Iterable[str]], Iterable[list[tuple[str, str, int, int]]]]

#: Runs of capitalised words, the default detector's pattern.
CAPITALISED = r"[A-Z][a-z]+(?: [A-Z][a-z]+)*"


def pattern_detector(pattern: str = CAPITALISED, kind: str = "UNKNOWN", gazetteer: dict[str, str] | None = None) -> Callable[[], Detector]:
    """A factory of detectors, called once a worker; types come from a gazetteer where it has them."""

    def make() -> Detector:
        compiled, types = re.compile(pattern), gazetteer or {}
        return lambda texts: ([(m.group(), types.get(m.group(), kind), m.start(), m.end()) for m in compiled.finditer(t or "")] for t in texts)

    return make


def detect_mentions(docs: DataFrame, key: str, text: str, factory: Callable[[], Detector] | None = None, source: str = "pattern") -> DataFrame:
    """key, pos, mention, type, start, end, source: a row for each mention, in order."""
    factory = factory or pattern_detector()

    def start():
        detector = factory()

        def run(columns):
            for k, ms in zip(columns[0], detector(columns[1]), strict=True):
                for i, m in enumerate(ms):
                    yield k, i, *m, source

        return run

    thin = docs.select(key, F.col(text).alias("_t"))
    return thin.transform(by_rows(start, f"{key} {docs.schema[key].dataType.simpleString()}, pos int, mention string, type string, start int, end int, source string"))


def link_mentions(mentions: DataFrame, kb: DataFrame, top_k: int = 5, context: Column | None = None, label_vector: str | None = None) -> DataFrame:
    """mention with its best candidate: wikidata_qid, wikidata_label, wikidata_description, link_confidence.

    kb: name, rank, id, label, description; a mention's candidates are the first top_k by rank whose
    name equals it in lower case. With vectors, the score is their cosine; else the heuristic.
    A mention without candidates gets nulls and confidence 0.
    """
    terms = mentions.select("mention", *([context.alias("_context")] if context is not None else [])).distinct()
    c = terms.join(kb.where(F.col("rank") < top_k), F.lower("mention") == F.lower("name"), "left")
    score = cosine(F.col("_context"), F.col(label_vector)) if context is not None and label_vector else link_score(F.col("mention"), F.col("label"), F.col("description"))
    best = Window.partitionBy("mention", *(["_context"] if context is not None else [])).orderBy(F.col("_score").desc_nulls_last(), "rank")
    c = c.withColumn("_score", score).withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return c.select(
        "mention", F.col("id").alias("wikidata_qid"), F.col("label").alias("wikidata_label"), F.col("description").alias("wikidata_description"), F.when(F.col("id").isNull(), F.lit(0.0)).otherwise(F.coalesce("_score", F.lit(0.0))).alias("link_confidence")
    )


def entity_rows(mentions: DataFrame, links: DataFrame | None, key: str) -> DataFrame:
    """key and entities, as the documents' mention lists; link fields where a candidate was chosen."""
    m = mentions
    if links is not None:
        m = m.join(links, "mention", "left")
    have = [c for c in ("wikidata_qid", "wikidata_label", "wikidata_description", "link_confidence") if c in m.columns]
    fields = ["pos", "mention", "type", "start", "end", "source", *have]
    return m.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*fields))), lambda e: e.dropFields("pos")).alias("entities"))


#: Characters of a stretch of text by which mentions and sentences meet.
STRETCH = 512


def worthwhile(kind: Column) -> Column:
    """Types that make candidate pairs; a mention without type may."""
    return ~F.coalesce(kind, F.lit("")).isin(*LOW_VALUE_TYPES)


def mentions_in_sentences(sentences: DataFrame, mentions: DataFrame, key: str) -> DataFrame:
    """Mentions that lie within a sentence.

    Both are cut into stretches of text, so a mention meets only the sentences that reach into the
    stretch where it starts: the join is by key and stretch, and its cost follows the text's length.
    """
    m = mentions.where(worthwhile(F.col("type"))).withColumn("_at", F.floor(F.col("start") / STRETCH))
    s = sentences.withColumnRenamed(key, "_key").withColumn("_at", F.explode(F.sequence(F.floor(F.col("sent_start") / STRETCH), F.floor(F.greatest(F.col("sent_end") - 1, F.col("sent_start")) / STRETCH))))
    s = s.withColumnRenamed("_at", "_stretch")
    on = (F.col("_key") == F.col(key)) & (F.col("_stretch") == F.col("_at")) & (F.col("start") >= F.col("sent_start")) & (F.col("end") <= F.col("sent_end"))
    return s.join(m, on).drop("_key", "_at", "_stretch")


def sentence_mentions(docs: DataFrame, key: str, text: str, factory: Callable[[], Detector] | None = None, source: str = "pattern") -> DataFrame:
    """mentions_in_sentences(sentence_spans, detect_mentions) in one pass over the texts, without a join.

    Sentences come in order of place, and so do a detector's mentions, or they are sorted; each
    mention is placed by binary search.
    """
    factory = factory or pattern_detector()
    def start():
        detector = factory()

        def run(columns):
            keys, texts, sentences = columns
            for k, t, ss, ms in zip(keys, texts, sentences, detector(texts), strict=True):
                starts, ends, at = [], [], 0
                for s in ss if ss is not None else ():
                    found = t.find(s, at)
                    starts.append(found if found >= 0 else at)
                    at = starts[-1] + len(s)
                    ends.append(at)
                for pos, (mention, kind, start, end) in enumerate(ms):
                    i = bisect_right(starts, start) - 1
                    if i >= 0 and end <= ends[i] and (kind or "") not in LOW_VALUE_TYPES:
                        yield k, i, ss[i], starts[i], ends[i], pos, mention, kind, start, end, source

        return run

    thin = docs.select(key, F.col(text).alias("_t"), split_sentences(F.col(text)).alias("_s"))
    return thin.transform(by_rows(start, f"{key} {docs.schema[key].dataType.simpleString()}, sent_idx int, sentence string, sent_start int, sent_end int, pos int, mention string, type string, start int, end int, source string"))


def first_of_span(placed: DataFrame, key: str) -> DataFrame:
    """One row for each (sentence, mention, start, end)."""
    first = Window.partitionBy(key, "sent_idx", "mention", "start", "end").orderBy("pos")
    return placed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def candidate_pairs(placed: DataFrame, key: str, most: int = 10) -> DataFrame:
    """The first `most` pairs of each sentence, in order of mentions, of different texts, not both dates.

    The pairs of a sentence are made from its own list, cut while they are made: no more than
    `most` rows leave a sentence, however many mentions it has.
    """
    fields = ["pos", "mention", "type", "start", "end"] + (["qid"] if "qid" in placed.columns else [])
    lists = placed.groupBy(key, "sent_idx").agg(F.first("sentence").alias("sentence"), F.array_sort(F.collect_list(F.struct(*fields))).alias("m"))
    usable = lambda a, b: (a["mention"] != b["mention"]) & ~(a["type"].eqNullSafe(F.lit("DATE")) & b["type"].eqNullSafe(F.lit("DATE")))
    paired = lambda a, i, m: F.transform(F.slice(F.filter(F.transform(m, lambda b, j: F.struct(b.alias("b"), j.alias("j"))), lambda x: (x["j"] > i) & usable(a, x["b"])), 1, most), lambda x: F.struct(a.alias("a"), x["b"].alias("b")))
    # A fold keeps the first pairs only, so later mentions add nothing once the list is full.
    start = F.expr(f"cast(array() as array<struct<a: {lists.schema['m'].dataType.elementType.simpleString()}, b: {lists.schema['m'].dataType.elementType.simpleString()}>>)")
    indexed = F.transform("m", lambda a, i: F.struct(a.alias("a"), i.alias("i")))
    pairs = F.aggregate(indexed, start, lambda acc, x: F.when(F.size(acc) >= most, acc).otherwise(F.slice(F.concat(acc, paired(x["a"], x["i"], F.col("m"))), 1, most)))
    out = lists.select(key, "sent_idx", "sentence", F.posexplode(pairs).alias("pair", "p"))
    sides = [F.col(f"p.{s}.{f}").alias(n if f == "mention" else f"{n}_{f}") for s, n in (("a", "head"), ("b", "tail")) for f in fields if f != "pos"]
    return out.select(key, "sent_idx", "sentence", (F.col("pair") + 1).alias("pair"), *sides)


def doc_totals(entities: DataFrame) -> DataFrame:
    """Numbers of documents, of entities and of linked entities. entities: doc and entities."""
    linked = F.size(F.filter("entities", lambda e: F.coalesce(e["wikidata_qid"], F.lit("")) != "")) if "wikidata_qid" in entities.schema["entities"].simpleString() else F.lit(0)
    n = F.greatest(F.size("entities"), F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return entities.agg(F.count("*").alias("docs"), zero(F.sum(n)).alias("entities"), zero(F.sum(linked)).alias("linked"))


def with_documents(entities: DataFrame, docs: DataFrame, key: str = "doc") -> tuple[DataFrame, DataFrame]:
    """Entities of documents that are there, with them, and the names of those that aren't."""
    return entities.join(docs, key), entities.select(key).join(docs.select(key), key, "left_anti")
