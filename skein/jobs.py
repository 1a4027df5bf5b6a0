"""Jobs from pages to a graph: the stages in order, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.config import Settings
from skein.metrics import Metrics
from skein.operators import mentions as m
from skein.operators import merge as mg
from skein.operators import triples as tr
from skein.operators.crawl import is_relevant
from skein.operators.documents import clean_documents, full_text
from skein.operators.graph import edges_multi, fold_edges, node_table
from skein.session import Tables
from skein.sources.files import mapping_table, remaining
from skein.sources.wiki import Fetch, fetch_pages, found_pages


def crawl_pages(spark: SparkSession, fetch: Fetch, settings: Settings | None = None, done: DataFrame | None = None, base_url: str = "https://en.wikipedia.org/wiki/") -> tuple[DataFrame, dict[str, int]]:
    """Raw pages of a crawl that fetches as it goes, and counts of pages, titles without page, and failures.

    A level is fetched at a time, each title once; pages within the budget count, in the order in
    which links named them. done: titles of an earlier run, which aren't fetched, count nothing and
    lead nowhere but by their own place as a seed. Workers wait request_interval between requests.
    """
    s = settings or Settings()
    tables, left, pages = Tables(spark), s.max_pages, None
    counts = {"pages": 0, "missing": 0, "failures": 0}
    level = spark.createDataFrame([(s.seed_page, [0])], "title string, place array<int>")
    visited = level.select("title")
    for depth in range(s.max_depth + 1):
        asked = (level if done is None else remaining(level, done)).orderBy("place", "title").limit(left)
        asked = tables.written(asked, "crawl-level")
        got = tables.written(fetch_pages(asked.withColumn("crawl_depth", F.lit(depth)), fetch, base_url, s.request_interval), "crawl-pages")
        numbers = got.agg(F.count("url").alias("pages"), F.count_if(F.col("url").isNull()).alias("missing"), F.coalesce(F.sum("failures"), F.lit(0)).alias("failures")).first()
        for k in counts:
            counts[k] += numbers[k]
        fresh = found_pages(got)
        pages = fresh if pages is None else pages.unionByName(fresh)
        left -= numbers["pages"]
        if left <= 0 or depth == s.max_depth:
            break
        links = fresh.select("title", F.posexplode("outlinks").alias("pos", "target")).join(asked, "title")
        named = links.select(F.col("target").alias("title"), F.concat("place", F.array("pos")).alias("place")).groupBy("title").agg(F.min("place").alias("place"))
        level = tables.written(named.where(is_relevant(F.col("title"), s)).join(visited, "title", "left_anti"), "crawl-next")
        visited = visited.union(level.select("title"))
    return pages, counts


def entities_of(docs: DataFrame, key: str, text: str, factory: Callable[[], m.Detector] | None = None, kb: DataFrame | None = None, top_k: int = 5) -> DataFrame:
    """key and entities of each document with any: mentions, and their links where a knowledge base is given."""
    found = m.detect_mentions(docs, key, text, factory)
    return m.entity_rows(found, m.link_mentions(found, kb, top_k) if kb is not None else None, key)


def process_texts(spark: SparkSession, texts: list[str], factory: Callable[[], m.Detector] | None = None, kb: DataFrame | None = None, top_k: int = 5, on_link: Callable[[dict], None] | None = None) -> list[dict]:
    """Texts with their entities, for trials of a few texts. on_link is told of each entity, and may fail."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    rows = {r["doc"]: [e.asDict() for e in r["entities"]] for r in entities_of(docs, "doc", "text", factory, kb, top_k).collect()}
    out = [{"text": t, "entities": rows.get(k, [])} for k, t in enumerate(texts)]
    for e in (e for x in out for e in x["entities"] if on_link):
        try:
            on_link(e)
        except Exception:  # progress is no reason to stop
            continue
    return out


def process_documents(docs: DataFrame, factory: Callable[[], m.Detector] | None = None, kb: DataFrame | None = None, max_docs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """doc and entities of processed documents (with file), one row each, and their totals.

    A document without mentions has an empty list.
    """
    if max_docs is not None:
        docs = docs.orderBy("file").limit(max_docs)
    texts = docs.select(F.concat("file", F.lit(".json")).alias("doc"), full_text(F.col("summary"), F.col("sections")).alias("text"))
    found = entities_of(texts, "doc", "text", factory, kb)
    empty = F.array().cast(found.schema["entities"].dataType)
    entities = texts.select("doc").join(found, "doc", "left").withColumn("entities", F.coalesce("entities", empty))
    return entities, m.doc_totals(entities)


def candidates_of(docs: DataFrame, entities: DataFrame, max_pairs: int = 10) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of documents' entities within sentences, and the documents that are missing."""
    texts = docs.select(F.concat("file", F.lit(".json")).alias("doc"), full_text(F.col("summary"), F.col("sections")).alias("text"))
    there, missing = m.with_documents(entities, texts, "doc")
    listed = there.select("doc", F.posexplode("entities").alias("pos", "e")).select("doc", "pos", "e.*").withColumnRenamed("wikidata_qid", "qid")
    from skein.operators.documents import sentence_spans

    placed = m.first_of_span(m.mentions_in_sentences(sentence_spans(texts, "doc", "text"), listed, "doc"), "doc")
    pairs = m.candidate_pairs(placed, "doc", max_pairs)
    return pairs.withColumn("cand_seq", F.struct("doc", "sent_idx", "pair")), missing


def extract(candidates: DataFrame, generator: Callable[[], tr.Generator] | None = None, metrics: Metrics | None = None) -> DataFrame:
    """Triples that a generator finds in the candidates' sentences, aligned and distinct; raw, aligned and distinct are counted."""
    count = metrics or Metrics()
    raw = count.seen(tr.extracted(tr.generate(candidates.select("sentence"), generator or tr.pattern_generator())), "raw")
    aligned = count.seen(tr.align(raw, candidates), "aligned")
    first = count.seen(tr.first_triples(aligned, "cand_seq", "gen_pos"), "distinct")
    have = lambda c, d: (F.coalesce(F.col(c), F.lit(d)) if c in first.columns else F.lit(d)).alias(c)
    return first.select(
        F.struct("cand_seq", "gen_pos").alias("seq"), "head", have("head_qid", ""), "relation", "tail", have("tail_qid", ""), F.lit(0.7).alias("confidence"), "sentence", "doc", F.lit("rebel").alias("provenance"), "head_mention", "tail_mention"
    )


def merge_sources(infobox: DataFrame, silver: DataFrame, extracted: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """The three sources in order, with mapped relations, merged. Each has seq and the columns of triples."""
    mapping = mapping if mapping is not None else mapping_table(infobox.sparkSession)
    mapped, _ = mg.map_relations(extracted, mapping)
    columns = ["seq", "head", "head_qid", "relation", "tail", "tail_qid", "confidence", "sentence", "doc", "provenance"]
    return mg.merge_triples(mg.in_order(infobox.select(*columns), silver.select(*columns), mapped.select(*columns)))


def build_graph(triples: DataFrame, dictionary: DataFrame | None = None, aliases: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of triples with seq, as files or a merge give them: doc, or the first of doc_ids."""
    if "doc" not in triples.columns and "doc_ids" in triples.columns:
        triples = triples.withColumn("doc", F.coalesce(F.try_element_at("doc_ids", F.lit(1)), F.lit("")))
    edges = edges_multi(triples, aliases)
    return node_table(edges, dictionary), fold_edges(edges)


def documents_to_graph(raw: DataFrame, kb: DataFrame | None = None, factory: Callable[[], m.Detector] | None = None, generator: Callable[[], tr.Generator] | None = None) -> tuple[DataFrame, DataFrame, Metrics]:
    """Raw pages (with file) to nodes and edges, through all stages, and the counts."""
    spark, metrics = raw.sparkSession, Metrics()
    tables = Tables(spark)
    docs = tables.written(clean_documents(raw).withColumn("file", F.col("title")), "job-documents")
    entities, _ = process_documents(docs, factory, kb)
    entities = tables.written(entities, "job-entities")
    mapping = mapping_table(spark)
    infobox = tr.attribute_triples(docs, mapping).withColumn("seq", F.to_json(F.struct("doc", "entry", "part")))
    infobox = tables.written(infobox.drop("entry", "part"), "job-infobox")
    pairs, _ = candidates_of(docs, entities)
    pairs = tables.written(pairs, "job-candidates")
    facts = infobox.select(F.col("seq").alias("fact_seq"), "head", "relation", "tail")
    labelled = tr.distant_labels(pairs, facts)
    silver = tr.silver_triples(labelled).withColumn("seq", F.to_json("cand_seq"))
    found = extract(pairs, generator, metrics).withColumn("seq", F.to_json("seq"))
    merged = tables.written(merge_sources(infobox, silver, found, mapping), "job-merged")
    names = entities.select("doc", F.posexplode("entities").alias("at", "e")).select("doc", "at", "e.*")
    fields = [c for c in ("type", "wikidata_qid", "wikidata_description") if c in names.columns]
    first = names.groupBy("mention").agg(F.min_by(F.struct(*fields), F.struct("doc", "at")).alias("f")).select("mention", "f.*")
    return *build_graph(merged, first), metrics
