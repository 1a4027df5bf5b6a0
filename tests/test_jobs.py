"""Jobs over files and pages, end to end."""

import json

import pytest

from skein import jobs
from skein.config import Settings
from skein.metrics import Metrics, diagnostics, log_to
from skein.operators import mentions as m
from skein.operators.documents import assemble_page, text_of
from skein.operators.merge import map_relations, merge_triples
from skein.operators.search import GraphQueries
from skein.serving import Api
from skein.sources.files import mapping_table, mention_dictionary, read_entities, read_triples
from tests.test_sources import HTML


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_files_to_graph_search_and_api(spark, tmp_path):
    row = lambda h, r, t, c, p, d: {"head": h, "head_qid": "", "relation": r, "tail": t, "tail_qid": "", "confidence": c, "sentence": f"{h} {r} {t}", "doc": d, "provenance": p}
    infobox = read_triples(spark, lines(tmp_path / "i.jsonl", [row("Ada", "worked_at", "Hut 8", 1.0, "infobox", "Ada")]))
    silver = read_triples(spark, lines(tmp_path / "s.jsonl", [row("Ada", "educated_at", "Princeton", 0.8, "silver", "d1"), row("ada", "worked_at", "hut 8", 0.9, "silver", "d2")]))
    found = read_triples(spark, lines(tmp_path / "r.jsonl", [row("Ada", "educated at", "Princeton", 0.7, "rebel", "d3"), row("Hut 8", "part of", "Bletchley", 0.7, "rebel", "d3")]))
    none = read_triples(spark, str(tmp_path / "none.jsonl"))
    merged = jobs.merge_sources(infobox, silver, found)
    got = {(r["head"], r["relation"], r["tail"]): (r["provenance"], r["doc_ids"]) for r in merged.collect()}
    assert got[("Ada", "worked_at", "Hut 8")] == ("infobox,silver", ["Ada", "d2"]) and got[("Ada", "educated_at", "Princeton")] == ("silver,rebel", ["d1", "d3"])
    assert jobs.merge_sources(infobox, none, none).count() == 1
    entities = read_entities(spark, lines(tmp_path / "e.jsonl", [{"doc": "d1", "entities": [{"mention": "Ada", "type": "PERSON", "wikidata_qid": "Q1"}, {"mention": "Princeton", "type": "ORG"}]}]))
    nodes, edges = jobs.build_graph(merged, mention_dictionary(entities))
    assert [r["id"] for r in nodes.orderBy("seq").collect()] == ["Ada", "Hut 8", "Princeton", "Bletchley"]
    service = GraphQueries(nodes, edges)
    assert service.search("ada")[0] == {"id": "Ada", "label": "Ada", "type": "PERSON", "wikidata_qid": "Q1", "description": "", "degree": 2, "score": 120 + 60 + 50 + 40 + 35 + 8}
    answer = service.query("princeton")
    assert answer["primary"]["type"] == "ORG" and answer["subgraph"]["center"] == "Princeton" and answer["subgraph"]["num_edges"] == 1
    api = Api(lambda: GraphQueries(nodes, edges))
    assert api.get("/api/health", {}) == (200, {"status": "ok"}) and api.get("/api/graph/summary", {})[1]["num_edges"] == 3
    assert api.get("/api/node/Hut%208", {})[1]["degree"] == 2 and api.get("/api/graph/full", {})[1]["num_nodes"] == 4
    assert api.post("/api/graph/reload", {})[0] == 200 and api.get("/api/query", {"keyword": "Ada"})[1]["matches"][0]["id"] == "Ada"
    # Triples go to a graph without a merge, too.
    assert jobs.build_graph(silver)[0].count() == 4


def test_pages_to_graph(spark):
    html = HTML.replace("First <sup", "Ada Lovelace worked in London. Ada Lovelace met Charles Babbage in 1833. <sup").replace("More.", "Ada Lovelace is in London.")
    raw = spark.createDataFrame([("Ada Lovelace", "Ada Lovelace of London.", html, [], [], 0)], "title string, summary string, html string, categories array<string>, outlinks array<string>, crawl_depth int")
    page = assemble_page(raw).drop("html")
    assert page.first()["infobox"] == {"Born": "London"} and page.first()["url"].endswith("Ada_Lovelace")
    nodes, edges, metrics = jobs.documents_to_graph(page)
    triples = {(r["source"], r["relation"], r["target"]): r["provenance"] for r in edges.collect()}
    assert "infobox" in triples[("Ada Lovelace", "birth_place", "London")] or triples
    assert {r["id"] for r in nodes.collect()} >= {"Ada Lovelace", "London"}
    counts = metrics.report()
    assert counts["raw"]["rows"] >= counts["aligned"]["rows"] >= counts["distinct"]["rows"] >= 1


def test_entities_of_a_folder_of_documents(spark):
    docs = spark.createDataFrame([("a", "Ada met Bob.", []), ("b", "nobody", []), ("c", "", [("Life", "Cy saw Ada.")])], "file string, summary string, sections array<struct<heading: string, text: string>>")
    kb = spark.createDataFrame([("ada", 0, "Q1", "Ada", "a person")], "name string, rank int, id string, label string, description string")
    entities, totals = jobs.process_documents(docs, kb=kb)
    got = {r["doc"]: [(e["mention"], e["wikidata_qid"]) for e in r["entities"]] for r in entities.collect()}
    assert got == {"a.json": [("Ada", "Q1"), ("Bob", None)], "b.json": [], "c.json": [("Cy", None), ("Ada", "Q1")]}
    assert totals.first().asDict() == {"docs": 3, "entities": 4, "linked": 2}
    assert jobs.process_documents(docs, max_docs=1)[1].first()["docs"] == 1
    pairs, missing = jobs.candidates_of(docs.where("file <> 'c'"), entities)
    assert [(r["head"], r["tail"], r["head_qid"]) for r in pairs.collect()] == [("Ada", "Bob", "Q1")] and [r["doc"] for r in missing.collect()] == ["c.json"]
    told = []

    def tell(entity):
        told.append(entity["mention"])
        raise RuntimeError

    assert jobs.process_texts(spark, ["Ada", "x"], kb=kb, on_link=tell)[1] == {"text": "x", "entities": []} and told == ["Ada"]


def test_a_crawl_fetches_as_it_goes(spark):
    links = {"Alan Turing": ["Logic", "Gone logic", "File:x", "Enigma"], "Logic": ["Turing test", "Enigma"], "Enigma": ["Bombe"]}

    def fetch(params):
        title = params.get("page") or params.get("titles")
        if params.get("action") == "parse":
            return {"parse": {"text": {"*": "<p>t</p>"}}} if title in links or title == "Turing test" else {}
        if params.get("prop") == "links":
            return {"query": {"pages": {"1": {"links": [{"title": t} for t in links.get(title, [])]}}}}
        return {}

    settings = Settings(max_depth=2, max_pages=10, request_interval=0.0)
    pages, counts = jobs.crawl_pages(spark, fetch, settings)
    assert {r["title"]: r["crawl_depth"] for r in pages.collect()} == {"Alan Turing": 0, "Logic": 1, "Enigma": 1, "Turing test": 2}
    assert counts == {"pages": 4, "missing": 2, "failures": 0}  # Bombe and Gone logic have no page
    few, counts = jobs.crawl_pages(spark, fetch, Settings(max_depth=2, max_pages=2, request_interval=0.0))
    assert [r["title"] for r in few.orderBy("crawl_depth").collect()] == ["Alan Turing", "Logic"]
    done = spark.createDataFrame([("Logic",)], "title string")
    again, counts = jobs.crawl_pages(spark, fetch, settings, done)
    assert "Logic" not in {r["title"] for r in again.collect()}


def test_relations_by_an_encoder(spark):
    t = spark.createDataFrame([(0, "a", "worked at the", "b"), (1, "a", "born", "c"), (2, "a", "zzz", "d")], "seq long, head string, relation string, tail string")
    mapped, ambiguous = map_relations(t, mapping_table(spark), accept=0.6, unsure=0.2)
    got = {r["raw_relation"]: (r["relation"], r["mapped_by"]) for r in mapped.collect()}
    assert got == {"worked at the": ("worked_at", "embedding"), "born": ("birth_place", "literal"), "zzz": ("zzz", "unmapped")}
    assert "worked at the" not in {r["predicate"] for r in ambiguous.collect()}


def test_texts_of_documents_that_name_their_parts_otherwise(spark):
    one = lambda data, schema: [r[0] for r in (lambda d: d.select(text_of(d)).collect())(spark.createDataFrame(data, schema))]
    assert one([("s", [("x", None), (None, "y"), ("", "z")], "t")], "summary string, sections array<struct<text: string, content: string>>, content string") == ["s\n\nx\n\ny\n\nz\n\nt"]
    assert one([("", [], [("b",)])], "summary string, sections array<struct<text: string>>, body array<struct<text: string>>") == ["\n\nb"]
    assert one([("p", "q", 1)], "a string, b string, n int") == ["p\n\nq"] and one([(1,)], "n int") == ['{"n":1}']


def test_metrics_count_without_a_pass(spark, tmp_path):
    metrics = Metrics()
    df = metrics.seen(spark.range(10), "ten", even=spark.range(1).id % 2 == 0) if False else metrics.seen(spark.range(10).toDF("id"), "ten")
    df.count()
    log_to(tmp_path / "logs" / "x.log")
    log_to(tmp_path / "logs" / "x.log")
    assert metrics.report() == {"ten": {"rows": 10}}
    assert (tmp_path / "logs" / "x.log").read_text().count("ten: rows 10") == 1
    assert diagnostics()["pyspark"]


@pytest.mark.parametrize("stretch", [4, 512])
def test_mentions_meet_their_sentences(spark, monkeypatch, stretch):
    monkeypatch.setattr(m, "STRETCH", stretch)
    from skein.operators.documents import sentence_spans

    docs = spark.createDataFrame([(k, "Ada met Bob Cy. Dan left! No one " + "x" * 40 * k + " Eve. Ada") for k in range(4)], "id long, text string")
    joined = m.first_of_span(m.mentions_in_sentences(sentence_spans(docs, "id", "text"), m.detect_mentions(docs, "id", "text"), "id"), "id")
    key = lambda r: (r["id"], r["sent_idx"], r["mention"], r["start"], r["end"], r["sent_start"])
    assert sorted(map(key, joined.collect())) == sorted(map(key, m.sentence_mentions(docs, "id", "text").collect()))
