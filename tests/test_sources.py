import json
import xml.etree.ElementTree as ET

import pytest

from skein.config import load_settings
from skein.functions.html import infobox, sections
from skein.operators.search import GraphQueries
from skein.serving import Api, Runs
from skein.sources import files, sinks, wiki
from skein.streaming import ingest

HTML = """<div class="mw-parser-output"><table class="infobox vcard"><tr><th>Born</th><td>London</td></tr><tr><th>X</th></tr></table>
<p>First <sup class="reference">[1]</sup>text.</p><div class="mw-heading2"><h2>Life</h2></div><p>More.</p><div class="navbox"><p>no</p></div><h3>Work</h3><p>Last.</p></div>"""


def test_html_sections_and_infobox():
    assert sections(HTML) == [{"heading": "Introduction", "text": "First text."}, {"heading": "Life", "text": "More."}, {"heading": "Work", "text": "Last."}]
    assert infobox(HTML) == {"Born": "London"} and sections(None) == [] and infobox("") == {}


def test_json_scan_skips_broken_files(spark, tmp_path):
    (tmp_path / "A.json").write_text(json.dumps({"title": "A", "infobox": {"k": "v"}}))
    (tmp_path / "B.json").write_text("{broken")
    assert [r["title"] for r in files.read_processed(spark, str(tmp_path)).collect()] == ["A"]
    assert [r["file"] for r in files.skipped_files(spark, str(tmp_path)).collect()] == ["B"]
    assert files.read_processed(spark, str(tmp_path), only=["A", "C"]).count() == 1


def test_jsonl_and_dictionaries(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"doc":"d","entities":[{"mention":"a","type":"X"}]}\n\n{"doc":"d","entities":[{"mention":"a","type":"Y"},{"mention":"b","type":"Z"}]}\n')
    e = files.read_entities(spark, str(tmp_path / "e.jsonl"))
    assert [[m["type"] for m in r["entities"]] for r in e.collect()] == [["Y", "Z"]]
    assert {r["mention"]: r["type"] for r in files.mention_dictionary(e).collect()} == {"a": "Y", "b": "Z"}
    assert files.read_triples(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_graph_round_trip_and_exports(spark, tmp_path):
    doc = {"nodes": [{"id": " a ", "label": "A&B"}, {"id": ""}], "edges": [{"source": "a", "target": "z", "relation": "r", "confidence": 0.5}, {"source": "a", "target": "z", "relation": "s"}, {"source": "", "target": "z"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    nodes, edges = files.read_graph(spark, str(tmp_path / "g.json"))
    assert [r["id"] for r in nodes.orderBy("seq").collect()] == ["a", "z"] and [r["relation"] for r in edges.collect()] == ["s"]
    sinks.write_graph_json(nodes, edges, tmp_path / "out.json")
    out = json.loads((tmp_path / "out.json").read_text())
    assert out["stats"] == {"num_nodes": 2, "num_edges": 1} and out["nodes"][0]["label"] == "A&B"
    for write, name in ((sinks.write_graphml, "g.graphml"), (sinks.write_gexf, "g.gexf")):
        write(nodes, edges, tmp_path / name)
        assert sum(1 for x in ET.parse(tmp_path / name).iter() if x.tag.endswith("}node")) == 2
    assert sinks.graph_document(nodes, edges).first()["stats"]["num_nodes"] == 2
    sinks.write_jsonl(edges, str(tmp_path / "e"), gzip=True)
    assert spark.read.json(str(tmp_path / "e")).count() == 1


def test_wiki_connector_with_a_table_of_answers(spark):
    def fetch(params):
        if params.get("action") == "parse":
            return {"parse": {"text": {"*": HTML}}} if params["page"] == "Turing" else {}
        if params.get("prop") == "links":
            return {"query": {"pages": {"1": {"links": [{"title": "B"}]}}}} if "plcontinue" in params else {"query": {"pages": {"1": {"links": [{"title": "A"}]}}}, "continue": {"plcontinue": "x"}}
        if params.get("action") == "wbsearchentities":
            return {"search": [{"id": "Q1", "label": "L", "description": "D"}] * 3}
        raise OSError

    t = spark.createDataFrame([("Turing", 0), ("Gone", 1)], "title string, crawl_depth int")
    got = wiki.fetch_pages(t, fetch).cache()
    assert {x["title"]: (x["url"] is None, x["failures"] > 0) for x in got.collect()} == {"Turing": (False, True), "Gone": (True, False)}
    r = wiki.found_pages(got).collect()
    assert len(r) == 1 and r[0]["outlinks"] == ["A", "B"] and r[0]["infobox"] == {"Born": "London"} and r[0]["summary"] == ""
    assert wiki.search_terms(spark.createDataFrame([("m",), ("m",)], "mention string"), fetch, 2).count() == 2


def test_settings_fall_back(tmp_path):
    (tmp_path / "s.yaml").write_text("crawler: {max_depth: 5, relevance: {seed_keywords: [x]}}")
    assert load_settings(tmp_path / "s.yaml").max_depth == 5 and load_settings(tmp_path / "s.yaml").seed_keywords == ("x",)
    assert load_settings(tmp_path / "none.yaml").max_depth == 2


def test_stream_of_triples(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = {"head": "A", "relation": "r", "tail": "B", "confidence": 0.5, "sentence": "s", "doc": "d", "provenance": "rebel", "head_qid": "", "tail_qid": "", "at": 0}
    for k, source in enumerate(("rebel", "infobox")):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(row | {"provenance": source, "doc": f"d{k}"}))
        q = ingest.append_to_store(ingest.triple_stream(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "cp"))
        q.awaitTermination()
    got = ingest.merged_store(spark, str(tmp_path / "store")).collect()
    assert [(r["provenance"], r["doc_ids"]) for r in got] == [("rebel,infobox", ["d0", "d1"])]


def test_api(spark):
    from tests.test_graph import EDGE, EDGES, NODE, NODES

    api = Api(lambda: GraphQueries(spark.createDataFrame(NODES, NODE), spark.createDataFrame(EDGES, EDGE)), {"ok": ("Ok", ["true"])})
    assert api.get("/api/graph/summary", {})[1]["num_nodes"] == 3
    assert api.get("/api/query", {"keyword": "ada", "limit": "99"})[0] == 200
    assert api.get("/api/query", {"keyword": "ada", "limit": "x"})[0] == 400
    assert api.get("/api/node/nobody", {})[0] == 404 and api.get("/nope", {})[0] == 404
    assert api.post("/api/scripts/run", {"script_id": "bad"})[0] == 400
    status, task = api.post("/api/scripts/run", {"script_id": "ok"})
    assert status == 202 and api.get(f"/api/tasks/{task['task_id']}", {})[0] == 200


def test_requests_are_spaced_tried_again_and_counted():
    waits, calls = [], []

    def flaky(params):
        calls.append(params)
        if len(calls) < 3:
            raise OSError
        return {"ok": 1}

    ask = wiki.Politely(flaky, 2.0, 3, waits.append)
    assert ask({}) == {"ok": 1} and waits == [4.0, 8.0] and (ask.requests, ask.failures) == (3, 0)

    def faulty(params):
        raise KeyError("a fault of the program")

    with pytest.raises(KeyError):
        wiki.Politely(faulty)({})

    def down(params):
        raise TimeoutError

    ask = wiki.Politely(down, 0.0, 2)
    assert ask({}) == {} and (ask.requests, ask.failures) == (2, 1)


def test_files_for_each_row_backups_and_existing_titles(spark, tmp_path):
    docs = spark.createDataFrame([("A/B: c", "x"), ("D e", None)], "title string, summary string")
    assert sinks.write_each(docs, tmp_path / "each") == 2
    assert json.loads((tmp_path / "each" / "A_B_ c.json").read_text()) == {"title": "A/B: c", "summary": "x"}
    done = files.existing_titles(spark, str(tmp_path / "each"))
    assert {r["title"] for r in done.collect()} == {"A B  c", "D e"}
    asked = spark.createDataFrame([("A/B: c",), ("D e",), ("New",)], "title string")
    assert [r["title"] for r in files.remaining(asked, done).collect()] == ["New"]
    assert files.existing_titles(spark, str(tmp_path / "nowhere")).count() == 0
    file = tmp_path / "t.jsonl"
    file.write_text("1")
    assert sinks.keep_backup(file).name == "t.jsonl.bak" and not file.exists()
    file.write_text("2")
    assert sinks.keep_backup(file) == file and (tmp_path / "t.jsonl.bak").read_text() == "1"
    sinks.write_text("<svg/>", tmp_path / "d" / "g.svg")
    assert (tmp_path / "d" / "g.svg").read_text() == "<svg/>"


def test_the_dictionary_takes_the_first_to_arrive(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"doc":"z","entities":[{"mention":"a","type":"X"}]}\n{"doc":"b","entities":[{"mention":"a","type":"Y"}]}\n')
    e = files.read_entities(spark, str(tmp_path / "e.jsonl"))
    assert {r["mention"]: r["type"] for r in files.mention_dictionary(e).collect()} == {"a": "X"}


def test_runs_are_bounded_and_report(tmp_path):
    runs = Runs({"ok": ("Ok", ["echo", "hi"]), "bad": ("Bad", ["false"]), "none": ("None", ["/no/such/program"])})
    seen = {}
    for k in runs.catalog:
        run = runs.start(k)
        runs.futures[run["task_id"]][2].exception()
        seen[k] = runs.seen(run["task_id"])
    assert (seen["ok"]["status"], seen["ok"]["output"], seen["ok"]["exit_code"]) == ("done", "hi\n", 0)
    assert seen["bad"]["status"] == "failed" and seen["none"]["status"] == "failed" and runs.start("ok")["status"] in ("pending", "running", "done")
