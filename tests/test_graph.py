import random

import pytest
from pyspark.sql import functions as F

from skein.operators import graph as g
from skein.operators.layout import evened, grid_slots, layout_component, to_html
from skein.operators.merge import merge_triples
from skein.operators.search import GraphQueries

NODES = [(0, "Ada", "Ada", "PERSON", "Q1", "a person"), (1, "Hut 8", "Hut 8", "FAC", "", "a place"), (2, "Princeton", "Princeton University", "ORG", "Q2", "a university")]
EDGES = [(0, "Ada", "Hut 8", "worked_at", 1.0, "s", "", "infobox"), (1, "Ada", "Princeton", "educated_at", 1.0, "s", "", "infobox")]
NODE = "seq long, id string, label string, type string, wikidata_qid string, description string"
EDGE = "seq long, source string, target string, relation string, confidence double, sentence string, doc string, provenance string"


@pytest.fixture(scope="module")
def service(spark):
    return GraphQueries(spark.createDataFrame(NODES, NODE).cache(), spark.createDataFrame(EDGES, EDGE).cache())


def test_search_finds_the_person_first(service):
    got = service.search("ada")
    assert got[0]["id"] == "Ada" and got[0]["degree"] == 2
    assert got[0]["score"] == 120 + 60 + 50 + 40 + 35 + 8


def test_search_scores_parts_add_up(service):
    got = {r["id"]: r["score"] for r in service.search("princeton")}
    assert got == {"Princeton": 110 + 60 + 50 + 40 + 35 + 8}
    assert service.search("q2")[0]["score"] == 100 + 30
    assert service.search("  ") == []


def test_details(service):
    d = service.details("ada")
    assert d["degree"] == 2 and d["outgoing"][0]["relation"] == "worked_at"
    assert [n["id"] for n in d["neighbors"]] == ["Hut 8", "Princeton"]
    with pytest.raises(KeyError):
        service.details("nobody")


def test_query_composes(service):
    got = service.query("Princeton")
    assert got["primary"]["type"] == "ORG" and got["subgraph"]["num_nodes"] >= 1
    assert service.query("")["primary"] is None


def test_summary(service):
    assert service.summary() == {"num_nodes": 3, "num_edges": 2, "node_types": {"PERSON": 1, "FAC": 1, "ORG": 1}, "relation_types": {"worked_at": 1, "educated_at": 1}}


def fold(rows):
    """The stated rule, an edge at a time."""
    out = {}
    for seq, s, t, rel, conf, sent, doc, prov in rows:
        now = out.get((s, t))
        if now is None or now[0] != rel:
            out[s, t] = [rel, conf, sent, doc, prov]
        elif conf > now[1]:
            now[1], now[2], now[4] = conf, sent, prov
    return {k: tuple(v) for k, v in out.items()}


def test_fold_edges_equals_a_sequential_fold(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.choice("ab"), rnd.choice("xyz"), rnd.choice(["r", "s"]), rnd.choice([0.1, 0.5, 0.9]), f"s{k}", f"d{k}", f"p{k}") for k in range(300)]
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    got = g.fold_edges(spark.createDataFrame(shuffled, EDGE)).collect()
    assert {(r["source"], r["target"]): (r["relation"], r["confidence"], r["sentence"], r["doc"], r["provenance"]) for r in got} == fold(rows)


def test_degrees_count_loops_twice_and_lone_nodes(spark):
    nodes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "seq long, id string")
    edges = spark.createDataFrame([(0, "a", "a"), (1, "a", "b")], "seq long, source string, target string")
    assert {r["id"]: r["degree"] for r in g.degrees(nodes, edges).collect()} == {"a": 3, "b": 1, "c": 0}


def test_components_of_a_chain_and_isolated_nodes(spark):
    n = 40
    nodes = spark.createDataFrame([(k, f"n{k:02}") for k in range(n + 1)], "seq long, id string")
    edges = spark.createDataFrame([(k, f"n{k + 1:02}", f"n{k:02}") for k in range(n - 1)], "seq long, source string, target string")
    got = {r["id"]: r["component"] for r in g.components(nodes, edges).collect()}
    assert got == {f"n{k:02}": "n00" for k in range(n)} | {f"n{n:02}": f"n{n:02}"}


def test_ego_is_cut_by_distance_then_degree(spark):
    nodes = spark.createDataFrame([(k, x, x, "T", "", "") for k, x in enumerate("abcde")], NODE)
    edges = spark.createDataFrame([(k, s, t, "r", 1.0, "", "", "") for k, (s, t) in enumerate(["ab", "ca", "cd", "de"])], EDGE)
    n, e = g.ego(nodes, edges, spark.createDataFrame([("a",)], "id string"), 2, 2)
    assert [r["id"] for r in n.collect()] == ["a", "c"]
    assert [(r["source"], r["target"]) for r in e.collect()] == [("c", "a")]


def test_layout_is_deterministic_and_drawable(spark, service):
    import numpy as np

    links = np.array([[0, 1], [1, 2], [2, 3]])
    assert np.allclose(layout_component(4, links, 20), layout_component(4, links, 20))
    assert layout_component(1, links[:0]).tolist() == [[0.0, 0.0]]
    assert len(grid_slots(5)) == 5 and evened(np.zeros((2, 2))).shape == (2, 2)
    nodes = spark.createDataFrame(NODES, NODE)
    assert "<svg" in to_html(nodes, service.edges)
    with pytest.raises(ValueError):
        to_html(nodes, service.edges, most=2)
    with pytest.raises(ValueError):
        service.full_graph(most=2)
    assert service.full_graph()["num_nodes"] == 3


def test_search_folds_cases(spark):
    nodes = spark.createDataFrame([(0, "Straße", "Straße", "LOC", "", "ΟΔΟΣ"), (1, "x", "STRASSE", "LOC", "", "")], NODE)
    s = GraphQueries(nodes, spark.createDataFrame(EDGES[:1], EDGE))
    assert {r["id"] for r in s.search("STRASSE")} == {"Straße", "x"} and s.search("οδος")[0]["id"] == "Straße"
    assert s.resolve("strasse") == "Straße"


def test_graph_from_triples_with_any_order(spark):
    """seq may be a struct, as file readers and merges give it."""
    rows = [(("f", 1), "B", "r", "C"), (("f", 0), "A", "r", "B"), (("g", 0), "A", "q", "B")]
    t = spark.createDataFrame(rows, "seq struct<file: string, at: long>, head string, relation string, tail string")
    t = t.selectExpr("*", "1.0D AS confidence", "'' AS sentence", "'' AS doc", "'x' AS provenance", "'' AS head_qid", "'' AS tail_qid")
    for triples in (t, merge_triples(t)):
        e = g.edges_multi(triples.withColumn("doc", F.lit("")))
        nodes = g.node_table(e)
        assert [r["id"] for r in nodes.orderBy("seq").collect()] == ["A", "B", "C"]
        assert {(r["source"], r["target"]): r["relation"] for r in g.fold_edges(e).collect()} == {("A", "B"): "q", ("B", "C"): "r"}
        assert g.max_degree(nodes, g.fold_edges(e)).first()[0] == 2


def test_highlight_classes(spark):
    edges = spark.createDataFrame(EDGES, EDGE)
    got = {r["id"]: r["class"] for r in g.highlight(edges, spark.createDataFrame([("Hut 8",)], "id string")).collect()}
    assert got == {"Hut 8": "selected", "Ada": "first", "Princeton": "second"}
    assert g.select_by(spark.createDataFrame(NODES, NODE), "type", ["ORG"]).select(F.col("id")).collect()[0][0] == "Princeton"
