"""Case folding, compared with Python's over whole ranges of letters."""

import unicodedata

from pyspark.sql import functions as F

from skein.functions.text import casefold, search_norm, search_text
from skein.operators.search import GraphQueries
from tests.test_graph import EDGE, EDGES, NODE


def folded(spark, texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "c string").select(casefold(F.col("c"))).collect()]


def test_folding_spells_out_what_python_spells_out(spark):
    words = ["Straße", "STRASSE", "ΟΔΟΣ", "οδος", "ﬁne", "İstanbul", "ısı", "ŒUVRE", "ẞ", "µ", "ŉ", "ΰ", "plain"]
    assert folded(spark, words) == [w.casefold() for w in words]


def test_folding_differs_on_cherokee_and_unassigned_signs_alone(spark):
    chars = [chr(c) for c in [*range(1, 0x3000), *range(0xA640, 0xAC00), *range(0xFB00, 0xFB18)]]
    other = [c for c, f in zip(chars, folded(spark, chars), strict=True) if f != c.casefold()]
    assert [c for c in other if "CHEROKEE" not in unicodedata.name(c, "") and unicodedata.category(c) != "Cn"] == []


def test_a_search_finds_either_spelling(spark):
    nodes = spark.createDataFrame([(0, "Straße", "Straße", "LOC", "", "ﬁne µ"), (1, "x", "STRASSE", "LOC", "", "")], NODE)
    service = GraphQueries(nodes, spark.createDataFrame(EDGES[:1], EDGE))
    assert [r["id"] for r in service.search("strasse")] == [r["id"] for r in service.search("STRAẞE")] == ["Straße", "x"]
    assert service.search("FINE Μ")[0]["id"] == "Straße" and service.resolve("strasse") == "Straße"
    assert nodes.select(search_norm(F.col("id"))).first()[0] == search_text("Straße") == "strasse"
