"""Queries over a graph: keyword search, node details, subgraphs, and the three together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import search_norm, search_text, tokens
from skein.operators.graph import degrees, degrees_of, ego, summary, with_degrees
from skein.session import Tables


def search_index(nodes: DataFrame) -> DataFrame:
    """Nodes with normalised fields and the tokens of label and description."""
    c = lambda name, d: F.coalesce(name, F.lit(d)) if isinstance(d, str) else F.coalesce(name, d)
    label = c("label", F.col("id"))
    return nodes.withColumns({
        "n_label": search_norm(label), "n_id": search_norm(F.col("id")), "n_type": search_norm(c("type", "UNKNOWN")), "n_qid": search_norm(c("wikidata_qid", "")),
        "n_description": search_norm(c("description", "")), "n_tokens": tokens(F.concat_ws(" ", label, c("description", ""))),
    })


def search_score(keyword: str) -> Column:
    """The score of an index row: one exact match counts, all partial ones and tokens add to it."""
    q = F.lit(search_text(keyword))
    col, when = F.col, lambda cond, points: F.when(cond, points).otherwise(0)
    exact = F.when(col("n_label") == q, 120).when(col("n_id") == q, 110).when((col("n_qid") != "") & (col("n_qid") == q), 100).otherwise(0)
    parts = (
        when(F.startswith(col("n_label"), q), 60) + when(F.startswith(col("n_id"), q), 50) + when(F.contains(col("n_label"), q), 40) + when(F.contains(col("n_id"), q), 35)
        + when((col("n_qid") != "") & F.contains(col("n_qid"), q), 30) + when(F.contains(col("n_type"), q), 20) + when(F.contains(col("n_description"), q), 10)
    )
    return exact + parts + 8 * F.size(F.array_intersect(tokens(F.lit(keyword)), col("n_tokens")))


def search_nodes(nodes: DataFrame, edges: DataFrame, keyword: str, limit: int = 10) -> DataFrame:
    """Matches by score, degree, label, id: a top-k, not a sort of all nodes. A blank keyword finds none."""
    index = nodes if "n_tokens" in nodes.columns else search_index(nodes)
    hits = index.withColumn("score", search_score(keyword)).where("score > 0") if keyword.strip() else index.withColumn("score", F.lit(0)).limit(0)
    out = hits if "degree" in nodes.columns else hits.join(degrees_of(hits, edges).select("id", "degree"), "id")
    return out.orderBy(F.desc("score"), F.desc("degree"), "n_label", "id").limit(limit).select("id", "label", "type", "wikidata_qid", "description", "degree", F.col("score").cast("double").alias("score"))


def resolve_node(nodes: DataFrame, name: str) -> DataFrame:
    """The node of this id, else the first whose normalised id or label equals the name's; else none."""
    q = search_text(name)
    n_id, n_label = (F.col("n_id"), F.col("n_label")) if "n_id" in nodes.columns else (search_norm(F.col("id")), search_norm(F.coalesce("label", "id")))
    found = nodes.where((F.col("id") == name) | (n_id == q) | (n_label == q))
    return found.orderBy(F.desc(F.col("id") == name), "seq").limit(1)


def _named(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    n = nodes.select(F.col("id").alias(end), F.coalesce("label", "id").alias(f"{end}_label"), F.coalesce("type", F.lit("UNKNOWN")).alias(f"{end}_type"))
    return edges.join(n, end, "left")


def outgoing(nodes: DataFrame, edges: DataFrame, node_id: str, limit: int = 20) -> DataFrame:
    rows = _named(edges.where(F.col("source") == node_id), nodes, "target")
    return rows.orderBy(F.lower("target"), F.lower("relation"), "target", "seq").limit(limit).select("source", "target", "relation", "confidence", "sentence", "doc", "provenance", F.lit("out").alias("direction"), "target_label", "target_type")


def incoming(nodes: DataFrame, edges: DataFrame, node_id: str, limit: int = 20) -> DataFrame:
    rows = _named(edges.where(F.col("target") == node_id), nodes, "source")
    return rows.orderBy(F.lower("source"), F.lower("relation"), "source", "seq").limit(limit).select("source", "target", "relation", "confidence", "sentence", "doc", "provenance", F.lit("in").alias("direction"), "source_label", "source_type")


def neighbors(nodes: DataFrame, edges: DataFrame, node_id: str, limit: int = 20, shown: int = 5) -> DataFrame:
    """Neighbours with their number of relations and the first five of each direction; a loop counts twice."""
    e = edges.where((F.col("source") == node_id) | (F.col("target") == node_id))
    ways = F.array(*[F.when(c, F.struct(n.alias("id"), F.lit(d).alias("direction"))) for c, n, d in ((F.col("source") == node_id, F.col("target"), "out"), (F.col("target") == node_id, F.col("source"), "in"))])
    rows = e.select("seq", "relation", "confidence", F.explode(F.filter(ways, lambda w: w.isNotNull())).alias("w"))
    lists = lambda d: F.slice(F.array_sort(F.collect_list(F.when(F.col("w.direction") == d, F.struct("seq", "relation", "confidence")))), 1, shown)
    g = rows.groupBy(F.col("w.id").alias("id")).agg(F.count("*").alias("relation_count"), lists("out").alias("outgoing"), lists("in").alias("incoming"))
    # Degrees of the neighbours alone, unless the nodes bring theirs.
    n = nodes if "degree" in nodes.columns else nodes.join(degrees_of(g, edges).select("id", "degree"), "id")
    g = g.join(n.select("id", "label", "type", "description", "degree"), "id", "left")
    return g.orderBy(F.desc("relation_count"), F.desc("degree"), F.lower(F.coalesce("label", "id")), "id").limit(limit)


def indexed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with their search fields and degrees: what a service computes once."""
    return search_index(nodes).join(degrees(nodes, edges), "id")


#: Nodes of a whole graph that one answer may hold; larger graphs are written to files.
FULL_GRAPH_MOST = 20_000
_FIELDS = ("id", "label", "type", "wikidata_qid", "description")


class GraphQueries:
    """The query service over node and edge tables. Results are collected only at its edge.

    nodes: seq, id, label, type, wikidata_qid, description. edges: seq, source, target, relation,
    confidence, sentence, doc, provenance; at most one in each direction between two nodes.
    Edges, and nodes with their search fields and degrees, are written once; close() deletes them.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.tables = Tables(edges.sparkSession)
        self.edges = self.tables.written(edges, "service-edges")
        self.nodes = self.tables.written(indexed(nodes, self.edges), "service-nodes")

    def close(self) -> None:
        self.tables.dropped(self.edges, self.nodes)

    def summary(self) -> dict:
        rows = summary(self.nodes, self.edges).collect()
        totals = {r["name"]: r["n"] for r in rows if r["part"] == "total"}
        return {"num_nodes": totals["nodes"], "num_edges": totals["edges"], "node_types": {r["name"]: r["n"] for r in rows if r["part"] == "type"}, "relation_types": {r["name"]: r["n"] for r in rows if r["part"] == "relation"}}

    def search(self, keyword: str, limit: int = 10) -> list[dict]:
        return [r.asDict() for r in search_nodes(self.nodes, self.edges, keyword, limit).collect()]

    def resolve(self, name: str) -> str:
        found = resolve_node(self.nodes, name).select("id").collect()
        if not found:
            raise KeyError(name)
        return found[0]["id"]

    def details(self, name: str, limit: int = 20) -> dict:
        node_id = self.resolve(name)
        node = self.nodes.where(F.col("id") == node_id).select(*_FIELDS, "in_degree", "out_degree", "degree").first().asDict()
        rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
        return node | {"outgoing": rows(outgoing(self.nodes, self.edges, node_id, limit)), "incoming": rows(incoming(self.nodes, self.edges, node_id, limit)), "neighbors": rows(neighbors(self.nodes, self.edges, node_id, limit))}

    def subgraph(self, name: str, radius: int = 1, max_nodes: int = 80) -> dict:
        node_id = self.resolve(name)
        n, e = ego(self.nodes.select("seq", *_FIELDS), self.edges, self.nodes.where(F.col("id") == node_id), radius, max_nodes)
        return self._payload(n.select("seq", *_FIELDS), e, node_id)

    def full_graph(self, most: int = FULL_GRAPH_MOST) -> dict:
        """The whole graph as one answer; a graph of more than `most` nodes, or ten times as many edges, is refused."""
        if self.nodes.limit(most + 1).count() > most or self.edges.limit(10 * most + 1).count() > 10 * most:
            raise ValueError(f"the graph has more than {most} nodes or {10 * most} edges: write it to a file, or ask for a part")
        return self._payload(self.nodes.select("seq", *_FIELDS), self.edges, None)

    @staticmethod
    def _payload(nodes: DataFrame, edges: DataFrame, center: str | None) -> dict:
        """Degrees in a payload are those inside it."""
        edges = edges.cache()
        n = with_degrees(nodes, edges).orderBy("seq").drop("seq", "in_degree", "out_degree")
        out = {"nodes": [r.asDict() | {"is_center": r["id"] == center} for r in n.collect()], "edges": [r.asDict() for r in edges.orderBy("seq").drop("seq").collect()]}
        edges.unpersist()
        return out | {"center": center, "num_nodes": len(out["nodes"]), "num_edges": len(out["edges"])}

    def query(self, keyword: str, limit: int = 10, radius: int = 1) -> dict:
        """Search; then details and subgraph of the best match, or empty ones."""
        matches = self.search(keyword, limit)
        if not matches:
            return {"keyword": keyword, "matches": [], "primary": None, "subgraph": {"nodes": [], "edges": [], "center": None, "num_nodes": 0, "num_edges": 0}}
        best = matches[0]["id"]
        return {"keyword": keyword, "matches": matches, "primary": self.details(best), "subgraph": self.subgraph(best, radius)}
