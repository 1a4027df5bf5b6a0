"""The property graph: nodes and edges from triples, degrees, neighbourhoods, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import apply_aliases
from skein.session import Tables


def edges_multi(triples: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """One edge for each triple: seq, source, target, relation and what it carries."""
    doc = F.coalesce("doc", F.lit("")) if "doc" in triples.columns else F.lit("")
    return triples.select("seq", apply_aliases(F.col("head"), aliases).alias("source"), apply_aliases(F.col("tail"), aliases).alias("target"), "relation", "confidence", F.coalesce("sentence", F.lit("")).alias("sentence"), doc.alias("doc"), "provenance")


def fold_edges(edges: DataFrame) -> DataFrame:
    """At most one edge between two nodes in a direction.

    In order of seq, another relation replaces the edge, and the same relation replaces confidence,
    sentence and provenance if it is more confident. So the last run of equal relations counts: doc
    comes from its first row, the rest from its most confident row, the earliest of equals.
    """
    pair, whole = Window.partitionBy("source", "target").orderBy("seq"), Window.partitionBy("source", "target")
    e = edges.withColumn("_new", F.when(F.lag("relation").over(pair).eqNullSafe(F.col("relation")) & (F.row_number().over(pair) > 1), 0).otherwise(1))
    # One exchange and one sort serve the windows and the aggregation.
    e = e.withColumn("_run", F.sum("_new").over(pair)).withColumns({"_last": F.max("_run").over(whole), "_seq": F.min("seq").over(whole)}).where("_run = _last")
    best = F.min_by(F.struct("confidence", "sentence", "provenance"), F.struct(-F.col("confidence"), F.col("seq")))
    last = e.groupBy("source", "target").agg(F.first("relation").alias("relation"), F.min_by("doc", "seq").alias("doc"), F.min("_seq").alias("seq"), best.alias("b"))
    return last.select("seq", "source", "target", "relation", "b.confidence", "b.sentence", "doc", "b.provenance")


def pairs(triples: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """seq, source, target: the folded edges_multi without what its edges carry, so counts and paths need no whole rows.

    Aliases are looked up once for each pair of names, not for each triple.
    """
    named = triples.groupBy("head", "tail").agg(F.min("seq").alias("seq"))
    e = named.select("seq", apply_aliases(F.col("head"), aliases).alias("source"), apply_aliases(F.col("tail"), aliases).alias("target"))
    return e.groupBy("source", "target").agg(F.min("seq").alias("seq")).select("seq", "source", "target")


def node_table(edges: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Distinct ends in order of first sight, with the dictionary's attributes.

    seq is that of the edge (of any type that sorts) and which end of it: a head goes before its tail.
    dictionary: mention, type, and optionally wikidata_qid and wikidata_description.
    """
    place = lambda end: F.struct(F.col("seq").alias("edge"), F.lit(end).alias("end")).alias("seq")
    ends = edges.select(F.col("source").alias("id"), place(0)).union(edges.select("target", place(1)))
    n = ends.groupBy("id").agg(F.min("seq").alias("seq"))
    blank = F.lit("")
    if dictionary is None:
        return n.select("seq", "id", F.col("id").alias("label"), F.lit("UNKNOWN").alias("type"), blank.alias("wikidata_qid"), blank.alias("description"))
    have = lambda c: F.coalesce(c, blank) if c in dictionary.columns else blank
    n = n.join(dictionary, n["id"] == dictionary["mention"], "left")
    return n.select("seq", "id", F.col("id").alias("label"), F.coalesce("type", F.lit("UNKNOWN")).alias("type"), have("wikidata_qid").alias("wikidata_qid"), have("wikidata_description").alias("description"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, degree; a loop counts twice, a lone node has 0."""
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("target", F.lit(0), F.lit(1)))
    d = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return nodes.select("id").join(d, "id", "left").select("id", zero("in_degree").alias("in_degree"), zero("out_degree").alias("out_degree"), (zero("in_degree") + zero("out_degree")).alias("degree"))


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(nodes, edges), "id")


def max_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The largest degree, 0 without nodes: what sizes are scaled by."""
    return degrees(nodes, edges).agg(F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"))


def used_types(nodes: DataFrame) -> DataFrame:
    """The types that nodes have, in order of code points."""
    return nodes.select(F.coalesce("type", F.lit("UNKNOWN")).alias("type")).distinct().orderBy("type")


def top_degree(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    return with_degrees(nodes, edges).orderBy(F.desc("degree"), "seq").limit(most).select("id", "degree")


def value_counts(df: DataFrame, column: str, blank: str, most: int | None = None) -> DataFrame:
    """Counts of a column, most frequent first, ties by first sight; blanks are named."""
    v = F.when(F.coalesce(F.col(column), F.lit("")) == "", F.lit(blank)).otherwise(F.col(column))
    c = df.groupBy(v.alias(column)).agg(F.count("*").alias("n"), F.min("seq").alias("_s"))
    return (c.orderBy(F.desc("n"), "_s").limit(most) if most else c).drop("_s")


def summary(nodes: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """Rows of (part, name, n): the numbers of nodes and edges, and the leading types and relations."""
    total = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit("total").alias("part"), F.lit(name).alias("name"), "n")
    kinds = value_counts(nodes, "type", "UNKNOWN", most).select(F.lit("type").alias("part"), F.col("type").alias("name"), "n")
    relations = value_counts(edges, "relation", "unknown", most).select(F.lit("relation").alias("part"), F.col("relation").alias("name"), "n")
    return total(nodes, "nodes").union(total(edges, "edges")).union(kinds).union(relations)


def undirected(edges: DataFrame) -> DataFrame:
    """u, v: each edge both ways, once, without loops."""
    e = edges.where(F.col("source") != F.col("target"))
    return e.select(F.col("source").alias("u"), F.col("target").alias("v")).union(e.select("target", "source")).distinct()


def hops(edges: DataFrame, centers: DataFrame, radius: int, tables: Tables | None = None, saved: bool = False) -> DataFrame:
    """id and distance of every node at most `radius` steps, of either direction, from a centre (id).

    A level at a time: the frontier meets both ends of the edges in joins, and what was seen before
    goes. The number of joins follows the radius, whatever the graph's size. Levels are written, and so
    are the edges unless they are `saved`, so no level computes the graph again.
    """
    own = tables or Tables(edges.sparkSession)
    links = edges.select("source", "target")
    links = links if saved else own.written(links, "links")
    seen = frontier = own.written(centers.select("id").distinct().withColumn("distance", F.lit(0)), "hops")
    for k in range(1, radius + 1):
        near = [links.join(frontier.select(F.col("id").alias(a)), a, "left_semi").select(F.col(b).alias("id")) for a, b in (("source", "target"), ("target", "source"))]
        frontier = own.written(near[0].union(near[1]).distinct().join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(k)), "hops")
        seen = seen.union(frontier)
    if not saved:
        own.dropped(links)
    return seen


def ego(nodes: DataFrame, edges: DataFrame, centers: DataFrame, radius: int = 1, max_nodes: int = 80, triples: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (with distance) and induced edges around a centre, of at most max_nodes nodes.

    Nearer nodes stay first, then those of higher degree in the whole graph, then by label and id.
    Degrees are counted for reached nodes alone. With triples (as edges_multi gives them), edges are
    their pairs, as a saved table, and the induced edges alone are folded.
    """
    tables, saved = Tables(edges.sparkSession), triples is not None
    edges = edges if saved else tables.written(edges, "ego-edges")
    reached = nodes.join(hops(edges, centers, radius, tables, saved=True), "id")
    n = reached.join(degrees_of(reached, edges), "id")
    n = tables.written(n.orderBy("distance", F.desc("degree"), F.lower("label"), "id").limit(max_nodes), "ego-nodes")
    e = tables.written(fold_edges(induced(triples, n)) if saved else induced(edges, n), "ego-induced")
    if not saved:
        tables.dropped(edges)
    return n, e


def degrees_of(chosen: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees of the chosen ids; other ends are dropped before they are counted."""
    ids = chosen.select("id").distinct()
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("o")).union(edges.select("target", F.lit(0)))
    d = ends.join(ids, "id", "left_semi").groupBy("id").agg(F.sum("o").alias("_out"), F.count("*").alias("_all"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return ids.join(d, "id", "left").select("id", (zero("_all") - zero("_out")).alias("in_degree"), zero("_out").alias("out_degree"), zero("_all").alias("degree"))


def induced(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends among the chosen ids."""
    ids = chosen.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component, the least id of its weakly connected component.

    Each round takes the least label among neighbours and then the label's own label, so a chain
    shortens by halves; a round's result is written, and the loop ends when nothing changes.
    """
    tables = Tables(edges.sparkSession)
    links = tables.written(undirected(edges), "links")
    labels = tables.written(nodes.select("id", F.col("id").alias("component"), F.lit(True).alias("moved")), "labels")
    while labels.where("moved").limit(1).count():
        near = links.join(labels.select(F.col("id").alias("v"), "component"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("further"))
        step = step.join(jump, "component", "left").select("id", F.least("component", "further").alias("component"), "before")
        last, labels = labels, tables.written(step.select("id", "component", (F.col("component") != F.col("before")).alias("moved")), "labels")
        tables.dropped(last)
    tables.dropped(links)
    return labels.select("id", "component")


def select_by(nodes: DataFrame, column: str, values: list) -> DataFrame:
    return nodes.where(F.col(column).isin(values))


def ends_of(edges: DataFrame, column: str, values: list) -> DataFrame:
    """Both ends of the edges whose property is among the values."""
    return edges.where(F.col(column).isin(values)).select(F.explode(F.array("source", "target")).alias("id")).distinct()


def highlight(edges: DataFrame, chosen: DataFrame, saved: bool = False) -> DataFrame:
    """id and class: selected, first or second neighbours."""
    named: Column = F.element_at(F.array(F.lit("selected"), F.lit("first"), F.lit("second")), F.col("distance") + 1)
    return hops(edges, chosen, 2, saved=saved).select("id", named.alias("class"))
