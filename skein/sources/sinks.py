"""Writers. Tables are written by Spark; the single-file graph formats stream rows through the driver."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import file_name_of_title

NODE_FIELDS = ("label", "type", "wikidata_qid", "description")
EDGE_FIELDS = ("relation", "confidence", "sentence", "doc", "provenance")


def write_jsonl(df: DataFrame, path: str, gzip: bool = False) -> None:
    """Lines of JSON; Spark's commit publishes all files or none."""
    df.write.mode("overwrite").option("compression", "gzip" if gzip else "none").option("ignoreNullFields", "false").json(path)


def write_documents(df: DataFrame, path: str) -> None:
    """Processed documents as a table."""
    df.write.mode("overwrite").parquet(path)


def write_each(df: DataFrame, folder: str | Path, name: str = "title") -> int:
    """One JSON file for each row, named after its title; returns their number.

    For handing documents to other programs: rows come to the driver one partition at a time.
    write_documents() is the table that later stages read.
    """
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    n = 0
    rows = df.select(file_name_of_title(F.col(name)).alias("_file"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("_json"))
    for r in rows.toLocalIterator(prefetchPartitions=True):
        _publish(folder / f"{r['_file']}.json", [json.dumps(json.loads(r["_json"]), ensure_ascii=False, indent=2)])
        n += 1
    return n


def keep_backup(path: str | Path) -> Path:
    """Rename a file to .bak before it is written anew, once: an older backup stays, and so does the file.

    Returns the path that holds what was there.
    """
    path = Path(path)
    backup = path.with_name(path.name + ".bak")
    if path.exists() and not backup.exists():
        os.replace(path, backup)
        return backup
    return path


def write_text(text: str, path: str | Path) -> None:
    """A picture (SVG) or page (HTML) as a file."""
    _publish(path, [text])


def fill_blanks(df: DataFrame) -> DataFrame:
    return df.na.fill("")


def _publish(path: str | Path, lines) -> None:
    """Write beside the target, then replace it."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, part = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.writelines(lines)
    os.replace(part, path)


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """{nodes, edges, stats}, row by row."""

    def lines():
        n = m = 0
        yield '{"nodes": ['
        for r in fill_blanks(nodes.orderBy("seq").select("id", *NODE_FIELDS)).toLocalIterator(prefetchPartitions=True):
            yield ("," if n else "") + "\n" + json.dumps(r.asDict(), ensure_ascii=False)
            n += 1
        yield '\n], "edges": ['
        for r in fill_blanks(edges.orderBy("seq").select("source", "target", *EDGE_FIELDS)).toLocalIterator(prefetchPartitions=True):
            yield ("," if m else "") + "\n" + json.dumps(r.asDict(), ensure_ascii=False)
            m += 1
        yield f'\n], "stats": {{"num_nodes": {n}, "num_edges": {m}}}}}\n'

    _publish(path, lines())


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    def lines():
        yield '<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
        for domain, names in (("node", NODE_FIELDS), ("edge", EDGE_FIELDS)):
            for f in names:
                yield f'<key id="{domain}_{f}" for="{domain}" attr.name="{f}" attr.type="{"double" if f == "confidence" else "string"}"/>\n'
        yield '<graph edgedefault="directed">\n'
        for r in fill_blanks(nodes.orderBy("seq").select("id", *NODE_FIELDS)).toLocalIterator():
            yield f"<node id={quoteattr(r['id'])}>" + "".join(f'<data key="node_{f}">{escape(str(r[f]))}</data>' for f in NODE_FIELDS) + "</node>\n"
        for r in fill_blanks(edges.orderBy("seq").select("source", "target", *EDGE_FIELDS)).toLocalIterator():
            yield f"<edge source={quoteattr(r['source'])} target={quoteattr(r['target'])}>" + "".join(f'<data key="edge_{f}">{escape(str(r[f]))}</data>' for f in EDGE_FIELDS) + "</edge>\n"
        yield "</graph>\n</graphml>\n"

    _publish(path, lines())


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    def values(r, names):
        return "<attvalues>" + "".join(f'<attvalue for="{k}" value={quoteattr(str(r[f]))}/>' for k, f in enumerate(names)) + "</attvalues>"

    def lines():
        yield '<?xml version="1.0" encoding="utf-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">\n<graph defaultedgetype="directed" mode="static">\n'
        for cls, names in (("node", NODE_FIELDS), ("edge", EDGE_FIELDS)):
            yield f'<attributes class="{cls}" mode="static">' + "".join(f'<attribute id="{k}" title="{f}" type="{"double" if f == "confidence" else "string"}"/>' for k, f in enumerate(names)) + "</attributes>\n"
        yield "<nodes>\n"
        for r in fill_blanks(nodes.orderBy("seq").select("id", *NODE_FIELDS)).toLocalIterator():
            yield f"<node id={quoteattr(r['id'])} label={quoteattr(r['label'])}>{values(r, NODE_FIELDS)}</node>\n"
        yield "</nodes>\n<edges>\n"
        for k, r in enumerate(fill_blanks(edges.orderBy("seq").select("source", "target", *EDGE_FIELDS)).toLocalIterator()):
            yield f'<edge id="{k}" source={quoteattr(r["source"])} target={quoteattr(r["target"])}>{values(r, EDGE_FIELDS)}</edge>\n'
        yield "</edges>\n</graph>\n</gexf>\n"

    _publish(path, lines())


def graph_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with nodes, edges and stats; for graphs that fit a row, such as a subgraph."""
    order = lambda c: F.array_sort(F.collect_list(c))
    n = nodes.agg(order(F.struct("seq", "id", *NODE_FIELDS)).alias("nodes"))
    e = edges.agg(order(F.struct("seq", "source", "target", *EDGE_FIELDS)).alias("edges"))
    # Two rows of one document, brought together by a key: a graph that fits a row is small.
    parts = n.select(F.lit(0).alias("_k"), "nodes").join(e.select(F.lit(0).alias("_k"), "edges"), "_k")
    return parts.select("nodes", "edges", F.struct(F.size("nodes").alias("num_nodes"), F.size("edges").alias("num_edges")).alias("stats"))
