"""Readers of pages, documents, mentions, triples and graphs. All declare their schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from skein import schemas
from skein.config import RELATION_MAPPING
from skein.functions.text import file_name_of_title, strip, title_of_file_name


def _json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a file; a broken file gives a row with _corrupt_record."""
    df = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return df.withColumn("file", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))))


def read_raw_pages(spark: SparkSession, path: str) -> DataFrame:
    return _json_files(spark, path, schemas.RAW_PAGE)


def read_processed(spark: SparkSession, path: str, max_docs: int | None = None, only: list[str] | None = None) -> DataFrame:
    """Readable documents; at most max_docs by file name, or those of the named files that exist."""
    df = _json_files(spark, path, schemas.PROCESSED)
    if only is not None:
        df = df.where(F.col("file").isin(only))
    if max_docs is not None:
        df = df.orderBy("file").limit(max_docs)
    # Spark wants another column beside the one for broken records; a broken file has no title.
    return df.where(F.col("_corrupt_record").isNull() | F.col("title").isNotNull()).drop("_corrupt_record")


def skipped_files(spark: SparkSession, path: str) -> DataFrame:
    return _json_files(spark, path, schemas.PROCESSED).where(F.col("_corrupt_record").isNotNull() & F.col("title").isNull()).select("file", "_corrupt_record")


def read_jsonl(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """Lines of JSON with seq, the line's place by file and position; blank lines don't count."""
    try:
        df = spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if missing_ok and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], f"{schema}, seq struct<file: string, at: long>")
        raise
    # Within a file, the block start and the row's number in its block follow the order of lines.
    return df.withColumn("seq", F.struct(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") * F.lit(1 << 20) + F.monotonically_increasing_id() % F.lit(1 << 33)).alias("at")))


def read_triples(spark: SparkSession, path: str, missing_ok: bool = True) -> DataFrame:
    return read_jsonl(spark, path, schemas.TRIPLE, missing_ok)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """doc and entities, and seq, its first line's place; of several lines of one doc the last counts."""
    rows = read_jsonl(spark, path, schemas.ENTITIES)
    return rows.groupBy("doc").agg(F.max_by("entities", "seq").alias("entities"), F.min("seq").alias("seq"))


def mention_dictionary(entities: DataFrame, order: str = "seq") -> DataFrame:
    """For each mention the attributes of its first occurrence, by order of arrival and place."""
    m = entities.select(F.col(order).alias("_o"), F.posexplode("entities").alias("_at", "e")).select("_o", "_at", "e.*")
    fields = [c for c in m.columns if c not in ("_o", "_at", "mention")]
    return m.groupBy("mention").agg(F.min_by(F.struct(*fields), F.struct("_o", "_at")).alias("e")).select("mention", "e.*")


def existing_titles(spark: SparkSession, path: str) -> DataFrame:
    """Titles of the documents that an earlier run has left, by their file names; none where there is no folder."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select(F.col("path"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "title string")
        raise
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", "")
    return files.select(title_of_file_name(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).alias("title")).distinct()


def remaining(titles: DataFrame, done: DataFrame) -> DataFrame:
    """Titles that no earlier run has fetched: a title is compared by the name of its file."""
    of = lambda c: title_of_file_name(file_name_of_title(c))
    return titles.withColumn("_t", of(F.col("title"))).join(done.select(of(F.col("title")).alias("_t")).distinct(), "_t", "left_anti").drop("_t")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph document.

    Ids are stripped, blank ones go; ends of edges that no node declares become nodes without
    attributes; of several edges between the same nodes the last stays.
    """
    raw = spark.read.schema(schemas.GRAPH).option("multiLine", True).json(path)
    nodes = raw.select(F.posexplode("nodes").alias("seq", "n")).select("seq", "n.*").withColumn("id", strip(F.col("id"))).where("id != ''")
    edges = raw.select(F.posexplode("edges").alias("seq", "e")).select("seq", "e.*").withColumns({"source": strip(F.col("source")), "target": strip(F.col("target"))}).where("source != '' and target != ''")
    return complete_graph(nodes, edges)


def complete_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Last-wins nodes and edges, and the nodes that only edges name (seq after all declared)."""
    latest = lambda df, *k: df.withColumn("_n", F.row_number().over(Window.partitionBy(*k).orderBy(F.desc("seq")))).where("_n = 1").drop("_n")
    nodes, edges = latest(nodes, "id"), latest(edges, "source", "target")
    ends = edges.select(F.col("source").alias("id"), "seq").union(edges.select("target", "seq")).groupBy("id").agg((F.min("seq") + F.lit(1 << 40)).alias("seq"))
    implied = ends.join(nodes.select("id"), "id", "left_anti")
    return nodes.unionByName(implied, allowMissingColumns=True), edges


def mapping_table(spark: SparkSession, mapping: dict[str, str] | None = None) -> DataFrame:
    """key and relation of the mapping, in order."""
    pairs = RELATION_MAPPING if mapping is None else mapping
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(pairs.items())], "map_seq int, key string, mapped string")
