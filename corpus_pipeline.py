"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before it kept, and
returns documents again; the last returns the pieces of packed sequences. run() writes each stage's
result to the shared folder and reads it back, so a lost executor costs one stage at most.

Every stage but the last returns the columns of documents: doc_id, text, lang, source, n_chars.
Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import table, written
from skein.llm.mixing import mix, n_words, quality_weight
from skein.llm.ngram_join import join_components, without
from skein.llm.packing import pack
from skein.llm.quality import THRESHOLD, fit_on_labels, scored
from skein.llm.secret_scan import scan

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MASK = "<secret>"
#: Near-duplicates: words of a shingle, and the percentage that two sets share of their union.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = fit_on_labels(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored(docs.select(*COLUMNS), model, *COLUMNS[1:]).where(F.col("score") >= THRESHOLD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id stays; rows without id stay.

    Rows of one id are one document: of several, the one whose text has the least hash stays.
    """
    found = join_components(docs, NEAR_WIDTH, NEAR_PERCENT)
    ids = found.groupBy("doc_id").agg((F.min("component_id") != F.col("doc_id")).alias("gone"), F.count("*").alias("rows")).where(F.col("doc_id").isNotNull())
    gone = ids.where("gone").select("doc_id")
    kept = without(docs.select(*COLUMNS), gone)
    repeated = ids.where(~F.col("gone") & (F.col("rows") > 1)).select("doc_id")
    if not repeated.limit(1).count():
        return kept
    several = kept.join(repeated, "doc_id", "left_semi")
    one = several.groupBy("doc_id").agg(F.min_by(F.struct(*COLUMNS), F.struct(F.xxhash64("text"), "text", "source", "lang", "n_chars")).alias("one"))
    return kept.join(repeated, "doc_id", "left_anti").unionByName(one.select("one.*"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return scan(docs, mask=MASK, keep=("lang", "source")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, whole: repeats give equal rows."""
    sized = docs.select(*COLUMNS, n_words(F.col("text")).alias("size"))
    weight = quality_weight(F.length("text").cast("long"), F.col("size"))
    mixed = mix(sized, weight, whole_documents=True, keep=["text", "lang", "n_chars"])
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.col("epochs")).cast("int")
    return mixed.withColumn("_times", times).where("_times > 0").withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: The stages run trained models, tokenizers and iterations, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
