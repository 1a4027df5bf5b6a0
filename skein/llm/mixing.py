"""Mixing sources to target weights with Efraimidis-Spirakis keys.

Targets: sources, ordered by code point with null last, weigh 1, 2, 3, repeating; they share the
size of the whole corpus by weight, but none exceeds `max_epochs` times its own size, and what is
cut off is shared again by weight until none is above. That has a closed form: order the sources by
max_epochs * size / weight; the first k stop at their limit, for the least k at which the level
shared by the others lies below all their limits. Those windows have a row for each source.

Selection: a source whose target holds e whole epochs takes every document e times; what remains of
its target goes to a weighted sample without replacement. A document's key is -ln(u) / weight, with
u in (0, 1) from the md5 of its id and the seed: the smallest keys go first. Sorting a source that
holds a third of all rows in one task is avoided: exp(-key) is cut into `bins` equal bins of the
source, the bins' sizes are summed first (a row for each source, bin and task) and prefix-summed,
so whole bins below the budget are in, those above it are out, and only the documents of the bin
that holds the boundary are sorted.

The document at the boundary is taken up to the budget; with whole_documents it is taken whole if
that brings the source nearer to its target, else not at all.

Everything is DataFrame functions; keys depend on ids and the seed alone, so reruns agree.

Defined cases: a null or empty text has size 0 and is taken as 0 words. Null sources are one source.
Null ids take the key of the text "null". Repeated rows with the same id have the same key and are
ordered by size; equal rows are told apart by no column, so any of them may be the one that is cut.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import WORD, table, written

BINS = 4096
_U_STEPS = 1 << 52


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(n_chars: Column, size: Column) -> Column:
    """Weight 0.5 to 1 from the mean room a word takes: about 6 characters are usual for prose."""
    room = F.coalesce(n_chars, F.lit(0)) / F.greatest(size, F.lit(1))
    return F.lit(0.5) + F.lit(0.5) / (F.lit(1.0) + F.abs(room - F.lit(6.0)))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 13 hex digits of md5(seed:id)."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(_U_STEPS))


def source_targets(sized: DataFrame, max_epochs: float = 3.0, cycle: int = 3) -> DataFrame:
    """source, source_size, target; a row for each source. sized: source and size."""
    everything = Window.partitionBy()
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("_w", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % cycle + 1)
    s = s.withColumn("_cap", F.lit(max_epochs) * F.col("source_size")).withColumn("_total", F.sum("source_size").over(everything))
    order = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_w_left", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(upto), F.lit(0)))
    s = s.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))) / F.col("_w_left"))
    fits = F.col("_level") * F.col("_w") <= F.col("_cap")
    s = s.withColumn("_shared", F.max(F.when(fits, F.col("_level"))).over(everything))
    first = F.min(F.when(fits, F.col("_cap") / F.col("_w"))).over(everything)
    below = F.col("_shared").isNull() | (F.col("_cap") / F.col("_w") < first)
    s = s.withColumn("target", F.when(below, F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_shared") * F.col("_w"))).cast("double"))
    return s.select("source", "source_size", "target")


def mix(
    docs: DataFrame,
    weight: Column,
    seed: int = 17,
    max_epochs: float = 3.0,
    cycle: int = 3,
    bins: int = BINS,
    whole_documents: bool = False,
    keep: list[str] | None = None,
) -> DataFrame:
    """docs has doc_id, source and size; the result adds source_size, target, epochs, taken.

    keep: further columns to carry along.
    """
    keep = keep or []
    key = -F.ln(uniform(F.col("doc_id"), seed)) / weight
    d = docs.withColumn("_key", key).withColumn("_bin", F.least(F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * bins), F.lit(bins - 1)).cast("int"))
    d = d.select("doc_id", "source", "size", "_key", "_bin", *keep)
    sums = written(d.groupBy("source", "_bin").agg(F.sum("size").alias("size")), "mix-bins")  # at most `bins` rows a source
    t = source_targets(sums, max_epochs, cycle)
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    t = t.withColumn("_budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    before = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    b = sums.withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    b = b.join(t.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    crosses = (F.col("_before") <= F.col("_budget")) & (F.col("_before") + F.col("size") > F.col("_budget"))  # in one bin at most
    limits = b.groupBy(F.col("source").alias("_s"), "source_size", "target", "epochs", "_budget").agg(F.max(F.when(crosses, F.struct("_bin", "_before"))).alias("_at"))
    limits = written(limits.select("*", F.col("_at._bin").alias("_edge_bin"), F.col("_at._before").alias("_before")).drop("_at"), "mix-limits")  # a row each source: Spark sees its size and sends it to the rows
    d = d.join(limits, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_edge", F.coalesce(F.col("_bin") == F.col("_edge_bin"), F.lit(False)))
    full = d.where(~F.col("_edge")).withColumn("_part", F.when(F.col("_edge_bin").isNull() | (F.col("_bin") < F.col("_edge_bin")), F.col("size")).otherwise(F.lit(0)))
    in_bin = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_budget") - F.col("_before") - F.coalesce(F.sum("size").over(in_bin), F.lit(0))
    edge = d.where("_edge").withColumn("_left", left)
    if whole_documents:
        part = F.when((F.col("_left") > 0) & (F.col("_left") * 2 >= F.col("size")), F.col("size")).otherwise(F.lit(0))
    else:
        part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left")))
    out = full.unionByName(edge.withColumn("_part", part).drop("_left"))
    return out.withColumn("taken", (F.col("epochs") * F.col("size") + F.col("_part")).cast("long")).select("doc_id", "source", "size", "source_size", "target", "epochs", "taken", *keep)


def sized_documents(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, size and n_chars of whole texts."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.length("text").cast("long").alias("_chars"), *keep)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = written(sized_documents(table(spark, sf_dir, "documents")), "mix-sizes")
    return mix(sized, quality_weight(F.col("_chars"), F.col("size"))).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, length(text) AS chars
  FROM documents),
k AS (
  SELECT *, -ln((CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / {_U_STEPS}::DOUBLE)
    / (0.5::DOUBLE + 0.5::DOUBLE / (1.0::DOUBLE + abs(coalesce(chars, 0)::DOUBLE / greatest(size, 1) - 6.0::DOUBLE))) AS key
  FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w, 3.0::DOUBLE * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER o, 0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / w ASC, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN shared IS NULL OR cap / w < first THEN cap ELSE least(cap, shared * w) END AS target
  FROM (SELECT *, max(CASE WHEN level * w <= cap THEN level END) OVER () AS shared, min(CASE WHEN level * w <= cap THEN cap / w END) OVER () AS first FROM l)),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
g AS (SELECT *, CAST(round(target - epochs * source_size) AS BIGINT) AS budget FROM e),
p AS (
  SELECT k.*, coalesce(CAST(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before FROM k)
SELECT p.doc_id, p.size, g.source_size, g.target,
  CAST(g.epochs * p.size + greatest(0, least(p.size, g.budget - p.before)) AS BIGINT) AS taken
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
"""
