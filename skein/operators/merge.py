"""Predicates, the merge of triple sources, aliases, and counts over the result."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skein.config import SOURCE_PRIORITY
from skein.functions.text import apply_aliases, match_norm, readable, strip, underscored


def literal_map(mapping: DataFrame) -> DataFrame:
    """literal and mapped: each key, each relation, and each relation with spaces; later entries win."""
    rows = mapping.select("map_seq", F.posexplode(F.array(F.lower("key"), F.lower("mapped"), F.replace(F.lower("mapped"), F.lit("_"), F.lit(" ")))).alias("form", "literal"), "mapped")
    return rows.groupBy("literal").agg(F.max_by("mapped", F.struct("map_seq", "form")).alias("mapped"))


def map_predicates(t: DataFrame, mapping: DataFrame, nearest: DataFrame | None = None) -> DataFrame:
    """relation by literal match, else by the nearest label where given (predicate, label), else as it is."""
    out = t.join(literal_map(mapping).withColumnRenamed("mapped", "_literal"), F.lower(strip(F.col("relation"))) == F.col("literal"), "left")
    if nearest is not None:
        out = out.join(nearest.select(F.col("predicate").alias("_p"), F.col("label").alias("_near")), F.col("relation") == F.col("_p"), "left")
    else:
        out = out.withColumn("_near", F.lit(None).cast("string"))
    how = F.when(F.col("_literal").isNotNull(), "literal").when(F.col("_near").isNotNull(), "embedding").otherwise("unmapped")
    return out.withColumns({"mapped_by": how, "raw_relation": F.col("relation"), "relation": F.coalesce("_literal", "_near", "relation")}).drop("literal", "_literal", "_near", "_p")


#: Labels that predicates are compared with at once.
LABEL_BLOCK = 4096


def nearest_labels(predicates: DataFrame, labels: DataFrame, accept: float = 0.65, unsure: float = 0.55) -> DataFrame:
    """predicate, best_match, similarity, verdict (accepted, ambiguous, unmapped) by cosine of vectors.

    labels (label, vector) are the relation names, a stated set that each predicate meets: blocks of
    LABEL_BLOCK of them are sent to the tasks, which multiply matrices. One block is the usual case;
    several pass over the predicates' vectors once each, and the best of all stays. Ties go to the
    least label. Predicates or labels of null or zero vectors match nothing.
    """
    spark = predicates.sparkSession
    kind = labels.schema["label"].dataType
    fields = f"predicate {predicates.schema['predicate'].dataType.simpleString()}, best_match {kind.simpleString()}, similarity double"
    order = labels.select("label", F.col("vector").cast("array<double>").alias("vector")).orderBy("label")
    found, at = None, 0
    while True:
        block = order.offset(at).limit(LABEL_BLOCK).collect()
        names, matrix = unit_rows([(r["label"], r["vector"]) for r in block])
        shared = spark.sparkContext.broadcast((names, matrix))  # at most LABEL_BLOCK rows

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            for b in batches:
                ids, vectors = unit_rows(list(enumerate(b.column(1).to_pylist())))
                if len(ids) and len(names) and matrix.shape[1] == vectors.shape[1]:
                    scores = np.round(vectors @ matrix.T, 12)
                    best = scores.argmax(1)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array([names[k] for k in best], to_arrow_type(kind)), pa.array(scores[np.arange(len(ids)), best])], ["predicate", "best_match", "similarity"])

        got = predicates.select("predicate", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, fields)
        found = got if found is None else found.union(got)
        at += len(block)
        if len(block) < LABEL_BLOCK:
            break
    if at > LABEL_BLOCK:
        found = found.groupBy("predicate").agg(F.min_by(F.struct("best_match", "similarity"), F.struct(-F.col("similarity"), F.col("best_match"))).alias("b")).select("predicate", "b.best_match", "b.similarity")
    verdict = F.when(F.col("similarity") >= accept, "accepted").when(F.col("similarity") >= unsure, "ambiguous").otherwise("unmapped")
    return found.withColumn("verdict", verdict)


def unit_rows(rows: list[tuple]) -> tuple[list, np.ndarray]:
    """Keys and unit vectors of the rows that have one, of the most usual length."""
    rows = [(k, v) for k, v in rows if v and None not in v and any(v)]
    dims = max({len(v) for _, v in rows}, key=lambda n: sum(len(v) == n for _, v in rows), default=0)
    rows = [(k, v) for k, v in rows if len(v) == dims]
    m = np.array([v for _, v in rows], float).reshape(len(rows), dims)
    return [k for k, _ in rows], m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


#: An encoder turns texts into vectors.
Encoder = Callable[[list[str]], list[list[float]]]


def encode(df: DataFrame, text: str, factory: Callable[[], Encoder], to: str = "vector") -> DataFrame:
    """text and its vector, of each distinct text; the factory is called once a task, so a model is loaded there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            texts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model(texts), pa.list_(pa.float64()))], [text, to])

    return df.select(text).where(F.col(text).isNotNull()).distinct().mapInArrow(run, f"{text} string, {to} array<double>")


def char_encoder(dims: int = 64, n: int = 3) -> Callable[[], Encoder]:
    """The default encoder: char_vector in Python."""

    def make() -> Encoder:
        def one(t: str) -> list[float]:
            padded, out = f" {t.lower()} ", [0.0] * dims
            for i in range(max(1, len(padded) - n + 1)):
                out[zlib.crc32(padded[i : i + n].encode()) % dims] += 1.0
            return out

        return lambda texts: [one(t) for t in texts]

    return make


def target_labels(mapping: DataFrame) -> DataFrame:
    """The distinct relations that a mapping leads to, and their readable forms, in order of code points."""
    return mapping.select(F.col("mapped").alias("label")).distinct().orderBy("label").select("label", readable(F.col("label")).alias("readable"))


def unmapped_predicates(t: DataFrame, mapping: DataFrame) -> DataFrame:
    """The distinct relations, as they stand, that no literal matches, in order of code points."""
    left = t.select(F.col("relation").alias("predicate")).distinct().withColumn("_form", F.lower(strip(F.col("predicate"))))
    return left.join(literal_map(mapping).select(F.col("literal").alias("_form")), "_form", "left_anti").select("predicate").orderBy("predicate")


def map_relations(t: DataFrame, mapping: DataFrame, factory: Callable[[], Encoder] | None = None, accept: float = 0.65, unsure: float = 0.55) -> tuple[DataFrame, DataFrame]:
    """map_predicates with the nearest labels of an encoder; and the ambiguous predicates.

    Predicates that no literal matches are compared, as are the targets' readable forms; an accepted
    match counts in its underscored form, an ambiguous one is reported and its relation stays.
    """
    factory = factory or char_encoder()
    predicates = encode(unmapped_predicates(t, mapping), "predicate", factory)
    labels = encode(target_labels(mapping), "readable", factory).withColumnRenamed("readable", "label")
    near = nearest_labels(predicates, labels, accept, unsure).withColumn("best_match", underscored(F.col("best_match")))
    accepted = near.where("verdict = 'accepted'").select("predicate", F.col("best_match").alias("label"))
    return map_predicates(t, mapping, accepted), near.where("verdict = 'ambiguous'").drop("verdict")


def char_vector(c: Column, dims: int = 64, n: int = 3) -> Column:
    """A default encoder: counts of hashed character n-grams, as an array of doubles."""
    padded = F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1))), lambda i: F.pmod(F.crc32(F.substring(padded, i, F.lit(n)).cast("binary")), F.lit(dims)))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(grams, lambda g: g == d)).cast("double"))


def merge_key(t: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    return t.withColumns({"_kh": match_norm(apply_aliases(F.col("head"), aliases)), "_kr": F.lower(strip(F.col("relation"))), "_kt": match_norm(apply_aliases(F.col("tail"), aliases))})


def _rank(seq: str, priority: dict[str, int] | None) -> Column:
    """What the row to keep has least of."""
    ranks = SOURCE_PRIORITY if priority is None else priority
    pri = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col("provenance")), F.lit(0))
    return F.struct((-pri).alias("p"), (-F.col("confidence")).alias("c"), F.col(seq).alias("s"))


def merged_relations(t: DataFrame, seq: str = "seq", priority: dict[str, int] | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """seq and relation of merge_triples, whose other columns needn't move."""
    t = merge_key(t, aliases).select("_kh", "_kr", "_kt", "relation", F.col(seq).alias("_s"), _rank(seq, priority).alias("_rank"))
    return t.groupBy("_kh", "_kr", "_kt").agg(F.min("_s").alias("seq"), F.min_by("relation", "_rank").alias("relation")).select("seq", "relation")


def merge_triples(t: DataFrame, seq: str = "seq", priority: dict[str, int] | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """One triple for each key: the source of highest priority, then confidence, then arrival, keeps its row.

    provenance joins the distinct sources, and doc_ids lists the first document (blank or not) and
    then the distinct others, in order of arrival. Rows are aggregated twice: to the best one of each
    key, source and document, and those to one of each key; they move once, by key, as few of them
    share source and document. seq: order of arrival.
    """
    row = F.struct("head", "head_qid", "relation", "tail", "tail_qid", "confidence", "sentence")
    t = t.withColumn("doc", F.coalesce("doc", F.lit(""))).select(seq, "head", "head_qid", "relation", "tail", "tail_qid", "confidence", "sentence", "doc", "provenance")
    keys = ["_kh", "_kr", "_kt"]
    t = merge_key(t, aliases).repartition(*keys).withColumn("_rank", _rank(seq, priority))
    part = t.groupBy(*keys, "provenance", "doc").agg(F.min_by(row, "_rank").alias("_row"), F.min("_rank").alias("_rank"), F.min(seq).alias("_s"))
    out = part.groupBy(*keys).agg(F.min_by("_row", "_rank").alias("r"), F.min("_s").alias("seq"), F.array_sort(F.collect_list(F.struct("_s", "provenance", "doc"))).alias("_of"))
    docs = F.transform("_of", lambda x: x["doc"])
    docs = F.concat(F.slice(docs, 1, 1), F.filter(F.array_distinct(docs), lambda d: (d != "") & (d != F.element_at(F.col("_of"), 1)["doc"])))
    provenance = F.concat_ws(",", F.array_distinct(F.transform("_of", lambda x: x["provenance"])))
    return out.select("seq", "r.head", "r.head_qid", "r.relation", "r.tail", "r.tail_qid", "r.confidence", provenance.alias("provenance"), docs.alias("doc_ids"), "r.sentence")


def provenance_counts(merged: DataFrame) -> DataFrame:
    return merged.select(F.explode(F.split("provenance", ",")).alias("source")).groupBy("source").agg(F.count("*").alias("n"))


def in_order(*sources: DataFrame, seq: str = "seq") -> DataFrame:
    """The union of triple sources, with seq as their order: the source's number, then its own seq.

    Sources' own seqs may be of any type that sorts, as long as it is the same; else their text counts.
    """
    kinds = {s.schema[seq].dataType.simpleString() for s in sources}
    own = F.col(seq) if len(kinds) == 1 else F.to_json(F.struct(seq))
    parts = [s.withColumn(seq, F.struct(F.lit(k).alias("source"), own.alias("at"))) for k, s in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def top_counts(t: DataFrame, column: str, most: int, seq: str = "seq", blank: str | None = None) -> DataFrame:
    """The `most` most frequent values and their counts; ties by first arrival."""
    c = F.col(column) if blank is None else F.when(F.coalesce(F.col(column), F.lit("")) == "", F.lit(blank)).otherwise(F.col(column))
    return t.groupBy(c.alias(column)).agg(F.count("*").alias("n"), F.min(seq).alias("first_seq")).orderBy(F.desc("n"), "first_seq").limit(most)


def mapping_counts(mapped: DataFrame) -> DataFrame:
    return mapped.agg(*[F.count_if(F.col("mapped_by") == k).alias(k) for k in ("literal", "embedding", "unmapped")])


def label_counts(silver: DataFrame) -> DataFrame:
    return silver.agg(F.count_if(F.col("relation") != "none").alias("positive"), F.count_if(F.col("relation") == "none").alias("negative"))


def rewrite_aliases(t: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """head and tail by canonical names, and how many of the two changed."""
    h, a = apply_aliases(F.col("head"), aliases), apply_aliases(F.col("tail"), aliases)
    changed = lambda old, new: (F.coalesce(old, F.lit("")) != new).cast("int")
    return t.withColumns({"head": h, "tail": a, "changes": changed(F.col("head"), h) + changed(F.col("tail"), a)})


def qc_sample(t: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """n rows in the order of a hash of their names and the seed, then of their columns: reruns agree."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "head", "relation", "tail").cast("binary"))
    return t.withColumn("_h", key).orderBy("_h", *t.columns).limit(n).drop("_h")


def qc_rows(t: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """The sample for manual checks: eight columns, blank where the triples have none."""
    have = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in t.columns else F.lit("").alias(c)
    return qc_sample(t, n, seed).select(*map(have, ("head", "tail", "relation", "mapped_relation", "head_mention", "tail_mention", "sentence", "doc")))
