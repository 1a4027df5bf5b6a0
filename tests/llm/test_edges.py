"""Queries and the pipeline as they are registered, over tables of odd rows and over empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm.queries import QUERIES

OPS = sorted(q for q in QUERIES if q.startswith("op"))


def write(spark, folder, odd):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice(["ka", "mo", "ri", "th", "er"]) for _ in range(rnd.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    copy = text(60)
    rows = [(k, text(rnd.randint(1, 80)), "en", "abc"[k % 3], 1) for k in range(40)]
    rows += [(100, copy, "en", "a", 1)] * 3  # repeated rows
    rows += [(101, copy, "de", None, None), (102, copy + " x", None, "b", 2)]  # ties and near copies
    rows += [(103, None, "en", "a", 0), (104, "", "en", "a", 0), (105, "   \n", "en", "a", 4)]
    rows += [(None, copy, "en", "a", 1), (None, copy, "en", "a", 1), (None, None, None, None, None)]
    rows += [(106, text(120_000), "en", "b", 1), (107, "x" * 300_000, "en", "c", 1), (106, "another text of the same id", "en", "b", 1)]
    labels = [(k, int(k % 2), 0) for k in range(0, 40)] + [(None, 1, 0), (100, 1, 0), (100, 1, 0)]
    pages = [(k, f"https://{'shop' if k % 2 else 'x'}{k}.{'com' if k % 2 else 'net'}/{'a' if k % 2 else 'fr/'}", "<p>x</p>") for k in range(30)] + [(None, None, None), (3, "", ""), (31, "https://q.org/" + "y" * 50_000, "")]
    vectors = [(k, [rnd.gauss(0, 1) for _ in range(8)]) for k in range(120)] + [(None, [1.0] * 8), (50, None), (121, [0.0] * 8), (122, []), (7, [1.0, None] * 4)]
    if not odd:
        rows, labels, pages, vectors = [], [], [], []
    extra = {"n": F.lit("x"), "start": F.lit(1), "token": F.lit(2), "size": F.lit(3), "node": F.lit(4), "score": F.lit(5.0), "range": F.lit(6), "hash": F.lit(7)}
    for name, data, schema in (
        ("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("pages", pages, "page_id long, url string, html string"),
        ("embeddings", vectors, "vec_id long, embedding array<float>"),
    ):
        df = spark.createDataFrame(data, schema)
        df.withColumns({k: v for k, v in extra.items() if k not in df.columns}).repartition(3).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return f"{folder}"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write(spark, f"file://{tmp_path_factory.mktemp('odd')}", True)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, f"file://{tmp_path_factory.mktemp('empty')}", False)


@pytest.mark.parametrize("name", OPS)
def test_odd_rows_give_their_rows(spark, odd, name):
    got = QUERIES[name](spark, odd).toPandas()
    of = {"op5_url_filter": "pages", "op6_vector_search": "embeddings"}.get(name, "documents")
    there = spark.read.parquet(f"{odd}/{of}.parquet")
    if name == "op6_vector_search":
        assert sorted(got["query_id"].unique()) == [0, 50, 100] and len(got) == 15 and got["score"].notna().all()
    elif name == "op3_packing":
        whole = got.drop_duplicates(["doc_id", "doc_tokens", "start", "sequence_id", "offset"])
        assert len(whole) == len(got) and set(got["doc_id"].dropna()) == {r["doc_id"] for r in there.select("doc_id").distinct().collect() if r["doc_id"] is not None}
        fills = got.groupby("sequence_id").apply(lambda g: (g.sort_values("offset")["offset"].tolist() == (g.sort_values("offset")["length"].cumsum() - g.sort_values("offset")["length"]).tolist(), g["length"].sum()), include_groups=False)
        assert all(ok and (n == 1024 or n & (n - 1) == 0) for ok, n in fills)
    else:
        key = "page_id" if of == "pages" else "doc_id"
        count = lambda ids: sorted((-1 if x is None or x != x else int(x)) for x in ids)
        assert count(got[key]) == count(r[key] for r in there.select(key).collect())
        assert len({tuple(map(str, r)) for r in got[got[key] == 100].itertuples(index=False)}) == 1 or name in ("op1_token_orc", "op4_fingerprints", "op8_mixing")


@pytest.mark.parametrize("name", OPS)
def test_empty_tables_give_no_row(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_pipeline_of_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    near = corpus_pipeline.near_duplicates(spark, docs, odd)
    got = [(r["doc_id"], r["text"]) for r in near.collect()]
    ids = [d for d, _ in got if d is not None]
    assert len(ids) == len(set(ids)) and 100 in ids and 101 not in ids and 102 not in ids  # repeated rows, copies and near copies
    assert {103, 104, 105, 106, 107} <= set(ids) and [d for d, _ in got].count(None) == 3
    kept = corpus_pipeline.quality(spark, docs, odd)
    assert tuple(kept.columns) == corpus_pipeline.COLUMNS and 0 < kept.count() <= docs.count()
    assert corpus_pipeline.secrets(spark, docs, odd).count() == docs.count()
    mixed = corpus_pipeline.mixing(spark, docs, odd)
    assert tuple(mixed.columns) == corpus_pipeline.COLUMNS and mixed.count() > 0
    assert corpus_pipeline.run(spark, odd).count() > 0


def test_pipeline_of_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
