"""Passes in Python see bounded batches of texts, and give bounded ones back."""

from pyspark.sql import functions as F

from skein.batches import BATCH_BYTES, by_rows
from skein.operators.documents import sentence_spans
from skein.operators.mentions import detect_mentions, sentence_mentions


def weigher():
    def detector(texts):
        texts = list(texts)
        total = sum(map(len, texts))
        return ([(str(total), "UNKNOWN", 0, 1)] for _ in texts)

    return detector


def test_mentions_see_bounded_batches(spark):
    docs = spark.range(0, 400, 1, 1).select("id", F.repeat(F.lit("Abc def. "), 10_000).alias("text"))
    for found in (detect_mentions(docs, "id", "text", weigher), sentence_mentions(docs, "id", "text", weigher)):
        got = found.select(F.col("mention").cast("long").alias("n")).agg(F.max("n"), F.count("*")).first()
        assert got[0] <= 2 * BATCH_BYTES and got[1] == 400


def test_long_texts_give_all_their_rows(spark):
    docs = spark.createDataFrame([(0, "One. " * 300_000), (1, None), (2, ""), (3, "Two! Three")], "id long, text string")
    got = {r["id"]: (r["n"], r["z"]) for r in sentence_spans(docs, "id", "text").groupBy("id").agg(F.count("*").alias("n"), F.max("sent_end").alias("z")).collect()}
    assert got == {0: (300_000, 1_499_999), 3: (2, 10)}


def test_rows_keep_order_and_nulls(spark):
    twice = spark.createDataFrame([("a", 1), (None, 2)], "t string, n int").coalesce(1).transform(by_rows(lambda: lambda c: ((t, n, k) for t, n in zip(*c, strict=True) for k in range(2)), "t string, n int, k int"))
    assert [tuple(r) for r in twice.collect()] == [("a", 1, 0), ("a", 1, 1), (None, 2, 0), (None, 2, 1)]
