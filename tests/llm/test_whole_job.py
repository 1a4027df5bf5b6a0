"""Each operator does the whole job: cases that a shortened form gets wrong."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import attention, common, lm_scoring, mixing, ngram_join, secret_scan, subwords


def linked_sets(texts, width, percent):
    """The smallest id of each document's component, by all pairs."""
    sets = {d: frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) for d, t in texts for w in [t.split()]}
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                label[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in sets}


def copies(seed):
    rnd = random.Random(seed)
    base = [[f"w{rnd.randint(0, 400)}" for _ in range(n)] for n in (3, 8, 30, 60, 100, 150)]
    texts = []
    for k in range(100):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 10**6)}"
        texts.append((100 + k, " ".join(w)))
    return texts


@pytest.mark.parametrize("long", [48, 2])
def test_near_duplicates_take_five_words_and_four_fifths(spark, monkeypatch, long):
    monkeypatch.setattr(ngram_join, "LONG", long)
    texts = copies(11)
    want, contract = (linked_sets(texts, *x) for x in ((5, 80), (4, 85)))
    assert {d for d in want if want[d] == d} != {d for d in contract if contract[d] == d}  # the thresholds matter here
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == sorted(d for d in want if want[d] == d)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(df).collect()} == contract


def test_near_duplicates_of_one_document_with_two_changed_words(spark):
    words = [f"w{k}" for k in range(100)]
    other = [*words[:30], "x", *words[31:60], "y", *words[61:]]
    df = spark.createDataFrame([(k, " ".join(w), "en", "s", 1) for k, w in enumerate((words, other, other[:50] + ["z"] * 50))], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [0, 2]


def test_secrets_of_letters_alone(spark):
    texts = ["pwd=QwXzRtYpLkMnVb", "passphrase: qzxwvkjhgf,", "access_key = QwXzRtYpLk.", "authorization: Bearer qzxwvkjhgf", "the passphrase is required, its credential is documentation."]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "guess"] for r in secret_scan.scan(df).collect()}
    assert got == {0: ["QwXzRtYpLkMnVb"], 1: ["qzxwvkjhgf"], 2: ["QwXzRtYpLk"], 3: ["qzxwvkjhgf"], 4: []}
    masked = {r["doc_id"]: r["text"] for r in corpus_pipeline.secrets(spark, df, "").collect()}
    assert masked[0] == "pwd=<secret>" and masked[1] == "passphrase: <secret>," and masked[4] == texts[4]


def test_language_model_trains_on_whole_texts(spark):
    rnd = random.Random(3)
    enc = subwords.subwords(subwords.default_tokenizer())
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(2000)), None, "a b", " ".join(["c"] * 64)]
    units, bounds = lm_scoring.units_of(enc, *lm_scoring.words_of(pa.array(texts)))
    got = np.concatenate(list(attention.training_windows(units, bounds, at_once=7)))
    targets = got[:, 1:][got[:, 1:] >= 0].tolist()
    assert targets == [n for t in texts for n in [*(1 + i for w in (t or "").split() for i in enc.tokenizer.encode(" " + w, add_special_tokens=False).ids), 0]]

    counts = np.ones(1 + enc.size)
    start = attention.Attention.start(attention.Layout.of(counts), counts)
    words = texts[0].split()

    def weights(*texts):
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(len(texts), "doc_id")
        return lm_scoring.averaged(df, start, subwords.default_tokenizer()).weights

    whole = weights(" ".join(words))
    for other in (["a"] * 500 + words[500:], words[:1500] + ["a"] * 500):  # a change anywhere in a text changes what is learnt
        assert any(not np.array_equal(x, y) for x, y in zip(whole, weights(" ".join(other)), strict=True))


def test_sums_of_blocks_are_streamed():
    rows = [(b, r, float(v)) for b in (-1, 0, 3) for r in (0, 1) for v in range(5)]
    make = lambda part: pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int32()), pa.array([x[1] for x in part], pa.int32()), pa.array([np.full(2, x[2]).tobytes() for x in part])], ["block", "branch", "change"])
    got = [(b.column(0)[0].as_py(), np.frombuffer(b.column(2)[0].as_py()).tolist()) for b in lm_scoring._summed(iter([make(rows[:7]), make(rows[7:8]), make(rows[8:])]))]
    assert got == [(b, [10.0, 10.0]) for b in (-1, 0, 3) for _ in (0, 1)]


def test_outsiders_of_a_large_family_are_found(spark, monkeypatch):
    """A centre that shares a passage with a family far from it, and outsiders near some of the family."""
    monkeypatch.setattr(ngram_join, "LONG", 4)
    monkeypatch.setattr(ngram_join, "GROUPS", 7)
    rnd = random.Random(21)
    passage = [f"p{k}" for k in range(40)]
    texts = [(0, " ".join(passage + [f"c{k}" for k in range(9)]))]
    for family in range(3):
        base = passage + [f"f{family}x{k}" for k in range(14)]
        for k in range(45):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 10**6)}"
            texts.append((1000 * (family + 1) + k, " ".join(w)))
    for width, percent in ((4, 85), (5, 80)):
        df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
        assert {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(df, width, percent).collect()} == linked_sets(texts, width, percent)


def test_ids_of_several_texts_are_one_node(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    df = spark.createDataFrame([(5, a), (5, b), (3, a + " z"), (4, b), (5, a)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(df).collect()} == {3: 3, 4: 3, 5: 3}


def test_sketches_differ_in_no_more_bits_than_sets_in_elements():
    rng = np.random.default_rng(4)
    for n, other in ((1, 0), (40, 3), (500, 100), (5000, 2000)):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[other:], rng.integers(0, 1 << 63, other, dtype=np.uint64)]))
        bits = int.from_bytes(ngram_join.sketch(a)) ^ int.from_bytes(ngram_join.sketch(b))
        assert bits.bit_count() <= len(np.setxor1d(a, b)) and len(ngram_join.sketch(a)) * 8 == ngram_join.SKETCH


def test_sets_go_only_to_pairs_whose_sketches_allow_a_link(spark):
    words = [f"w{k}" for k in range(300)]
    texts = [(0, words), (1, [*words, "x"]), (2, [*words[:200], *(f"y{k}" for k in range(100))]), (3, [*words[:5], "z"]), (3, words[:299])]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in texts], "doc_id long, text string")
    sent, sets_of = [], ngram_join.sets_of
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ngram_join, "sets_of", lambda docs, nodes, width: sent.extend(r["node"] for r in nodes.collect()) or sets_of(docs, nodes, width))
        pairs = spark.createDataFrame([(0, 1, False), (0, 2, False), (0, 3, False)], "a long, b long, central boolean")
        got = ngram_join.verified(common.Tables(spark), df, ngram_join.summaries(df), pairs).where("linked").collect()
    assert sorted(sent) == [0, 1, 3] and sorted((r["a"], r["b"]) for r in got) == [(0, 1), (0, 3)]


def test_mixing_does_not_shuffle_texts_for_its_limits(spark):
    rows = [(k, None if k % 7 == 0 else f"s{k % 3}", 1 + k % 50, hashlib.sha512(str(k).encode()).hexdigest()) for k in range(6000)]
    df = common.written(spark.createDataFrame(rows, "doc_id long, source string, size long, text string"), "test-mix")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
        plan = mixing.mix(df, F.lit(1.0), keep=["text"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan


def test_documents_go_by_id_without_a_shuffle_of_texts(spark, monkeypatch):
    rows = [(None if k % 10 == 9 else k // 2, "t" * 40) for k in range(4000)]
    df = common.written(spark.createDataFrame(rows, "doc_id long, text string"), "test-without")
    gone = spark.range(0, 2000, 3).withColumnRenamed("id", "doc_id")
    want = sorted((str(d), t) for d, t in rows if d is None or d % 3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for bits in (1 << 24, 64):  # with few bits, most rows need the exact join
        monkeypatch.setattr(ngram_join, "_BITS", bits)
        assert sorted((str(r["doc_id"]), r["text"]) for r in ngram_join.without(df, gone).collect()) == want
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2k")
        monkeypatch.setattr(ngram_join, "_BITS", 1 << 24)
        assert "SortMergeJoin" not in ngram_join.without(df, gone)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
