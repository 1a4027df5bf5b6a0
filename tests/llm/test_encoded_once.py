"""The language model's texts are split and encoded once, for training and for scoring."""

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import lm_scoring, subwords


@pytest.mark.parametrize("size", [50_000, 70_000])
def test_units_come_back_from_bytes(size):
    units, bounds = np.array([1, 0, 49_999, size, 7, 0, 0], np.int32), np.array([0, 2, 2, 6, 7])
    column = lm_scoring.packed(units, bounds, size)
    got, ends = lm_scoring.unpacked(column, size)
    assert got.tolist() == units.tolist() and ends.tolist() == bounds.tolist()
    got, ends = lm_scoring.unpacked(column.slice(2, 2), size)
    assert got.tolist() == units[2:].tolist() and ends.tolist() == [0, 4, 5]
    assert lm_scoring.unpacked(pa.array([], pa.binary()), size)[0].tolist() == []


def test_training_texts_may_be_a_condition(spark, monkeypatch):
    rows = [(k, " ".join(f"w{(k * j) % 23}" for j in range(40))) for k in range(80)] + [(None, "of no id"), (100, None), (101, ""), (3, "w1 w2 again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    made, prepared = [], lm_scoring.prepared
    monkeypatch.setattr(lm_scoring, "prepared", lambda *a: made.append(1) or prepared(*a))
    ordered = lambda d: sorted(map(tuple, d.collect()), key=str)
    one = ordered(lm_scoring.score(df, ~lm_scoring.held_out()))
    assert len(made) == 1 and len(one) == len(rows)
    two = ordered(lm_scoring.score(df, df.where(~lm_scoring.held_out())))
    assert [r[:4] for r in one] == [r[:4] for r in two]
    assert np.allclose([r[4:] for r in one], [r[4:] for r in two], rtol=1e-6)
    enc = subwords.subwords(subwords.default_tokenizer())
    kept = prepared(df.withColumn("learnt", ~lm_scoring.held_out()), subwords.default_tokenizer()).where("units IS NOT NULL").collect()
    for r in kept:  # whole texts, each with its end
        want = [1 + i for w in (r["text"] or "").split() for i in enc.tokenizer.encode(" " + w, add_special_tokens=False).ids] + [0]
        assert np.frombuffer(r["units"], "<u2").tolist() == want
    assert len(kept) == len(rows)


def test_equal_texts_score_alike_wherever_they_stand(spark):
    copy = " ".join(f"w{j % 13}" for j in range(60))
    rows = [(k, " ".join(f"w{(k * j) % 23}" for j in range(k % 50 + 1))) for k in range(120)]
    for k, at in enumerate((0, 7, 31, 32, 77, 118)):
        rows.insert(at, (1000 + k, copy))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(df, ~lm_scoring.held_out()).collect()}
    assert len({got[1000 + k] for k in range(6)}) == 1 and len(got) == len(rows)
