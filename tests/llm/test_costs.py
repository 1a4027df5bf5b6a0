"""What operators spend beyond their results: counted, not timed."""

import resource

import numpy as np
import pyarrow as pa
import regex

from skein.llm import attention, common, subwords


def page_faults_of_arrays(spark, *limit):
    """Page faults of a task that makes and drops 200 arrays of 4 MB, 1,024 pages each."""

    def run(batches):
        for _ in batches:
            pass
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
        for _ in range(200):
            np.ones(1 << 20, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before])], ["n"])

    return spark.range(0, 1, 1, 1).transform(common.by_arrow(run, "n long", *limit)).first()["n"]


def test_tasks_of_large_arrays_do_not_fetch_each_array_from_the_system(spark):
    few, many = page_faults_of_arrays(spark, common.FREED_BYTES_OF_ARRAYS), page_faults_of_arrays(spark)
    assert 4 * few < many  # other tasks keep the smaller limit, in the same workers


def test_pieces_that_hold_breaks_spaces_and_rare_letters_keep_their_places():
    enc = subwords.Subwords(subwords.default_tokenizer())
    pieces = [" the", "\n", " \n\n", "", " café", "Ċ", " Ġx", "\t", " a", "\x00", "ÿ", " unthinkableness"]
    got = [np.frombuffer(x, "<u4").tolist() for x in enc.pieces_of(pieces)]
    assert got == [np.frombuffer(enc.pieces_of([p])[0], "<u4").tolist() for p in pieces]
    whole = [p for p in pieces if p and regex.fullmatch(subwords.PIECES, p)]
    assert len(whole) > 7
    for p in whole:
        assert np.frombuffer(enc.pieces_of([p])[0], "<u4").tolist() == enc.tokenizer.encode(p, add_special_tokens=False).ids


def small_model():
    rng = np.random.default_rng(5)
    counts = rng.integers(1, 1000, 2500).astype(float)
    model = attention.Attention.start(attention.Layout.of(counts), counts)
    return rng, attention.Attention(model.layout, [(w + rng.normal(0, 0.3, w.shape)).astype(np.float32) for w in model.weights])


def test_texts_score_alike_alone_and_among_others():
    rng, model = small_model()
    bounds = np.concatenate([[0], np.cumsum([1, 15, 16, 17, 31, 32, 33, 47, 48, 49, 200, 3])])
    units = rng.integers(0, 2500, bounds[-1]).astype(np.int32)
    alone = [attention.text_scores(model, units[a:z], np.array([0, z - a]))[0] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
    for at_once, held in ((1, 1), (2, 3), (128, 32)):
        assert np.allclose(attention.text_scores(model, units, bounds, at_once, held), alone, rtol=1e-6)


def test_classes_of_units_are_computed_once_a_batch(monkeypatch):
    """Products by class, of which a batch of texts needs one each, however many windows it has."""
    rng, model = small_model()
    units, seen = rng.integers(0, 2500, 16 * 2000).astype(np.int32), []
    grouped = attention.Attention._by_class
    monkeypatch.setattr(attention.Attention, "_by_class", lambda self, cls: seen.append(len(cls)) or grouped(self, cls))
    attention.text_scores(model, units, np.array([0, len(units)]))
    assert sum(seen) == len(units) and len(seen) == 1


def test_a_step_changes_leaves_by_neighbouring_classes_at_once():
    rng, model = small_model()
    trainer, spans = attention.Trainer(model, 0.1), []
    windows = rng.integers(0, 2500, (attention.BATCH, attention.LENGTH + 1)).astype(np.int32)
    trainer.gradients(windows, lambda lo, hi, g: spans.append((lo, hi)) or None)
    starts = model.layout.starts
    several = sorted(int(x) for x in set(model.layout.cls[windows[:, 1:]].ravel()) if starts[x + 1] - starts[x] > 1)
    assert [r for lo, hi in spans for r in range(lo, hi)] == [r for c in several for r in range(starts[c], starts[c + 1])]
    assert len(spans) < len(several) / 3
