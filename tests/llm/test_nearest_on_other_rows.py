"""op6's search where codes don't tell vectors apart, and where queries aren't like the rows."""

import numpy as np
import pytest

from skein.llm import vector_search


@pytest.mark.parametrize("kind", ["tight groups", "queries elsewhere"])
def test_the_nearest_are_found(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4, 16))[rng.integers(0, 4, 3000)] + 1e-3 * rng.normal(size=(3000, 16))
    if kind == "queries elsewhere":
        x[::50] = rng.normal(size=(60, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict[int, set] = {}
    for r in vector_search.nearest(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    away = u[::50] @ u.T
    away[np.arange(60), np.arange(0, 3000, 50)] = -2
    want = {50 * i: set(np.argsort(-row)[:5].tolist()) for i, row in enumerate(away)}
    assert sum(len(got[q] & want[q]) for q in want) >= 0.95 * 5 * len(want)
