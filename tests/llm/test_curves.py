import math
import random

import numpy as np

from llm.helpers import rows_of
from salesloom.llm import curves


def nearest(rows, every, k):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 4 and any(v) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, v in good:
        if i % every == 0:
            ranked = sorted((math.dist(v, w), j) for j, w in good if j != i)[:k]
            out += [(i, n + 1, j, d) for n, (d, j) in enumerate(ranked)]
    return sorted(out)


def test_hilbert_index_visits_neighbouring_cells():
    for size, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * size, indexing="ij"), -1).reshape(-1, size)
        index = curves.hilbert(cells, bits)
        assert sorted(index.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_small_tables_are_searched_whole(spark):
    rng = random.Random(2)
    rows = [(i, [round(rng.gauss(0, 1), 2) for _ in range(4)]) for i in range(300)]
    rows += [(400 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)] + [(500, None), (510, [0.0] * 4), (520, [1.0, None, 1.0, 1.0]), (530, [math.nan, 1.0, 1.0, 1.0]), (540, [math.inf, 1.0, 1.0, 1.0]), (550, [1.0] * 3), (None, [1.0] * 4)]
    rows += [rows[0], rows[5]]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id bigint, embedding array<double>, label int, point int, block int")
    got = [tuple(r) for r in rows_of(curves.search(df, "vec_id", "embedding", 10, 5), "query_id", "rank", "vec_id", "score")]
    want = nearest(rows, 10, 5)
    assert [r[:3] for r in sorted(got)] == [r[:3] for r in want]
    assert all(abs(a[3] - b[3]) < 1e-12 for a, b in zip(sorted(got), want))


def test_recall_over_several_blocks(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(6000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    got = curves.search(df, "vec_id", "embedding", 100, 10).toPandas()
    v = vectors.astype(float)
    hits = 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        mine = got[got["query_id"] == q].sort_values("rank")
        assert np.allclose(mine["score"], d[mine["vec_id"]], atol=1e-12) and len(mine) == 10
        hits += len(set(mine["vec_id"]) & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 600


def test_few_and_no_candidates(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert curves.search(spark.createDataFrame([], schema), "vec_id", "embedding", 10, 5).collect() == []
    assert curves.search(spark.createDataFrame([(0, [1.0, 2.0])], schema), "vec_id", "embedding", 10, 5).collect() == []
    two = curves.search(spark.createDataFrame([(0, [1.0, 2.0]), (3, [1.0, 3.0])], schema), "vec_id", "embedding", 10, 5)
    assert rows_of(two, "query_id", "rank", "vec_id", "score") == [(0, 1, 3, 1.0)]
