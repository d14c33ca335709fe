"""Blocks of queries past which the base streams."""

import numpy as np

from vecloom.operators import nearest as N


def _brute(ids, x, k):
    y = x.astype(np.float64)
    n = np.linalg.norm(y, axis=1, keepdims=True)
    y = np.divide(y, n, out=np.zeros_like(y), where=n != 0)
    d = np.round(1 - y @ y.T, 9) + 0.0
    return {(int(ids[q]), int(ids[i])) for q in range(len(ids)) for i in sorted(range(len(ids)), key=lambda i: (np.isnan(d[q, i]), d[q, i], ids[i]))[:k]}


def test_block_against_brute_force_with_few_exact_distances(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1203, 24)).astype(np.float32)
    x[700:730] = x[5]  # more copies than are kept
    x[900] = 0
    x[31] = x[5] * np.float32(3)
    ids = rng.permutation(5000)[: len(x)].astype(np.int64)
    worked, merge = [], N._Block._merge
    monkeypatch.setattr(N._Block, "_merge", lambda self, s, q, *a: (worked.append(len(q)), merge(self, s, q, *a))[1])
    block = N._Block(ids, x, 7, 9)
    for s in range(0, len(x), 150):
        block.take(ids[s : s + 150], x[s : s + 150])
    q, near, _ = block.rows()
    assert set(zip(q.tolist(), near.tolist())) == _brute(ids, x, 7) and len(q) == 7 * len(x)
    assert sum(worked) < len(x) ** 2 / 10


def test_fewer_rows_than_are_kept_and_not_a_number():
    x = np.array([[1, 0], [0, 1], [np.nan, 1], [1, 1]], np.float32)
    ids = np.arange(4)
    for k in (2, 3, 4, 9):
        block = N._Block(ids, x, k, 9)
        for s in (0, 1, 3):
            block.take(ids[s : s + (1 if s != 1 else 2)], x[s : s + (1 if s != 1 else 2)])
        q, near, _ = block.rows()
        assert set(zip(q.tolist(), near.tolist())) == _brute(ids, x, k)


def test_shuffles_no_rows_of_pairs_of_blocks(spark):
    """Rows that are ranked at the end: k a query and part of the base, however many blocks there are."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 4)).astype(np.float32))], "vec_id long, embedding array<float>")
    plan = N.nearest(df, df, 3, block=8)._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and N.nearest(df, df, 3, block=8).count() == 1200
