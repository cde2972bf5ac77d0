import math
import random

import pytest

from lamella.llm import search

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, queries, k):
    def ints(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * x) for x in v]

    data = [(i, ints(v)) for i, v in rows if i is not None and ints(v) is not None]
    out = []
    for q, v in dict((i, ints(v)) for i, v in queries if i is not None and ints(v) is not None).items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in data if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.fixture
def vectors(spark):
    def make(rows):
        import numpy as np

        return spark.createDataFrame([(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v], 1, "x") for i, v in rows], SCHEMA).repartition(4)

    return make


def exact(rows):
    import numpy as np

    return [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("block", [32_768, 7])
def test_equals_brute_force(vectors, monkeypatch, block):
    monkeypatch.setattr(search, "DATA_BLOCK", block)
    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    monkeypatch.setattr(search, "BROADCAST_NEEDS", 0 if block == 7 else 200_000)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 3, 1) / 4 for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)]
    df = vectors(rows)
    got = sorted(tuple(r) for r in search.top_k(df, df.where("vec_id % 50 = 0")).collect())
    assert got == brute(exact(rows), [r for r in exact(rows) if r[0] % 50 == 0], 5)


def test_nulls_ties_and_repeats(vectors):
    rows = [(0, [1.0, 0.5]), (1, None), (2, [None, 1.0]), (3, [math.nan, 1.0]), (4, [math.inf, 0.0]), (5, [1.0]), (6, [1.0, 0.5]), (6, [1.0, 0.5]), (7, [-1.0, 0.2, 3.0]), (None, [9.0, 9.0]), (8, [])]
    df = vectors(rows)
    assert sorted(tuple(r) for r in search.top_k(df, df).collect()) == brute(exact(rows), exact(rows), 5)


def test_few_and_no_rows(vectors):
    df = vectors([(0, [1.0])])
    assert search.top_k(df, df).collect() == []
    none = df.where("false")
    assert search.top_k(none, none).collect() == []
    assert search.top_k(df, none).collect() == []
    assert search.top_k(vectors([(1, None)]), df).collect() == []


def clustered(rng, centres, each, width=16):
    rows = []
    for c in range(centres):
        middle = [rng.gauss(0, 1) for _ in range(width)]
        rows += [(c * each + i, [m + rng.gauss(0, 0.02) for m in middle]) for i in range(each)]
    return rows


def test_only_needed_rows_are_sent(vectors, monkeypatch):
    monkeypatch.setattr(search, "DATA_BLOCK", 7)
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    rows = clustered(random.Random(9), 20, 60)
    df = vectors(rows)
    asked = df.where("vec_id % 10 = 0")
    sent = search.send(df, asked, 5, "vec_id", "embedding")
    assert sent.data_rows == 1200 and sent.query_blocks >= 120 / 7
    assert sent.rows.count() < 0.3 * sent.data_rows * sent.query_blocks
    assert sent.rows.groupBy("block", "chunk").count().agg({"count": "max"}).first()[0] <= 30  # blocks are dealt by a hash
    assert search.visited_share(df, asked) < 0.3
    got = sorted(tuple(r) for r in search.top_k(df, asked).collect())
    assert got == brute(exact(rows), [r for r in exact(rows) if r[0] % 10 == 0], 5)


def test_bounds_leave_every_answer_in():
    import numpy as np

    rng = np.random.default_rng(3)
    for scale, spread in ((256, 0.1), (256, 2.0), (5, 0.5), (1e9, 0.3)):
        x = np.floor(scale * (rng.standard_normal((8, 6))[rng.integers(0, 8, 300)] + spread * rng.standard_normal((300, 6))) * rng.uniform(0.2, 2, (300, 1)))
        pivots = np.unique(x[:20], axis=0)
        cell = ((x[:, None] - pivots[None]) ** 2).sum(axis=2).argmin(axis=1)
        far = np.linalg.norm(x - pivots[cell], axis=1)
        groups = range(len(pivots))
        near = [np.flatnonzero(cell == c)[np.argsort(far[cell == c], kind="stable")][:5] for c in groups]
        known = search.Summary(
            np.array([(cell == c).sum() for c in groups]),
            np.array([far[cell == c].max(initial=0) for c in groups]),
            np.array([np.linalg.norm(x[cell == c], axis=1).max(initial=0) for c in groups]),
            np.stack([np.pad(far[n], (0, 5 - len(n)), constant_values=np.inf) for n in near]),
            np.stack([np.pad(n, (0, 5 - len(n))) for n in near]),
        )
        needed, low, high, length = search.bounds(x, np.arange(300), cell, pivots, known, 5)
        for i in range(300):
            best = sorted((-float(x[i] @ x[j]), j) for j in range(300) if j != i)[:5]
            for _, j in best:
                c = cell[j]
                assert needed[i, c] and low[i, c] <= far[j] <= high[i, c] and np.linalg.norm(x[j]) >= length[i, c]


def test_large_finite_components(vectors):
    rng = random.Random(6)
    rows = [(i, [rng.choice([3e20, -3e20, 1e19, 2.0**40, 0.7, -0.2, 3.4e38]) for _ in range(3)]) for i in range(60)]
    rows += [(100, [1.1e8, 1.3e8, 1.7e8]), (101, [1.1e8, 1.3e8, 1.7e8]), (102, [1.1e8, 1.3e8, 1.7e8 + 16]), (103, [0.0, 0.0, 0.0])]
    df = vectors(rows)
    held = [(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in whole_brute(exact(rows), 5)]
    assert sorted(tuple(r) for r in search.top_k(df, df).collect()) == sorted(held)


def whole_brute(rows, k):
    """Scores held to a long's range before they are ranked."""
    data = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    out = []
    for q, v in data:
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in data if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


def test_repeated_query_ids_are_queries_of_their_own(vectors):
    df = vectors([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0])])
    got = sorted(tuple(r) for r in search.top_k(df, df.where("vec_id = 0"), k=1).collect())
    assert got == [(0, 1, 1, 131072), (0, 1, 2, 196608)]


def test_answers_of_many_chunks_come_together(vectors, monkeypatch):
    monkeypatch.setattr(search, "DATA_BLOCK", 3)
    rng = random.Random(12)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    df = vectors(rows)
    assert search.send(df, df.where("vec_id < 9"), 5, "vec_id", "embedding").chunks > 64
    got = sorted(tuple(r) for r in search.top_k(df, df.where("vec_id < 9")).collect())
    assert got == brute(exact(rows), [r for r in exact(rows) if r[0] < 9], 5)


def test_very_many_equal_rows(vectors, monkeypatch):
    """A third of all rows are one row, a third have one id: neither is one task's work, and no answer changes."""
    monkeypatch.setattr(search, "DATA_BLOCK", 20)
    rng = random.Random(14)
    rows = [(7, [0.5, 0.25, 1.0])] * 120 + [(8, [rng.gauss(0, 1) for _ in range(3)]) for _ in range(120)] + [(100 + i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(120)]
    df = vectors(rows)
    asked = df.where("vec_id in (7, 101, 150)")
    sent = search.send(df, asked, 5, "vec_id", "embedding")
    assert sent.rows.groupBy("block", "chunk").count().agg({"count": "max"}).first()[0] <= 40
    got = sorted(tuple(r) for r in search.top_k(df, asked).collect())
    assert got == brute(exact(rows), [r for r in exact(rows) if r[0] in (7, 101, 150)], 5)
