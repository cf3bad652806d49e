"""Hard negatives against brute force, and what the bounds save."""

import math

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import negatives as N

SCHEMA = "vec_id long, label int, embedding array<float>"


def made(seed, n=600, d=8, labels=4, spread=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.exp(rng.normal(size=(n, 1)) * spread)
    x[n // 2 : n // 2 + 20] = x[n // 2]  # ties
    return [(i, int(rng.integers(labels)) if i % 3 else 1, [float(np.float32(c)) for c in x[i]]) for i in range(n)]


def expected(rows, k=5):
    sound = []
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        label = int(math.fmod(label + 1, 10)) if vec_id % 7 == 0 else label
        sound.append((vec_id, label, [math.floor(256 * c) for c in v]))
    out = []
    for i, (a, label, v) in enumerate(sound):
        if a % 100:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w, strict=True)), b, other == label) for j, (b, other, w) in enumerate(sound) if j != i and len(w) == len(v)]
        for p, pid, _ in sorted(s for s in scores if s[2])[:k]:
            fit = sorted((s, b) for s, b, same in scores if not same and 80 * -p <= 100 * -s <= 100 * -p)[:k]
            out += [(a, pid, r, b, -p, -s) for r, (s, b) in enumerate(fit, 1)]
    return sorted(out)


def collected(df):
    return sorted(tuple(r[c] for c in ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]) for r in df.collect())


def test_equals_brute_force(spark, monkeypatch):
    rows = made(1)
    for cells, lane in ((1 << 20, 16_384), (16, 50)):  # one task a family, then many blocks and lanes
        monkeypatch.setattr(N, "BLOCK_CELLS", cells)
        monkeypatch.setattr(N, "LANE_ROWS", lane)
        got = collected(N.mine(spark.createDataFrame(rows, SCHEMA)))
        assert got == expected(rows) and len(got) > 50


def test_nulls_repeats_lengths_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(2, 150, 3) + [(None, 1, [1.0, 2.0, 3.0]), (200, None, [1.0, 2.0, 3.0]), (300, 1, None), (400, 1, [1.0, None, 0.0]), (500, 1, [nan, 1.0, 0.0]), (600, 1, [inf, 1.0, 0.0]),
                              (700, 1, []), (701, 1, []), (702, 2, []), (800, 1, [1.0, 1.0]), (801, 1, [1.0, 1.0]), (802, 3, [1.0, 0.9]), (900, 1, [0.0, 0.0, 0.0]), (900, 1, [0.0, 0.0, 0.0]),
                              (-100, -5, [1.0, 2.0, 3.0]), (-99, -5, [1.0, 2.0, 2.0]), (-98, 4, [1.0, 2.0, 2.1]), (1000, 1, [-1e-20, 3e4, 1e5]), (1001, 1, [1e6, 3e6, 1e6]), (1002, 2, [1e6, 3e6, 9e5])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ["uid", "v", "norm", "rank", "anchor", "family", "x", "low", "high"]})
    assert collected(N.mine(df)) == expected(rows)


def test_no_rows(spark):
    assert N.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert N.mine(spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0])], SCHEMA)).collect() == []


def test_products_are_exact_beyond_doubles():
    q, c = np.array([[2.0**40 + 1, 3.0]]), np.array([[2.0**20 + 1, 1.0], [-(2.0**22), 7.0]])
    assert N.products(q, c).tolist() == [[(2**40 + 1) * (2**20 + 1) + 3, -(2**22) * (2**40 + 1) + 21]]


def test_bounds_leave_most_buckets_out():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(20_000, 16)) * np.exp(rng.normal(size=(20_000, 1))) * 256)
    norms = np.sqrt((x * x).sum(1))
    order = np.argsort(-norms)
    q = x[:50]
    full = (q @ x.T).astype(np.int64)
    low = np.full((50, 1), -(1 << 62))
    w = N.Windows(q, norms[:50], low, -low, 5)
    for s in range(0, len(x), 500):
        part = order[s : s + 500]
        w.add(x[part], part, float(norms[part].max()), lambda a: np.ones((len(a), 500), bool))
    for a in range(50):
        best = sorted((-s, i) for i, s in enumerate(full[a]))[:5]
        assert [(-int(s), int(i)) for s, i in zip(w.score[a, 0], w.id[a, 0], strict=True)] == best
    assert w.compared < 0.5 * full.size
