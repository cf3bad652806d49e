import hashlib
import math
import re
from collections import Counter, defaultdict

from tallyspark.llm import mixing as M
from tests.llm.cases import CLASHES, ROWS, documents, empty

SIZE = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5.0, 2.0, 1.0)):
    """Shares by weight, again and again until no source is above three times its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in held]
        left = total - sum(held.values())
        w = sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free}
        over = [s for s in free if share[s] >= 3 * sizes[s]]
        if not over:
            return held | share
        held |= {s: 3.0 * sizes[s] for s in over}
        if len(held) == len(names):
            return held


def test_targets_equal_repeated_sharing(spark):
    import random

    for seed in range(6):
        rng = random.Random(seed)
        sizes = {f"s{k}": rng.choice([0, 1, 5, 40, 300, 5000]) for k in range(rng.randrange(2, 9))} | {None: 7}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in M.source_targets(df).collect()}
        expected = targets(sizes)
        assert got.keys() == expected.keys() and all(math.isclose(got[s], expected[s], abs_tol=1e-6) for s in got), (sizes, got, expected)


def test_copies_and_emitted_rows(spark):
    docs = documents(spark, clash=True)
    out = M.with_copies(documents(spark)).collect()
    sizes = defaultdict(int)
    for _, t, _, s in ROWS:
        sizes[s] += len(SIZE.findall(t or ""))
    goal = targets(sizes)
    for r in out:
        rate = goal[r.source] / sizes[r.source] if sizes[r.source] else 0.0
        key = "|".join(["mix-1", "" if r.doc_id is None else str(r.doc_id), r.text or ""])
        u = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / 2**32
        assert r.copies == math.floor(rate) + (u < rate - math.floor(rate)) <= 3
    emitted = M.mix(docs)
    assert emitted.columns == docs.columns and set(CLASHES) <= set(emitted.columns)
    want = Counter()
    for r in out:
        want[r.doc_id, r.text] += r.copies
    assert Counter((r.doc_id, r.text) for r in emitted.collect()) == +want


def test_reruns_agree_and_empty(spark):
    a, b = (sorted((str(r.doc_id), r.copies) for r in M.with_copies(documents(spark)).collect()) for _ in range(2))
    assert a == b
    assert M.mix(empty(spark)).count() == 0


def test_many_sources_are_joined_without_broadcast(spark, monkeypatch):
    expected = sorted((str(r.doc_id), r.copies) for r in M.with_copies(documents(spark)).collect())
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    assert sorted((str(r.doc_id), r.copies) for r in M.with_copies(documents(spark)).collect()) == expected
