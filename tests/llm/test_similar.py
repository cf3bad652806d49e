"""Similarity joins against all pairs."""

import random

import numpy as np
import pytest

from tallyspark.llm import graph, jaccard as J, neardup as E
from tests.llm.cases import ROWS, documents, empty, sentence


def components(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_components_of_random_graphs(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5)]
    want = components(341, pairs)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    assert all(got.get(x, x) == want[x] for x in range(341))


def test_components_of_a_long_path(spark):
    rng = random.Random(1)
    names = list(range(1500))
    rng.shuffle(names)
    path = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")
    assert {(r.root, r.node) for r in graph.components(path).collect()} == {(0, x) for x in range(1, 1500)}


def variants(seed, n, changes):
    rng = random.Random(seed)
    base = sentence(seed, 90).split()
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(changes)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
        yield " ".join(words)


@pytest.mark.parametrize("block", [1024, 16])
def test_jaccard_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    texts = [t for s in range(4) for t in variants(s, 40, 4)] + [sentence(s, 50) for s in range(50, 90)]
    rows = [(i + 1000, t, "en", "a") for i, t in enumerate(texts)] + ROWS
    sets = [set(J.shingles(t).tolist()) for _, t, *_ in rows]
    near = lambda a, b: bool(a and b) and len(a & b) / len(a | b) >= 0.8
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if near(sets[a], sets[b])]
    comp = components(len(rows), pairs)
    links = [0] * len(rows)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    ids = {}
    for i, c in enumerate(comp):
        if rows[i][0] is not None:
            ids[c] = min(ids.get(c, 10**9), rows[i][0])
    want = sorted((str(r[0]), str(ids.get(comp[i]) if sets[i] else r[0]), links[i]) for i, r in enumerate(rows))
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in J.join(documents(spark, rows, clash=True)).collect())
    assert got == want
    kept = J.deduplicate(documents(spark, rows, clash=True))
    assert kept.count() == len({c for i, c in enumerate(comp) if sets[i]}) + len({(r[0], r[1] or "") for i, r in enumerate(rows) if not sets[i]})
    assert kept.columns == documents(spark, rows, clash=True).columns


def sampled(sizes):
    return J.Audit([bytes([i]) * 16 for i in range(len(sizes))], np.array(sizes), np.zeros(0, np.uint64), np.zeros(0, int))


def test_prefixes_are_as_long_as_the_audited_links_allow():
    assert J.prefix_lengths(sampled([]), {}) == [7, 7, 7, 7]
    close, far = {98: 5}, {80: 1}
    assert J.prefix_lengths(sampled([10, 100, 1000]), {0: close, 1: far, 2: close}) == [8, 7, 8, 7]
    # many links of one close group do not hide a few far ones
    assert J.prefix_lengths(sampled([100, 100]), {0: {99: 50_000}, 1: far})[1] == 7
    assert J.meeting(0.8, 7) >= 0.999 > J.meeting(0.8, 8)


def test_candidates_against_all_prefixes():
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 2, (40, J.TREES, J.DEPTH)).astype(np.uint8)
    lengths = rng.choice([5, 8], 40)
    common = (np.cumprod(sig[:, None] == sig[None, :], axis=3).sum(3)).max(2)
    want = common >= np.minimum(lengths[:, None], lengths[None, :])
    got = J.candidates(sig, lengths)
    assert np.array_equal(got & ~np.eye(40, dtype=bool), want & ~np.eye(40, dtype=bool))


@pytest.mark.parametrize("partitions", [1, 13])
def test_sorted_neighbours_connect_all_that_share_a_prefix(spark, partitions):
    rng = np.random.default_rng(3)
    sigs = rng.integers(0, 3, (300, J.TREES * J.DEPTH)).astype(np.uint8)
    sigs[:120] = sigs[0]
    reps = spark.createDataFrame([(i.to_bytes(16, "big"), s.tobytes()) for i, s in enumerate(sigs)], "k binary, sig binary")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    pairs = [(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in J.trie_neighbours(reps, 6).collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    path = sigs.reshape(300, J.TREES, J.DEPTH)[:, :, :6]
    want = [(a, b) for a in range(300) for b in range(a) if (path[a] == path[b]).all(1).any()]
    assert components(300, pairs) == components(300, want)


def test_the_audit_counts_true_links(spark):
    texts = [t for s in range(6) for t in variants(s, 20, 5)]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(500, texts[0], "en", "a")]
    docs = documents(spark, rows).select("doc_id", "text")
    audit = J.audit_sample(docs)
    sets = [set(J.shingles(t).tolist()) for _, t, *_ in rows]
    key = {J.shingles(t).tobytes(): t for t in texts}
    true = J.audited_links(J.representatives(docs, audit, 0.8))
    for a in range(len(audit.keys)):
        own = set(audit.marks[audit.owner == a].tolist())
        text = key[np.array(sorted(own), np.uint64).tobytes()]
        want = sum(len(own & s) / len(own | s) >= 0.8 for (_, t, *_), s in zip(rows, sets) if t != text)
        assert sum(true.get(a, {}).values()) == want
    assert len(audit.keys) == len(set(texts))


def test_long_texts_are_audited_and_found(spark):
    words = [f"w{i}" for i in range(6_000)]
    near = [" ".join(words[:k] + [f"new{k}"] + words[k + 1 :]) for k in range(0, 6_000, 1_500)]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate([*near, *[sentence(s) for s in range(40)]])])
    audit = J.audit_sample(docs)
    long = np.flatnonzero(audit.sizes > J.CLASSES[-1])
    assert len(long) == len(near) and set(J.class_of(audit.sizes[long])) == {len(J.CLASSES)}
    true = J.audited_links(J.representatives(docs, audit, 0.8))
    assert all(sum(true[a].values()) == len(near) - 1 for a in long)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.join(docs).collect()}
    assert [got[i] for i in range(len(near))] == [(0, len(near) - 1)] * len(near) and all(got[i] == (i, 0) for i in range(len(near), 44))


def test_long_texts_in_the_sample_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(J, "LONG_SHINGLES", 9_000)
    docs = documents(spark, [(i, " ".join(f"w{i}x{k}" for k in range(5_000)), "en", "a") for i in range(5)])
    assert len(J.audit_sample(docs).keys) == 1
    monkeypatch.setattr(J, "LONG_SHINGLES", 10)
    assert len(J.audit_sample(docs).keys) == 1


def test_low_recall_shortens_prefixes_and_then_is_an_error(spark, monkeypatch):
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(variants(1, 6, 3))])
    seen = []
    real = J.trie_neighbours
    monkeypatch.setattr(J, "trie_neighbours", lambda reps, length: seen.append(length) or real(reps, length))
    monkeypatch.setattr(J, "measured_recall", lambda *a: {1: 0.5} if len(seen) < 3 else {})
    J.join(docs).collect()
    assert len(seen) == 3 and seen[2] < seen[0]
    monkeypatch.setattr(J, "prefix_lengths", lambda *a: [1] * (len(J.CLASSES) + 1))
    monkeypatch.setattr(J, "measured_recall", lambda *a: {1: 0.5})
    with pytest.raises(RuntimeError, match="0.500"):
        J.join(docs)


def test_jaccard_of_nothing(spark):
    assert J.join(empty(spark)).count() == 0
    assert J.deduplicate(empty(spark)).count() == 0


@pytest.mark.parametrize("limit", [4096, 64])
def test_vectors_equal_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(E, "MAX_SHARD", limit)
    monkeypatch.setattr(E, "SHARD", 60)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(160, 24))
    near = [base[k % 12] + rng.normal(size=24) * rng.choice([0.02, 0.1, 0.25]) for k in range(140)]
    x = [list(map(float, v)) for v in [*base, *near, base[0], base[0] * 3]]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [1.0, None] * 12, [float("inf")] + [1.0] * 23, [1.0, 2.0]]
    rows = [(i, v, "clash") for i, v in enumerate(x + odd)] + [(None, x[1], "clash")]
    u = np.array(x + [x[1]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    comp = components(len(u), np.argwhere(linked).tolist())
    got = {r.vec_id: r for r in E.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, k string")).collect()}
    assert len(got) == len(rows)
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (linked[i].sum(), comp[i], comp[i] == i)
    for i in range(len(x), len(x) + len(odd)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].n_links == linked[len(x)].sum()


def test_the_audit_sees_lost_links_beside_a_large_group(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 32))
    x = [*(base[0] + rng.normal(size=(300, 32)) * 0.01), *base[1:], *(base[1:] + 0.01)]
    reps = spark.createDataFrame([(bytes([i // 256, i % 256]), list(map(float, v)), 1) for i, v in enumerate(x)], "k binary, embedding array<double>, n long")
    links = spark.createDataFrame([(bytes([i // 256, i % 256]), 299) for i in range(300)], "k binary, links long")
    assert E.audited_recall(reps, links, len(x), 0.95) == 0
    both = links.unionByName(spark.createDataFrame([(bytes([i // 256, i % 256]), 1) for i in range(300, len(x))], "k binary, links long"))
    assert E.audited_recall(reps, both, len(x), 0.95) == 1


def test_a_recall_that_stays_too_low_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(E, "audited_recall", lambda *a: 0.5)
    with pytest.raises(RuntimeError, match="0.500"):
        E.link(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<double>"))


def test_a_pair_that_the_first_shard_misses_counts_once(spark, monkeypatch):
    monkeypatch.setattr(E, "search", lambda x, graph, start, a, similarity: np.zeros(0, int))
    v = [[1.0, 0.0], [1.0, 0.01]]
    places = spark.createDataFrame([(s, 0, 0, bytes([i]), 1, 0, v[i], [5, 9], [bytes([1 - i]) * 16]) for s in (5, 9) for i in (0, 1)], "shard long, i int, j int, k binary, n long, block int, embedding array<double>, shards array<long>, lists array<binary>")
    lists = places.select("k", "lists").distinct()
    got = E.found_links(places.drop("lists"), lists, 0.95).groupBy("k").sum("links").collect()
    assert sorted(r[1] for r in got) == [1, 1]


def test_no_vectors(spark):
    assert E.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
