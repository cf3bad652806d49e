"""Language identification and the quality classifier: accuracy on held-out rows, and hard rows."""

import random
import zlib

import numpy as np
import pytest

from tallyspark.llm import language as L
from tallyspark.llm import quality as Q
from tests.llm.cases import ROWS, documents, empty

SYLLABLES = {"xx": "ka to mi ru se na".split(), "yy": "schul brot ung wein ter".split(), "zz": "éau oi que ment tion".split()}


def made(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))]
        out.append((i, " ".join(words), lang, "s"))
    return out


def test_vectors_are_bound_and_bundled():
    texts = ["ab, çd x", "", "123", "a", "Straße b", "日本"]
    for text, got in zip(texts, L.text_vectors(texts), strict=True):
        plain = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        s = f" {' '.join(plain)} " if plain else ""
        want = np.zeros(L.DIM)
        for i in range(len(s) - 2):
            if s[i + 1] != " ":
                bound = np.ones(L.DIM)
                for k in range(3):
                    bound *= np.roll(L.letter_vectors(np.array([0 if s[i + k] == " " else ord(s[i + k])]))[0], 2 - k)
                want += bound
        assert np.array_equal(got, want)


def test_predictions_against_slow_ones(spark):
    rows = made(200, 5)
    names, prototypes = L.learn(documents(spark, rows))
    learned = {}
    for i, text, lang, _ in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            v = L.text_vectors([text])[0].astype(float)
            learned[lang] = learned.get(lang, 0) + v / np.linalg.norm(v)
    assert names == sorted(learned)
    for k, name in enumerate(names):
        assert np.allclose(prototypes[k], learned[name] / np.linalg.norm(learned[name]), atol=1e-6)
    for r in L.classify(documents(spark, rows), names, prototypes).collect():
        v = L.text_vectors([r.text])[0].astype(float)
        near = [v @ prototypes[k] / np.linalg.norm(v) for k in range(len(names))]
        assert r.lang_pred == names[int(np.argmax(near))] and abs(r.score - max(0.0, max(near))) < 1e-6


def test_an_alphabet_that_was_not_learned_is_not_und(spark):
    rng = random.Random(3)
    names, prototypes = L.learn(documents(spark, made(300)))
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(rng.randrange(1, 30))) for _ in range(150)] + ["привет " * k for k in range(1, 20)]
    rows = L.classify(documents(spark, [(i, t, None, None) for i, t in enumerate(texts)]), names, prototypes).collect()
    assert all(r.lang_pred in names and 0.0 <= r.score < 0.25 for r in rows)
    assert min(r.score for r in rows) == 0.0


def test_grams_in_pieces_and_long_texts(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(400)) for _ in range(5)] + [made(1, 2)[0][1]]
    whole = L.vectors(texts)
    monkeypatch.setattr(L, "GRAMS", 50)
    assert np.array_equal(L.vectors(texts), whole)
    monkeypatch.setattr(L, "BLOCK_CHARS", 60)
    monkeypatch.setattr(L, "PART_CHARS", 60)
    spaced = [" ".join(t[k : k + 7] for k in range(0, len(t), 7)) for t in texts]
    assert all(len(p) <= 60 for t in spaced for p in L.pieces(t)) and "".join(L.pieces(spaced[0])) == spaced[0]
    assert np.array_equal(L.vectors(spaced), L.text_vectors(spaced))


def test_a_block_of_han_letters_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(0x4E00, 0x6000, 400_000)))
    tracemalloc.start()
    L.vectors([text])
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()


def test_languages_of_held_out_rows(spark):
    df = documents(spark, made(600), clash=True).drop("score", "lang_pred")
    rows = L.identify(df).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 100 and np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0.0 <= r.score <= 1.0 for r in rows)


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = made(300)
    spoiled = [(i, t, "lie" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s) for i, t, lang, s in rows]
    assert sorted(L.learn(documents(spark, spoiled))[0]) == sorted(SYLLABLES)


def test_hard_rows(spark):
    rows = {(r.doc_id, r.text): r for r in L.identify(documents(spark, clash=True)).collect()}
    assert len(rows) == len({(r[0], r[1]) for r in ROWS})
    for key in ((None, None), (4, ""), (5, "  \n\t"), (8, "!!! ... ???")):
        assert (rows[key].lang_pred, rows[key].score) == ("und", 0.0)
    assert L.identify(empty(spark)).count() == 0
    unlabelled = [(r[0], r[1], None, r[3]) for r in ROWS]
    assert {r.lang_pred for r in L.identify(documents(spark, unlabelled)).collect()} == {"und"}


def junk(text, rng):
    return " ".join(w.upper() + rng.choice("!#$%") * 3 for w in text.split())


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i, text, lang, source in made(900, 1):
        good = rng.random() < 0.8
        rows.append((i, text if good else junk(text, rng), lang, source))
        labels.append((i, int(good)))
    return rows, labels, spark.createDataFrame(labels + [(5, None), (7, 0), (7, 1)], "doc_id long, quality int")


def test_quality_of_held_out_rows(spark, labelled):
    rows, labels, frame = labelled
    docs = documents(spark, rows, clash=True).drop("score")
    got = {r.doc_id: r.score for r in Q.classify(docs, Q.learn(docs, frame)).collect()}
    held = [(got[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([s >= Q.THRESHOLD for s in good]) > 0.97
    assert all(0.0 <= s <= 1.0 for s in got.values())


def test_quality_hard_rows(spark, labelled):
    rows, _, frame = labelled
    model = Q.learn(documents(spark, rows), frame)
    out = Q.classify(documents(spark, clash=True), model).collect()
    assert len(out) == len(ROWS) and all(0.0 <= r.score <= 1.0 for r in out)
    again = Q.classify(documents(spark), model).collect()
    assert sorted(r.score for r in out) == sorted(r.score for r in again)
    nothing = Q.learn(empty(spark), frame.filter("false"))
    assert {r.score for r in Q.classify(documents(spark), nothing).collect()} == {0.5}
    assert Q.classify(empty(spark), model).count() == 0


def test_the_model_against_a_slow_one(spark, labelled):
    rows, _, frame = labelled
    docs = documents(spark, rows)
    model = Q.learn(docs, frame)
    y = {r.doc_id: r.y for r in frame.groupBy("doc_id").agg({"quality": "max"}).toDF("doc_id", "y").collect() if r.y is not None}
    half = {r.doc_id: r.h for r in docs.select("doc_id", Q.half_of(docs.doc_id).alias("h")).collect()}
    own = [(i, t) for i, t, *_ in rows if i in y and zlib.crc32(str(i).encode()) % 5]
    x = Q.all_statistics([t for _, t in own])
    assert np.allclose(model.mean, x.mean(0), atol=1e-8) and np.allclose(model.scale, np.maximum(x.std(0), 1e-6), atol=1e-8)
    z, target, side = Q.fourier(x, model.mean, model.scale), np.array([y[i] for i, _ in own], float), np.array([half[i] for i, _ in own])

    def ridge(rows):
        a = z[rows].T @ z[rows] + Q.RIDGE * rows.sum() / Q.FEATURES * np.diag([1.0] * Q.FEATURES + [0.0])
        return np.linalg.solve(a, z[rows].T @ target[rows])

    assert np.allclose(z @ model.weights, z @ ridge(side >= 0), atol=1e-4)
    raw = np.where(side == 0, z @ ridge(side == 1), z @ ridge(side == 0))
    step = np.round((np.clip(raw, Q.LOW, Q.HIGH) - Q.LOW) / Q.STEP).astype(int)
    known = np.unique(step)
    centres, chances = Q.isotonic(Q.LOW + Q.STEP * known, np.array([target[step == k].sum() for k in known]), np.array([(step == k).sum() for k in known]))
    ends = np.linspace(-0.5, 1.5, 50)
    assert np.allclose(np.interp(ends, model.steps, model.chances), np.interp(ends, centres, chances), atol=0.05)


def test_isotonic_is_the_least_squares_fit_that_rises():
    x, y = Q.isotonic(np.array([0.0, 1, 2, 3, 4]), np.array([1.0, 0, 2, 1, 3]), np.array([2.0, 2, 2, 2, 3]))
    assert np.allclose(y, [0.25, 0.75, 1.0]) and np.all(np.diff(x) > 0)
