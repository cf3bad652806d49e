"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import spelling as S

from .cases import documents, empty


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows, every=97, least=3, ratio=2):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= least}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v.encode())) if near[w] else None for w in words}
    form = {w: b if b is not None and words[b] >= ratio * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), words[w], len(near[w]), words[form[w]] if form[w] else 0) for w in words)


def collected(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def made(seed, docs=60):
    """Texts of words with one to three letters changed, dropped or added, in few letters so that links are dense."""
    rng = random.Random(seed)
    base = ["".join(rng.choices("abé÷ß", k=rng.randrange(5, 12))) for _ in range(40)]
    out = []
    for d in range(docs):
        words = []
        for _ in range(60):
            w = base[int(rng.random() ** 3 * len(base))]
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3])):
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:], w[:i] + rng.choice("abé") + w[i + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append((d, rng.choice([" ", "-", "9"]).join(words)))
    return out


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = made(seed)
        got = collected(S.group(spark.createDataFrame(rows, "doc_id long, text string")))
        assert got == expected(rows) and sum(r[4] for r in got) > 100


@pytest.mark.parametrize("hot", [1000, 3])
def test_every_pair_once(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    words = spark.createDataFrame([(w, 3) for w in sorted({w for _, t in made(3) for w in re.findall("[a-zé÷ß]{5,}", t)})], "word string, n long")
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in S.links(words).collect()]
    known = [r["word"] for r in words.collect()]
    assert sorted(pairs) == sorted((a, b) for a in known for b in known if a < b and one_edit(a, b))


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    df = documents(spark, clash=True)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert collected(S.group(df.withColumns({"word": F.lit(1), "form": F.lit(2), "run": F.lit(3)}))) == expected(rows)


def test_long_words_and_long_ways(spark):
    long = "x" * 3000
    text = " ".join([long] * 3 + [long + "y"] * 6 + ["aaaaa"] * 3 + ["aaaab"] * 6 + ["aaabb"] * 12 + ["aabbb"] * 24 + ["abbbb"] * 48 + ["bbbbb"] * 96 + ["bbbbbc"] * 192)
    rows = [(1, text)]
    got = collected(S.group(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == expected(rows) and {r[2] for r in got if len(r[0]) < 9} == {"bbbbbc"}


def test_empty_table(spark):
    assert S.group(empty(spark)).collect() == []
