"""The stages against plain versions of what they decide."""

from collections import Counter

import pytest

import corpus_pipeline as P
from tallyspark.llm import bpe, jaccard, language, mixing, quality
from tests.llm.cases import documents, empty
from tests.llm.test_models import junk, made


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    import random

    rng = random.Random(9)
    rows = made(260, 3)
    rows = [(i, junk(t, rng) if i % 6 == 0 else t, lang, f"s{i % 4}") for i, t, lang, _ in rows]
    rows += [(1000 + i, rows[i + 1][1], rows[i + 1][2], "s9") for i in range(20)] + [(2000, "1234 !!", "xx", "s1"), (2001, None, None, None), (None, rows[3][1], "xx", "s1")]
    folder = tmp_path_factory.mktemp("sf")
    docs = documents(spark, rows).selectExpr("*", "cast(length(text) as long) as n_chars")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0)) for i in range(260)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_each_stage_takes_effect(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    key = lambda r: (r.doc_id, r.text)

    found = P.language_stage(spark, docs, corpus)
    assert found.columns == docs.columns
    left = {key(r) for r in docs.collect()} - {key(r) for r in found.collect()}
    assert left == {(2000, "1234 !!"), (2001, None)}

    model = quality.learn(found, spark.read.parquet(f"{corpus}/labels.parquet"))
    scores = dict(zip(map(key, rows := found.collect()), model.score(quality.all_statistics([r.text for r in rows])), strict=True))
    good = P.quality_stage(spark, found, corpus)
    assert {key(r) for r in good.collect()} == {k for k, s in scores.items() if s >= quality.THRESHOLD}
    assert sum(k[0] is not None and k[0] < 260 and k[0] % 6 == 0 for k in map(key, good.collect())) < 8

    one = P.near_duplicate_stage(spark, good, corpus)
    texts = [r.text for r in one.collect()]
    sets = [set(jaccard.shingles(t).tolist()) for t in texts]
    assert not any(len(a & b) / len(a | b) >= 0.8 for i, a in enumerate(sets) for b in sets[:i] if a and b)

    mixed = P.mixing_stage(spark, one, corpus)
    want = {key(r): r.copies for r in mixing.with_copies(one).collect()}
    assert Counter(map(key, mixed.collect())) == Counter({k: n for k, n in want.items() if n})

    last = P.encoding_stage(spark, mixed, corpus)
    t = bpe.load(bpe.default_path())
    assert Counter((r.doc_id, r.n_tokens) for r in last.collect()) == Counter((r.doc_id, len(t.encode(r.text)) // 4) for r in mixed.collect())


def test_an_unknown_alphabet_goes_and_short_texts_stay(spark, corpus):
    import random

    rng = random.Random(2)
    rows = [(i, t, lang, s) for i, t, lang, s in made(260, 3)]
    strange = [(3000 + i, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(200)), None, "s") for i in range(60)]
    short = [(4000 + i, "ka", None, "s") for i in range(3)]
    docs = documents(spark, rows + strange + short).selectExpr("*", "cast(length(text) as long) as n_chars")
    kept = {r.doc_id for r in P.language_stage(spark, docs, corpus).collect()}
    assert {r[0] for r in rows + short} <= kept
    assert sum(r[0] in kept for r in strange) < 6


def test_run_equals_the_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, corpus)
    assert Counter(map(tuple, P.run(spark, corpus).collect())) == Counter(map(tuple, docs.collect()))


def test_nothing_in_nothing_out(spark, corpus):
    docs = empty(spark).selectExpr("*", "cast(null as long) as n_chars")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, corpus)
    assert docs.count() == 0
    assert language.UNKNOWN == "und"
