"""Rows that operators must survive: nulls, blanks, long texts, repeats and clashing columns."""

import random

from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(seed: int, n: int = 40) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


LONG = " ".join(f"word{i % 977} teil" for i in range(30_000))
BASE = sentence(1, 60)
NEAR = BASE.replace(BASE.split()[30], "changed", 1)

ROWS = [
    (None, None, None, None), (None, "text without an id", "en", "a"), (0, BASE, "en", "a"), (1, BASE, "en", None), (2, NEAR, "de", "b"), (3, NEAR, "de", "b"), (3, NEAR, "de", "b"),
    (4, "", "en", "a"), (5, "  \n\t", None, "a"), (6, LONG, "en", "c"), (7, LONG + " end", "en", "c"), (8, "!!! ... ???", "fr", "c"), (9, "one two", "fr", "b"), (10, "one two", "fr", "b"),
    (11, "Übergrößen 日本語 😀 é", "de", "d"), (12, "<|endoftext|> x <|endoftext|>", "en", "d"), (13, "Released under the MIT License. CC-BY-NC and Apache License, Version 2.0!", "en", "d"), (14, sentence(14), "en", "d"), (100, sentence(14) + " more", "en", "d"), (100, sentence(99), "en", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHES = ["size", "score", "copies", "rate", "target", "labels", "detections", "n_words", "k", "n", "rep", "kept", "n_links", "lang_pred", "n_tokens", "words", "y", "x", "ids", "__row"]


def documents(spark, rows=ROWS, clash=False):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}) if clash else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
