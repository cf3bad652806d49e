"""Operator 9: language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of an n-gram is the
product of its letters' vectors, each rotated by its place; the vector of a
text is the sum over its n-grams; the prototype of a language is the sum over
its texts, each of unit length. A text gets the language
whose prototype has the largest cosine with it.

Texts are lower-cased, everything that is not a letter is a word break, and one
break stands at either end, so that a single letter has an n-gram too.

The prototypes are learned from at most about ``TRAIN_ROWS`` documents, drawn by
a hash of doc_id from those whose crc32(doc_id) mod 3 is not 1; each partition
sends one summed vector per language. Prediction reads all documents and moves
none.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and
only such a text: one unlike all prototypes gets the nearest, with a score down
to 0; a text of more than ``PART_CHARS`` characters is the sum of its parts; a
null language teaches nothing; with nothing to learn from all texts are
``und``; equal cosines go to the first language by name; a null doc_id is not
held out and teaches nothing; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import bounded_batches, crc_mod, sample_below, table

DIM = 512
N = 3
SEED = 20240101
#: Bound of the labelled sample that prototypes are learned from.
TRAIN_ROWS = 20_000
#: Texts in one block of the matrix product, characters at most before a block is closed, and n-grams bound at a time.
BLOCK_ROWS, BLOCK_CHARS, GRAMS = 128, 250_000, 8_192
#: A longer text is the sum of its parts.
PART_CHARS = 2_000_000
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_vectors(points: np.ndarray, dim: int = DIM) -> np.ndarray:
    """A row of +1 and -1 per code point, the same on every worker."""
    return np.stack([np.random.default_rng([SEED, int(p)]).integers(0, 2, dim, dtype=np.int8) * 2 - 1 for p in points]).astype(np.int8)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts with single breaks (0) between words, and each one's text."""
    joined = np.frombuffer("\0".join(["", *[t.lower().replace("\0", " ") for t in texts], ""]).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    ends = joined == 0
    owner = np.cumsum(ends) - 1
    letters = _letters()[joined]
    joined[~letters] = 0
    # a text's closing mark opens the next text, so each of the two needs its own break
    keep = letters | np.r_[True, letters[:-1]]
    return joined[keep], owner[keep]


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, codes, owners): the distinct letters, and every n-gram in order as a number over them with its text."""
    points, owner = _codes(texts)
    if len(points) < N:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    known, at = np.unique(points, return_inverse=True)
    a = len(known)
    at = at.astype(np.int64)
    # an n-gram belongs to the text of its middle letter; breaks in the middle say nothing
    middle = points[1:-1] != 0
    return known, (at[:-2] * a * a + at[1:-1] * a + at[2:])[middle], owner[1:-1][middle]


def _numbered(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, and each code's place among them."""
    if most > 8_000_000:
        return np.unique(codes, return_inverse=True)
    seen = np.zeros(most, bool)
    seen[codes] = True
    grams = np.flatnonzero(seen)
    place = np.zeros(most, np.int32)
    place[grams] = np.arange(len(grams), dtype=np.int32)
    return grams, place[codes]


def text_vectors(texts: list[str], dim: int = DIM) -> np.ndarray:
    """One bundled vector per text; zero where it has no letter.

    At most ``GRAMS`` distinct n-grams are bound at a time, so memory does not grow with an alphabet.
    """
    points, codes, owner = gram_codes(texts)
    out = np.zeros((len(texts), dim), np.float32)
    if not len(codes):
        return out
    a = len(points)
    grams, place = _numbered(codes, a**3)
    base = letter_vectors(points, dim)
    turned = [np.roll(base, N - 1 - k, axis=1) for k in range(N)]
    if len(grams) > GRAMS:
        order = np.argsort(place, kind="stable")
        place, owner = place[order], owner[order]
    for start in range(0, len(grams), GRAMS):
        some = grams[start : start + GRAMS]
        inside = slice(*np.searchsorted(place, [start, start + GRAMS])) if len(grams) > GRAMS else slice(None)
        counts = np.bincount(owner[inside] * len(some) + (place[inside] - start), minlength=len(texts) * len(some)).reshape(len(texts), len(some))
        bound = turned[0][some // (a * a)] * turned[1][some // a % a] * turned[2][some % a]
        out += counts.astype(np.float32) @ bound.astype(np.float32)
    return out


def pieces(text: str) -> list[str]:
    """A very long text in parts of at most ``PART_CHARS``, cut at blanks where there are any."""
    out, at = [], 0
    while len(text) - at > PART_CHARS:
        cut = text.rfind(" ", at + PART_CHARS // 2, at + PART_CHARS)
        cut = cut if cut > 0 else at + PART_CHARS
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def vectors(texts: list[str], dim: int = DIM) -> np.ndarray:
    """``text_vectors`` in blocks of bounded size."""
    out = np.zeros((len(texts), dim), np.float32)
    for s in blocks(texts):
        if s.stop - s.start == 1:
            out[s] = sum(text_vectors([p], dim) for p in pieces(texts[s.start]))
        else:
            out[s] = text_vectors(texts[s], dim)
    return out


def blocks(texts: list[str]) -> Iterator[slice]:
    at, chars = 0, 0
    for i, t in enumerate(texts):
        if i > at and (i - at >= BLOCK_ROWS or chars + len(t) > BLOCK_CHARS):
            yield slice(at, i)
            at, chars = i, 0
        chars += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def learn(docs: DataFrame, train_rows: int = TRAIN_ROWS, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages by name and their unit prototypes, from the rows of (text, lang) not held out."""
    eligible = bounded_batches(docs).filter((crc_mod(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = eligible.select("doc_id").count()
    if n > train_rows:
        eligible = eligible.filter(sample_below(F.col("doc_id"), train_rows / n))

    def summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for part in parts:
            rows = vectors(part["text"].tolist(), dim).astype(np.float64)
            norm = np.linalg.norm(rows, axis=1, keepdims=True)
            rows = np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)
            for lang, row in zip(part["lang"], rows, strict=True):
                total[lang] = total.get(lang, 0) + row
        if total:
            yield pd.DataFrame({"lang": list(total), "v": [list(v) for v in total.values()]})

    parts = eligible.select("text", "lang").mapInPandas(summed, "lang string, v array<double>")
    sums = _summed(parts)
    found = {r["lang"]: np.array(r["v"], float) for r in sums.collect()}
    names = sorted(found)
    if not names:
        return [], np.zeros((0, dim))
    unit = np.stack([found[x] for x in names])
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    return names, unit


def _summed(parts: DataFrame) -> DataFrame:
    """Element-wise sums of the partitions' vectors; one row per language, rounded so that order does not show."""
    each = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.round(F.sum("x"), 6).alias("x"))
    return each.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))


def classify(docs: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """``docs`` with lang_pred and score, through one narrow pass in Arrow batches."""
    dim = prototypes.shape[1] if len(names) else DIM
    kept = [F.col(c) for c in docs.columns if c not in ("lang_pred", "score")]

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(text: pd.Series) -> pd.DataFrame:
        texts = [t if isinstance(t, str) else "" for t in text.tolist()]
        best, score, lettered = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if names:
            rows = vectors(texts, dim).astype(np.float64)
            norm = np.linalg.norm(rows, axis=1)
            near = np.round(rows @ prototypes.T, 6)
            best, lettered = near.argmax(1), norm > 0
            score = np.where(lettered, near.max(1) / np.maximum(norm, 1e-12), 0.0)
        # a letter whose vectors cancel out is a letter all the same
        lettered |= [bool(names) and not ok and any(map(str.isalpha, t.lower())) for ok, t in zip(lettered, texts, strict=True)]
        return pd.DataFrame({"lang_pred": np.where(lettered, np.array([*names, UNKNOWN], object)[best], UNKNOWN), "score": np.clip(score, 0.0, 1.0)})

    out = bounded_batches(docs).select(*kept, predict("text").alias("__p"))
    return out.select(*kept, F.col("__p.lang_pred").alias("lang_pred"), F.col("__p.score").alias("score"))


def identify(docs: DataFrame, **how) -> DataFrame:
    return classify(docs, *learn(docs, **how))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    names, prototypes = learn(docs)
    out = classify(docs.select("doc_id", "text"), names, prototypes)
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
