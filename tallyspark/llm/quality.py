"""Operator 5: a quality classifier from document statistics.

Twenty statistics of a text are standardised and mapped to random Fourier
features, which approximate a Gaussian kernel; ridge regression on them is
solved from normal equations that each partition sums for its rows; isotonic
calibration turns the raw score into the chance of label 1. It is fitted on raw
scores that each half of the sample gets from the equations of the other half,
so that it sees scores as new documents have them.

It learns from at most about ``TRAIN_ROWS`` labelled documents, drawn by a hash
of doc_id from those whose crc32(doc_id) mod 5 is not 0. The sample is small
enough to broadcast, so learning scans the documents and moves only the sample;
scoring is one narrow pass over all documents.

Defined cases: a null text is empty, and an empty text is scored like any other
(all its statistics are 0); labels that are null teach nothing and of several
labels for a document the largest holds; with nothing to learn from every score
is 0.5; a null doc_id is not held out and teaches nothing; repeated rows give
repeated rows; columns named like a result column are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import bounded_batches, checkpointed, crc_mod, sample_below, table

#: Bound of the labelled sample.
TRAIN_ROWS = 20_000
#: Width and ridge were chosen on rows with crc32(doc_id) mod 5 = 1, learning from 2, 3 and 4
FEATURES = 320
WIDTH = 8.0
RIDGE = 1e-2
SEED = 7
THRESHOLD = 0.3
#: Raw scores are counted in steps of this size between these ends before calibration.
STEP, LOW, HIGH = 0.002, -1.0, 2.0
#: Share of the raw score in the result, so that ties of the calibration keep their order.
TILT = 0.001
#: Tasks that sum normal equations; each moves two matrices of FEATURES squared cells.
PARTS = 8
N_STATS = 20


def statistics(text: str) -> list[float]:
    """Twenty numbers that say how a text is made, none of them of its language."""
    n = len(text)
    if not n:
        return [0.0] * N_STATS
    words = text.split()
    w = len(words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ascii_ = np.bincount(np.minimum(codes, 128), minlength=129)
    upper, lower, digits = ascii_[65:91].sum(), ascii_[97:123].sum(), ascii_[48:58].sum()
    spaces = ascii_[32] + ascii_[9:14].sum()
    marks = ascii_[33:48].sum() + ascii_[58:65].sum() + ascii_[91:97].sum() + ascii_[123:127].sum()
    commas = ascii_[44] + ascii_[46]
    odd = marks - commas - ascii_[39] - ascii_[45] - ascii_[34]
    share = ascii_[ascii_ > 0] / n
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, w)
    lines = [x for x in text.split("\n") if x.strip()]
    top = counts.most_common(1)[0][1] if w else 0
    same = sum(map(str.__eq__, words, words[1:])) if w > 1 else 0
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(n), np.log1p(w), lengths.mean() if w else 0.0, lengths.std() if w else 0.0, np.log1p(lengths.max()) if w else 0.0,
        upper / n, lower / n, digits / n, ascii_[128] / n, spaces / n, odd / n, commas / n, ascii_[33] / n, ascii_[124] / n,
        -(share * np.log(share)).sum(), len(counts) / w if w else 0.0, top / w if w else 0.0, same / w if w else 0.0,
        pairs / (w - 1) if w > 1 else 0.0, len(set(lines)) / len(lines) if lines else 0.0,
    ]


def all_statistics(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t if isinstance(t, str) else "") for t in texts], float).reshape(len(texts), N_STATS)


@dataclass
class Model:
    """Everything that scoring needs; a few hundred kilobytes at most."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    chances: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.mean, self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(stats), 0.5)
        raw = self.raw(stats)
        level = np.clip((raw - LOW) / (HIGH - LOW), 0.0, 1.0)
        chance = np.interp(raw, self.steps, self.chances)
        return np.round(np.clip((1 - TILT) * chance + TILT * level, 0.0, 1.0), 8)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel, and a constant."""
    rng = np.random.default_rng(SEED)
    turn = rng.normal(0.0, 1.0 / WIDTH, (stats.shape[1], FEATURES))
    shift = rng.uniform(0.0, 2 * np.pi, FEATURES)
    z = np.clip((stats - mean) / scale, -8.0, 8.0)
    return np.hstack([np.sqrt(2.0 / FEATURES) * np.cos(z @ turn + shift), np.ones((len(z), 1))])


def isotonic(values: np.ndarray, hits: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over increasing values; the pooled centres and shares."""
    pools: list[list[float]] = []
    for v, h, c in zip(values, hits, counts, strict=True):
        pools.append([v * c, h, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    p = np.array(pools, float).reshape(-1, 3)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def half_of(doc_id) -> Column:
    return F.pmod(F.xxhash64(F.lit("half"), doc_id), F.lit(2)).cast("int")


def solved(sums: np.ndarray, rows: float) -> np.ndarray:
    """Ridge weights from normal equations with the right side as last column."""
    penalty = RIDGE * rows / FEATURES * np.eye(FEATURES + 1)
    penalty[-1, -1] = 0.0
    return np.linalg.lstsq(sums[:, :-1] + penalty, sums[:, -1], rcond=None)[0]


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> Model:
    known = labels.filter(F.col(label).isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0)).select(F.col("doc_id"), F.col(label).alias("y"))
    n = known.count()
    fraction = train_rows / n if n > train_rows else 1.0
    drawn = known.filter(sample_below(F.col("doc_id"), fraction)).groupBy("doc_id").agg(F.max("y").cast("double").alias("y"))
    texts = bounded_batches(docs).select("doc_id", "text").filter((crc_mod(F.col("doc_id"), 5) != 0) & sample_below(F.col("doc_id"), fraction))

    @F.pandas_udf("array<double>")
    def measured(text: pd.Series) -> pd.Series:
        return pd.Series(list(all_statistics(text.tolist())))

    # at most about train_rows narrow rows: a bound that holds whatever the corpus
    sample = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "y", half_of(F.col("doc_id")).alias("half"), measured("text").alias("x"))
    sample = checkpointed(sample.repartition(PARTS, "doc_id"))
    moments = sample.agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.round(F.avg(F.col("x")[i]), 9) for i in range(N_STATS)]).alias("mean"),
        F.array(*[F.round(F.stddev_pop(F.col("x")[i]), 9) for i in range(N_STATS)]).alias("sd"),
    ).first()
    none = np.zeros(0)
    if not moments["n"]:
        return Model(none, none, none, none, none)
    mean, scale = np.array(moments["mean"]), np.maximum(np.array(moments["sd"]), 1e-6)

    def normal_equations(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, FEATURES + 1, FEATURES + 2))
        for part in parts:
            for half, rows in part.groupby("half"):
                z = fourier(np.stack(rows["x"].to_numpy()), mean, scale)
                total[half] += z.T @ np.hstack([z, rows["y"].to_numpy()[:, None]])
        for half in np.flatnonzero(total.any((1, 2))):
            yield pd.DataFrame({"half": half, "i": np.arange(FEATURES + 1), "v": list(total[half])})

    # at most PARTS matrices are added up element by element, whatever the session's number of shuffle partitions; the driver gets two of fixed size
    cells = sample.coalesce(PARTS).mapInPandas(normal_equations, "half int, i int, v array<double>").select("half", "i", F.posexplode("v").alias("j", "v"))
    lines = cells.groupBy("half", "i", "j").agg(F.round(F.sum("v"), 9).alias("v")).groupBy("half", "i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("v"))
    sums = np.zeros((2, FEATURES + 1, FEATURES + 2))
    for r in lines.select("half", "i", F.col("v.v").alias("v")).collect():
        sums[r["half"], r["i"]] = r["v"]
    # the constant is the last feature, so its own sum is the number of rows
    many = sums[:, -1, -2]
    weights = solved(sums.sum(0), many.sum())
    other = [solved(sums[1 - h], many[1 - h]) if many.min() > 0 else weights for h in (0, 1)]

    @F.pandas_udf("long")
    def stepped(x: pd.Series, half: pd.Series) -> pd.Series:
        z = fourier(np.stack(x.to_numpy()), mean, scale)
        raw = np.where(half.to_numpy() == 0, z @ other[0], z @ other[1])
        return pd.Series(np.round((np.clip(raw, LOW, HIGH) - LOW) / STEP).astype(np.int64))

    # at most (HIGH - LOW) / STEP rows
    steps = sample.select(stepped("x", "half").alias("step"), "y").groupBy("step").agg(F.sum("y").alias("hits"), F.count("y").alias("n")).orderBy("step").collect()
    centres, chances = isotonic(np.array([LOW + STEP * r["step"] for r in steps]), np.array([r["hits"] for r in steps]), np.array([r["n"] for r in steps]))
    return Model(mean, scale, weights, centres, chances)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(all_statistics(text.tolist())))

    return bounded_batches(docs).withColumn("score", score("text"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, learn(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
