"""Operator 11: hard negatives by a norm-bucketed search.

Components are scaled to integers, so scores are exact. Two searches of one kind
run: anchors against the rows of their label (their positives), then anchors with
one score window per positive against the rows of other labels. In each, anchors
are dealt in blocks and candidates in lanes; a task gets one block and one lane,
its candidates sorted by norm, longest first. It reads them in buckets: no score
in a bucket is above the anchor's norm times the bucket's largest norm
(Cauchy-Schwarz), so once that is under the lower limit of every window, or under
the running k-th score of windows that are full, the anchor is done with this
lane, as later buckets are shorter still. The best of all lanes are merged by
windowed ranks; a task returns at most k rows a window.

Lanes hold about ``LANE_ROWS`` candidates dealt by a hash, so every lane starts
with long vectors whatever the norms are, and a label of a third of all rows is
many lanes and blocks. A task keeps one block of anchors and one bucket.

Defined cases: rows with a null label, vec_id or vector, or a null or non-finite
component, take no part; an empty vector has score 0 with its like; vectors of
different lengths are not compared; repeated rows are rows of their own, so a
copy of an anchor can be its positive; an empty table gives an empty table; other
columns are ignored. Scores that leave 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import bounded_batches, checkpointed, materialise, table

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative scores at least this many hundredths of the positive, and not more than it.
LOWER_PERCENT = 80
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
#: A block of anchors has about so many components, a lane so many candidates.
BLOCK_CELLS, LANE_ROWS = 1 << 20, 16_384
#: The table of families is broadcast up to this many rows (some 30 bytes each), else joined by a shuffle.
BROADCAST_FAMILIES = 100_000
#: The first bucket of a lane is small, to fill the windows; the others hold this many candidates.
FIRST_BUCKET, BUCKET = 128, 1024
#: Anchors multiplied with a bucket at a time.
AT_ONCE = 2048
EXACT = float(1 << 53)
KEYS = ["family", "block", "lane"]
ANCHOR, CANDIDATE = 0, 1


def prepared(vectors: DataFrame, relabel_every: int | None = RELABEL_EVERY) -> DataFrame:
    """uid, vec_id, label, v (integral doubles), norm of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    unsound = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~unsound)
    if relabel_every:
        rows = rows.withColumn("label", F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))
    scaled = F.transform("x", lambda c: c * F.lit(float(SCALE)))
    # doubles of this size on are integers already
    whole = F.transform(scaled, lambda c: F.when(F.abs(c) < F.lit(EXACT), F.floor(c).cast("double")).otherwise(c))
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", whole.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of integral doubles, exact."""
    most = q.shape[1] * float(np.abs(q).max(initial=0.0)) * float(np.abs(c).max(initial=0.0))
    if most < EXACT:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in q], object).reshape(q.shape) @ np.array([[int(x) for x in row] for row in c], object).reshape(c.shape).T
    if any(abs(s) >= 1 << 63 for s in exact.ravel()):
        raise OverflowError("hard negatives: an inner product does not fit in 64 bits")
    return exact.astype(np.int64)


class Windows:
    """The running best k of every (anchor, window), and which anchors still need candidates.

    ``low`` and ``high`` are (anchors, windows); a window without room is closed.
    """

    def __init__(self, q: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.q, self.norms, self.low, self.high, self.k = q, norms, low, high, k
        self.score = np.full((*low.shape, k), np.iinfo(np.int64).min)
        self.id = np.full((*low.shape, k), np.iinfo(np.int64).max)
        self.n = np.zeros(low.shape, np.int64)
        self.need = self._need()
        self.compared = 0

    def _need(self) -> np.ndarray:
        """The least score that an anchor's windows still take, as a double no larger than it."""
        kth = np.where(self.n == self.k, self.score[:, :, -1], np.iinfo(np.int64).min)
        least = np.where(self.low <= self.high, np.maximum(self.low, kth).astype(float), np.inf)
        return least.min(1, initial=np.inf)

    def live(self, longest: float) -> np.ndarray:
        """Anchors that a vector of this norm could still serve; the bound is widened by more than rounding errors."""
        bound = np.nan_to_num(self.norms * longest, nan=np.inf, posinf=np.inf) * (1 + 1e-9) + 1e-9
        return np.flatnonzero((self.need < np.inf) & (bound >= self.need * (1 - np.sign(self.need) * 1e-9)))

    def add(self, vectors: np.ndarray, ids: np.ndarray, longest: float, allowed) -> None:
        """Take a bucket; ``allowed(anchors)`` is the (anchors, candidates) mask of pairs that may count."""
        live = self.live(longest)
        for s in range(0, len(live), AT_ONCE):
            a = live[s : s + AT_ONCE]
            scores, may = products(self.q[a], vectors), allowed(a)
            self.compared += scores.size
            for w in range(self.low.shape[1]):
                full = self.n[a, w] == self.k
                kth = np.where(full, self.score[a, w, -1], np.iinfo(np.int64).min)
                i, j = np.nonzero(may & (scores >= np.maximum(self.low[a, w], kth)[:, None]) & (scores <= self.high[a, w][:, None]))
                if len(i):
                    self._merge(a, w, i, scores[i, j], ids[j])
        self.need = self._need()

    def _merge(self, a: np.ndarray, w: int, i: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        own = np.unique(i)
        at = a[own]
        held = np.arange(self.k)[None, :] < self.n[at, w][:, None]
        row = np.r_[np.repeat(own, held.sum(1)), i]
        score, ids = np.r_[self.score[at, w][held], score], np.r_[self.id[at, w][held], ids]
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
        keep = rank < self.k
        self.score[a[row[keep]], w, rank[keep]], self.id[a[row[keep]], w, rank[keep]] = score[keep], ids[keep]
        self.n[a[own], w] = np.minimum(np.diff(np.r_[starts, len(row)]), self.k)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float).reshape(len(vectors), -1)


class _Task:
    """One block of anchors meeting one lane of candidates."""

    def __init__(self, same_label: bool, k: int):
        self.same_label, self.k = same_label, k
        self.anchors: list[pd.DataFrame] = []
        self.waiting: list[pd.DataFrame] = []
        self.rows, self.bucket = 0, FIRST_BUCKET
        self.windows: Windows | None = None

    def take(self, rows: pd.DataFrame) -> None:
        candidate = rows["kind"].to_numpy() == CANDIDATE
        if (~candidate).any():
            self.anchors.append(rows[~candidate])
        if candidate.any():
            self.waiting.append(rows[candidate])
            self.rows += int(candidate.sum())
            while self.rows >= self.bucket:
                self._add(self.bucket)
                self.bucket = BUCKET

    def _open(self) -> None:
        own = pd.concat(self.anchors, ignore_index=True)
        self.anchors = []
        self.uid, self.label = own["uid"].to_numpy(), own["label"].to_numpy()
        low, high = np.ones((2, len(own), max(map(len, own["low"]))), np.int64)
        high[:] = 0  # places without a window are closed
        for a, (lows, highs) in enumerate(zip(own["low"], own["high"], strict=True)):
            low[a, : len(lows)], high[a, : len(highs)] = lows, highs
        self.windows = Windows(_matrix(own["v"]), own["norm"].to_numpy(), low, high, self.k)

    def _add(self, n: int) -> None:
        if self.windows is None:
            if not self.anchors:
                self.waiting, self.rows = [], 0
                return
            self._open()
        held = pd.concat(self.waiting, ignore_index=True)
        rows = held.iloc[:n]
        self.waiting, self.rows = [held.iloc[n:]], len(held) - len(rows)
        uid, label = rows["uid"].to_numpy(), rows["label"].to_numpy()

        def allowed(a: np.ndarray) -> np.ndarray:
            return uid[None, :] != self.uid[a][:, None] if self.same_label else label[None, :] != self.label[a][:, None]

        self.windows.add(_matrix(rows["v"]), rows["vec_id"].to_numpy(), float(rows["norm"].max()), allowed)

    def result(self) -> pd.DataFrame:
        if self.rows:
            self._add(self.rows)
        if self.windows is None:
            return pd.DataFrame({"anchor": [], "window": [], "vec_id": [], "score": []}).astype({"anchor": "int64", "window": "int32", "vec_id": "int64", "score": "int64"})
        w = self.windows
        a, at, rank = np.nonzero(np.arange(w.k)[None, None, :] < w.n[:, :, None])
        return pd.DataFrame({"anchor": self.uid[a], "window": at.astype(np.int32), "vec_id": w.id[a, at, rank], "score": w.score[a, at, rank]})


def _shares(anchors: DataFrame, rows: DataFrame, family: Column) -> DataFrame:
    """Into how many blocks and lanes each family that has anchors is dealt."""
    blocks = anchors.groupBy(family.alias("family")).agg(F.ceil(F.sum(F.greatest(F.size("v"), F.lit(1))) / BLOCK_CELLS).cast("int").alias("blocks"))
    lanes = rows.groupBy(family.alias("family")).agg(F.ceil(F.count(F.lit(1)) / LANE_ROWS).cast("int").alias("lanes"))
    found = checkpointed(blocks.join(lanes, "family"))
    return F.broadcast(found) if found.count() <= BROADCAST_FAMILIES else found


def search(anchors: DataFrame, rows: DataFrame, family: Column, same_label: bool, k: int) -> DataFrame:
    """The best k of ``rows`` in every window of every anchor: anchor (uid), window, vec_id, score, rank.

    ``anchors``: uid, label, v, norm and the arrays low and high, one window a
    place. Only rows of one family meet.
    """
    spread = _shares(anchors, rows, family)
    none = F.lit(None).cast("array<long>")
    left = anchors.withColumn("family", family).join(spread, "family").withColumns({"block": F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"), "lane": F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))})
    right = rows.withColumn("family", family).join(spread, "family").withColumns({"lane": F.pmod(F.xxhash64("uid"), F.col("lanes")).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    left = left.select(*KEYS, F.lit(ANCHOR).alias("kind"), "uid", F.lit(0).cast("long").alias("vec_id"), "label", "v", "norm", "low", "high")
    right = right.select(*KEYS, F.lit(CANDIDATE).alias("kind"), "uid", "vec_id", "label", "v", "norm", none.alias("low"), none.alias("high"))
    dealt = left.unionByName(right).repartition(*KEYS).sortWithinPartitions(*KEYS, "kind", F.col("norm").desc(), "uid")

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, task = None, None
        for part in parts:
            for key, own in part.groupby(KEYS, sort=False):
                if key != now:
                    if task is not None:
                        yield task.result()
                    now, task = key, _Task(same_label, k)
                task.take(own)
        if task is not None:
            yield task.result()

    found = dealt.mapInPandas(each, "anchor long, window int, vec_id long, score long")
    best = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor_every: int = ANCHOR_EVERY, relabel_every: int | None = RELABEL_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, lower_percent: int = LOWER_PERCENT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = materialise(prepared(bounded_batches(vectors), relabel_every), "vectors")
    anchors = rows.filter(F.col("vec_id") % anchor_every == 0)
    size = F.size("v").cast("string")
    open_end = F.lit(int(np.iinfo(np.int64).max))
    first = anchors.withColumns({"low": F.array(-open_end), "high": F.array(open_end)})
    found = search(first, rows, F.concat_ws(":", size, F.col("label").cast("string")), True, positives)
    found = materialise(found.select("anchor", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    own = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))).alias("own"))
    low = F.transform("own", lambda p: F.ceil(p["positive_score"].cast("decimal(20,0)") * F.lit(lower_percent) / F.lit(100)).cast("long"))
    second = anchors.join(own.select(F.col("anchor").alias("uid"), low.alias("low"), F.col("own.positive_score").alias("high")), "uid")
    hard = search(second, rows, size, False, negatives)
    hard = hard.select("anchor", (F.col("window") + 1).alias("at"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    named = found.withColumnRenamed("rank", "at").join(anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.join(hard, ["anchor", "at"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


SQL = r"""
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS uid
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.uid AS anchor, a.vec_id AS anchor_id, b.uid AS uid, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM sound a JOIN sound b ON a.vec_id % 100 = 0 AND a.uid <> b.uid AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor, anchor_id, uid, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor, p.uid ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""
