"""Operator 6: near-duplicate embeddings by a robust-pruned flat graph.

Equal vectors are folded and counted. The others go to the shards of their
``OVERLAP`` nearest centres; in each shard every vector gets up to ``DEGREE``
robust-pruned neighbours, and a vector's lists from all its shards are united.
Each vector is then searched for in its shards on the united graph: greedily
from the shard's medoid towards it, and from what that finds (and from its own
place, as it stands in the graph) the range is expanded over all neighbours
that are near enough. What is found is verified in double precision; a pair
that two shards hold counts in the first. Shards return one row per vector, not
pairs. A sample of vectors is then compared with all rows; if of vectors with
about as many links fewer than ``AUDIT_RECALL`` were found, the search is
repeated with the shards of more sets of centres, besides those there were, so
each round searches all places of the rounds before. If the last one falls short
too, an error gives the recall.

A shard of more than ``MAX_SHARD`` vectors is searched as pairs of blocks, so no
task holds more; its work grows with the square of its size, as the links of
such a group themselves do. Up to ``MAX_CENTRES`` centres are broadcast.

Defined cases: a vector that is null, empty, zero or has a null or non-finite
component links with nothing and is its own component, kept; vectors of
different lengths do not link; repeated rows link with each other; a null
vec_id counts as a link and names a component only if all its ids are null; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import bounded_batches, materialise, sample_below, table
from tallyspark.llm.graph import components

SIMILARITY = 0.95
SHARD, MAX_SHARD, MAX_CENTRES = 500, 4096, 4096
OVERLAP = 2
#: Centres nearer than this to an earlier one are left out, so that a dense spot has one.
APART = 0.8
DEGREE, POOL, FAR = 24, 48, 8
ALPHA = 1.2
BEAM = 24
AUDIT_ROWS, AUDIT_RECALL = 2000, 0.97
#: Independent sets of centres by round; a vector is in OVERLAP shards of each set.
SETS = (1, 3, 6, 12)


def _sound(v) -> bool:
    return v is not None and len(v) > 0 and bool(np.isfinite(a := np.asarray(v, float)).all()) and bool(np.any(a))


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def robust_prune(x: np.ndarray, a: int, pool: np.ndarray, near: np.ndarray) -> list[int]:
    """Of ``pool`` (nearest first), those that no kept one is nearer to by ``ALPHA``."""
    away = np.sqrt(np.maximum(2 - 2 * near, 0.0))
    kept: list[int] = []
    alive = np.ones(len(pool), bool)
    for _ in range(DEGREE):
        left = np.flatnonzero(alive)
        if not len(left):
            break
        p = left[0]
        kept.append(int(pool[p]))
        between = np.sqrt(np.maximum(2 - 2 * (x[pool[left]] @ x[pool[p]]), 0.0))
        alive[left[ALPHA * between <= away[left]]] = False
        alive[p] = False
    return kept


def build(x: np.ndarray, seed: int = 0) -> list[set[int]]:
    """A flat graph over a shard: pruned neighbours, a few far ones, and the way back."""
    m = len(x)
    rng = np.random.default_rng(seed)
    edges: list[set[int]] = [set() for _ in range(m)]
    for s in range(0, m, 512):
        near = x[s : s + 512] @ x.T
        near[np.arange(len(near)), np.arange(s, s + len(near))] = -2.0
        k = min(POOL, m - 1)
        if k < 1:
            continue
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        far = rng.integers(0, m, (len(near), FAR))
        for i in range(len(near)):
            pool = np.unique(np.r_[top[i], far[i][far[i] != s + i]])
            order = np.lexsort((pool, -near[i, pool]))
            for b in robust_prune(x, s + i, pool[order], near[i, pool[order]]):
                edges[s + i].add(b)
    for a in range(m):
        for b in list(edges[a]):
            if len(edges[b]) < 2 * DEGREE:
                edges[b].add(a)
    return edges


def search(x: np.ndarray, graph: np.ndarray, start: int, a: int, similarity: float) -> np.ndarray:
    """Vectors within the range of ``a``. ``graph``: neighbours by row, -1 where there are fewer."""
    q = x[a]
    seen = np.zeros(len(x), bool)
    seen[start] = True
    beam, near = np.array([start]), np.array([x[start] @ q])
    done = np.zeros(1, bool)
    while not done.all():
        at = int(np.flatnonzero(~done)[near[~done].argmax()])
        done[at] = True
        more = graph[beam[at]]
        more = more[more >= 0]
        more = more[~seen[more]]
        if len(more):
            seen[more] = True
            beam, near, done = np.r_[beam, more], np.r_[near, x[more] @ q], np.r_[done, np.zeros(len(more), bool)]
            if len(beam) > BEAM:
                best = np.argpartition(-near, BEAM - 1)[:BEAM]
                beam, near, done = beam[best], near[best], done[best]
    found = np.zeros(len(x), bool)
    edge = np.unique(np.r_[beam[near >= similarity], a])
    found[edge] = True
    tried = found.copy()
    while len(edge):
        more = graph[edge].ravel()
        more = np.unique(more[more >= 0])
        more = more[~tried[more]]
        tried[more] = True
        edge = more[x[more] @ q >= similarity]
        found[edge] = True
    found[a] = False
    return np.flatnonzero(found)


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding as doubles, and the vector's key (null if it can link with nothing)."""

    @F.pandas_udf("binary")
    def key(v: pd.Series) -> pd.Series:
        return pd.Series([hashlib.md5(np.asarray(x, "<f8").tobytes()).digest() if _sound(x) else None for x in v], dtype=object)

    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("k", key("embedding"))


def representatives(vectors: DataFrame) -> DataFrame:
    """One row per distinct sound vector: k, embedding (doubles), rep, n."""
    return keyed(vectors).filter("k is not null").groupBy("k").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))


def centres(reps: DataFrame, rows: int, seed: int) -> dict[int, np.ndarray]:
    """By vector length, up to MAX_CENTRES vectors drawn by hash, none too near to another."""
    want = max(1, min(MAX_CENTRES, rows // SHARD))
    drawn = reps.orderBy(F.xxhash64(F.lit(seed), "k")).limit(want).select("embedding").collect()
    by: dict[int, list[np.ndarray]] = {}
    for r in drawn:
        v = unit([r["embedding"]])[0]
        own = by.setdefault(len(v), [])
        if not own or (np.stack(own) @ v).max() < APART:
            own.append(v)
    return {k: np.stack(v) for k, v in by.items()}


def assigned(reps: DataFrame, sets: list[dict[int, np.ndarray]]) -> DataFrame:
    """k, n, embedding and the shards of each vector in all sets (a vector length without centres is one shard)."""

    @F.pandas_udf("array<long>")
    def shards(v: pd.Series) -> pd.Series:
        out = []
        for x in v:
            base = len(x) << 32
            own = set()
            for at, found in enumerate(sets):
                c = found.get(len(x))
                if c is not None:
                    top = np.argsort(-(c @ unit([x])[0]), kind="stable")[:OVERLAP]
                    own.update(base + at * MAX_CENTRES + int(t) for t in top)
            out.append(sorted(own or {base}))
        return pd.Series(out, dtype=object)

    return reps.select("k", "n", "embedding", shards("embedding").alias("shards"))


def placed(rows: DataFrame) -> DataFrame:
    """One row per vector and place: shard and, where the shard is large, its pairs of blocks."""
    each = rows.withColumn("shard", F.explode("shards"))
    blocks = each.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) * 2 / MAX_SHARD).cast("int").alias("blocks")).withColumn("blocks", F.when(F.col("blocks") > 2, F.col("blocks")).otherwise(F.lit(1)))
    each = each.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")


def _whole_groups(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each (shard, i, j) of a sorted partition, one group at a time."""
    held: list[pd.DataFrame] = []
    now = None
    for part in parts:
        for key, rows in part.groupby(["shard", "i", "j"], sort=False):
            if key != now and held:
                yield pd.concat(held, ignore_index=True)
                held = []
            now = key
            held.append(rows)
    if held:
        yield pd.concat(held, ignore_index=True)


def _to_groups(df: DataFrame) -> DataFrame:
    return df.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "k")


def shard_graphs(places: DataFrame) -> DataFrame:
    """(k, near): each vector's neighbours in one shard, their keys packed one after another."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(parts):
            keys = [bytes(k) for k in rows["k"]]
            edges = build(unit(rows["embedding"]), int(rows["shard"].iloc[0]) & 0xFFFF)
            yield pd.DataFrame({"k": keys, "near": [b"".join(keys[b] for b in sorted(e)) for e in edges]})

    return _to_groups(places.select("shard", "i", "j", "k", "embedding")).mapInPandas(each, "k binary, near binary")


def found_links(places: DataFrame, lists: DataFrame, similarity: float) -> DataFrame:
    """(k, links, root) of every vector with links, one row per place."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(parts):
            m = len(rows)
            keys = [bytes(k) for k in rows["k"]]
            x = unit(rows["embedding"])
            at = {k: a for a, k in enumerate(keys)}
            united = [sorted({b for blob in near for p in range(0, len(blob), 16) if (b := at.get(bytes(blob[p : p + 16]))) is not None}) for near in rows["lists"]]
            graph = np.full((m, max(1, *map(len, united), 1)), -1, np.int64)
            for a, near in enumerate(united):
                graph[a, : len(near)] = near
            medoid = int((x @ x.mean(0)).argmax())
            pairs = np.zeros((m, m), bool)
            for a in range(m):
                pairs[a, search(x, graph, medoid, a, similarity)] = True
            shard, lists_of = int(rows["shard"].iloc[0]), [frozenset(map(int, s)) for s in rows["shards"]]
            others: dict[int, list[int]] = {}
            for a, z in enumerate(lists_of):
                for y in z - {shard}:
                    others.setdefault(y, []).append(a)
            # a pair that other shards hold too is compared outright, so that none finds what its first one missed
            shared = np.zeros((m, m), bool)
            for inside in others.values():
                shared[np.ix_(inside, inside)] = True
            for s in range(0, m, 512):
                pairs[s : s + 512] |= shared[s : s + 512] & (x[s : s + 512] @ x.T >= similarity)
            np.fill_diagonal(pairs, False)
            pairs |= pairs.T
            i, j, block = int(rows["i"].iloc[0]), int(rows["j"].iloc[0]), rows["block"].to_numpy()
            if i != j:
                pairs &= block[:, None] != block[None, :]
            owned = pairs.copy()
            # a pair counts in the first of the shards that both are in
            for s, inside in others.items():
                if s < shard:
                    owned[np.ix_(inside, inside)] = False
            links = owned @ rows["n"].to_numpy().astype(float)
            root = np.full(m, -1)
            for a in range(m):
                if root[a] < 0 and pairs[a].any():
                    edge = np.array([a])
                    while len(edge):
                        root[edge] = a
                        edge = np.flatnonzero(pairs[edge].any(0) & (root < 0))
            linked = np.flatnonzero(root >= 0)
            yield pd.DataFrame({"k": [keys[a] for a in linked], "links": links[linked].round().astype(np.int64), "root": [keys[root[a]] for a in linked]})

    rows = places.join(lists, "k").select("shard", "i", "j", "k", "n", "block", "embedding", "shards", "lists")
    return _to_groups(rows).mapInPandas(each, "k binary, links long, root binary")


def audited_recall(reps: DataFrame, links: DataFrame, rows: int, similarity: float) -> float:
    """The least recall of a bounded sample against all rows: the mean over the vectors of each
    order of magnitude of links, so that a large group does not cover up for the others."""
    sample = reps.filter(sample_below(F.col("k"), AUDIT_ROWS / max(rows, 1))).select("k", "embedding", "n").limit(4 * AUDIT_ROWS).collect()
    if not sample:
        return 1.0
    by: dict[int, tuple[list[int], np.ndarray]] = {}
    for d in {len(r["embedding"]) for r in sample}:
        own = [a for a, r in enumerate(sample) if len(r["embedding"]) == d]
        by[d] = (own, unit([sample[a]["embedding"] for a in own]))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(sample), np.int64)
        for part in parts:
            for d, (own, q) in by.items():
                same = part[[len(v) == d for v in part["embedding"]]]
                if len(same):
                    total[own] += ((unit(same["embedding"]) @ q.T >= similarity) * same["n"].to_numpy()[:, None]).sum(0)
        yield pd.DataFrame({"a": np.flatnonzero(total), "true": total[total > 0]})

    true = reps.select("embedding", "n").mapInPandas(count, "a int, true long").groupBy("a").agg(F.sum("true").alias("true")).collect()
    expected = {r["a"]: r["true"] - sample[r["a"]]["n"] for r in true}
    keys = reps.sparkSession.createDataFrame([(a, bytes(r["k"])) for a, r in enumerate(sample)], "a int, k binary")
    got = {r["a"]: r["links"] for r in links.join(F.broadcast(keys), "k").select("a", "links").collect()}
    strata: dict[int, list[float]] = {}
    for a, n in expected.items():
        if n > 0:
            strata.setdefault(len(str(n)), []).append(min(got.get(a, 0), n) / n)
    return min((sum(s) / len(s) for s in strata.values()), default=1.0)


def link(vectors: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    vectors = bounded_batches(vectors).select("vec_id", "embedding")
    reps = materialise(representatives(vectors), "vectors")
    rows = reps.count()
    sets: list[dict[int, np.ndarray]] = []
    for many in SETS:
        sets += [centres(reps, rows, seed) for seed in range(len(sets), many)]
        places = materialise(placed(assigned(reps, sets)), "places")
        lists = shard_graphs(places).groupBy("k").agg(F.collect_list("near").alias("lists"))
        found = materialise(found_links(places, lists, similarity), "found")
        links = found.groupBy("k").agg(F.sum("links").alias("links"))
        recall = audited_recall(reps, links, rows, similarity)
        if recall >= AUDIT_RECALL:
            break
    else:
        raise RuntimeError(f"near-duplicate vectors: recall {recall:.3f} of the audited sample is below {AUDIT_RECALL} with {len(sets)} sets of centres")
    roots = components(found.select(F.col("k").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("k"), "root")
    whole = reps.select("k", "rep", "n").join(links, "k", "left").join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    whole = whole.join(whole.groupBy("root").agg(F.min("rep").alias("component_id")), "root")
    whole = whole.select("k", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    each = keyed(vectors).select("vec_id", "k").join(whole, "k", "left")
    alone = F.col("n_links").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return each.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op6_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = r"""
WITH RECURSIVE sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id)::BIGINT AS n_links, min(r.b) AS component_id, min(r.b) = e.vec_id AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id
"""
