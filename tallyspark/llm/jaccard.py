"""Operator 10: n-gram Jaccard join with a MinHash LSH forest.

Texts are sets of five-word shingles. A text's signature is ``TREES`` strings of
``DEPTH`` MinHash bytes; each string is a path in one tree of the forest. All
paths are sorted in one range-partitioned pass, so that a tree's texts stand in
the order of its prefix trie and those that share a prefix are neighbours.

Two texts are candidates if they share a prefix of some tree that is as long as
the shorter of their two prefix lengths. Prefixes begin at full depth and are
shortened by what the data need: a bounded sample of texts is compared exactly
with all texts on the way (``Audit``), and for each class of text lengths the
longest prefix is taken at which the links that the sample really has would be
found with probability ``RECALL``. After verification the links found are
counted against the sample's; a class under ``AUDIT_RECALL`` is shortened
further and all is done again, and an error tells of one that stays under it.

Equal texts are folded first and counted. Candidates are not listed as pairs:
neighbours in the sorted tries are joined into groups, each group's shingle sets
are sent to one place (in blocks of ``BLOCK`` against each other where a group
is larger), and there the candidate pairs are verified exactly. A block returns
one row per text: its number of links and the least text it is connected with.

Defined cases: words are runs of letters and digits of the lower-cased text;
fewer than five words make one shingle of all; a text without words (null,
empty, marks only) links with nothing and is a class of its own; repeated rows
are copies of each other; a null doc_id counts as a link but never names a
class unless all ids of the class are null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import bounded_batches, discard, materialise, sample_below, table
from tallyspark.llm.graph import components
from tallyspark.llm.words import mixed, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
TREES, DEPTH = 32, 8
#: Probability with which the audited links are to be found, and the measured share below which prefixes are shortened again.
RECALL, AUDIT_RECALL = 0.999, 0.99
#: Texts compared with all others: about so many of all, and of those of at least LONG_CHARS characters; and the
#: shingles of the long ones together. They bound what is sent to every task.
AUDIT_TEXTS, LONG_TEXTS, LONG_SHINGLES = 300, 60, 1 << 20
#: Texts of up to so many shingles form a class with a prefix length of its own; longer ones are the last class.
CLASSES = (32, 256, 4096)
#: A text of more than 4,096 shingles has at least so many characters.
LONG_CHARS = 2 * CLASSES[-1]
#: Shingles of so many texts are compared with the sample at a time.
AT_ONCE = 128
#: Texts of a group that are compared with each other in one task, and the bytes of their shingles; larger groups are compared block by block.
BLOCK, BLOCK_BYTES = 2048, 64 << 20
#: Keys of group members that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
SEED = 11
#: Similarities of audited links are kept in steps of 1 / STEPS.
STEPS = 100


def meeting(similarity, length: int, trees: int = TREES):
    """The probability that two texts share a prefix of this length in some tree."""
    return 1 - (1 - similarity**length) ** trees


@lru_cache(4)
def _hashes(trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = trees * depth
    return (rng.integers(0, 1 << 31, n, dtype=np.uint32) * 2 + 1)[:, None], rng.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    words = word_hashes(text)
    if not len(words):
        return words
    if len(words) < size:
        size = len(words)
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k]
    return np.unique(mixed(total))


def signature(marks: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> bytes:
    """trees x depth MinHash bytes."""
    a, b = _hashes(trees, depth)
    x = (marks >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for s in range(0, len(x), 4096):
        np.minimum(least, (x[s : s + 4096] * a + b).min(1), out=least)
    return (least * np.uint32(2654435761) >> np.uint32(24)).astype(np.uint8).tobytes()


def key_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


@dataclass
class Audit:
    """A sample of distinct texts: their keys, sizes, and all their shingles sorted with the text of each."""

    keys: list[bytes]
    sizes: np.ndarray
    marks: np.ndarray
    owner: np.ndarray

    def __post_init__(self):
        self.first = np.flatnonzero(np.r_[True, self.marks[1:] != self.marks[:-1]]) if len(self.marks) else np.zeros(0, np.int64)
        self.known, self.many = self.marks[self.first], np.diff(np.r_[self.first, len(self.marks)])

    def links(self, sets: list[np.ndarray], keys: list[bytes], similarity: float) -> list[list[int]]:
        """For each text the sampled ones it is linked with, as sample * (STEPS + 1) + similarity in steps."""
        out: list[list[int]] = [[] for _ in sets]
        if not len(self.known):
            return out
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        at = np.minimum(np.searchsorted(self.known, flat), len(self.known) - 1)
        hit = np.flatnonzero(self.known[at] == flat)
        at, text = at[hit], np.repeat(np.arange(len(sets)), sizes)[hit]
        # some texts at a time, so that no more than about a million shared shingles are listed at once
        done = np.cumsum(self.many[at]) // 1_000_000
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(done[np.searchsorted(text, text, "right") - 1])) + 1) if len(at) else []:
            many = self.many[at[part]]
            owner = self.owner[np.repeat(self.first[at[part]] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())]
            low, m = text[part[0]], len(self.keys)
            shared = np.bincount((np.repeat(text[part], many) - low) * m + owner.astype(np.int64)).astype(np.int64)
            seen = np.flatnonzero(shared)
            t, i = seen // m + low, seen % m
            near = shared[seen] / (self.sizes[i] + sizes[t] - shared[seen])
            for a, b, s in zip(t[near >= similarity], i[near >= similarity], near[near >= similarity], strict=True):
                if self.keys[b] != keys[a]:
                    out[a].append(int(b) * (STEPS + 1) + int(s * STEPS))
        return out


def audit_sample(docs: DataFrame) -> Audit:
    """About ``AUDIT_TEXTS`` distinct texts drawn by the hash of their key, and more of the long ones, which are rare.

    Long texts of any length are taken, in the order of their hash, until they
    have ``LONG_SHINGLES`` together; the first is taken whatever its length.
    """
    long = F.coalesce(F.length("text") >= LONG_CHARS, F.lit(False))
    rows, many = docs.agg(F.count(F.lit(1)), F.count_if(long)).first()

    @F.pandas_udf("binary")
    def marks_of(text: pd.Series) -> pd.Series:
        return pd.Series([shingles(t).tobytes() for t in text], dtype=object)

    share = AUDIT_TEXTS / max(rows, 1)
    keyed = docs.select(key_of(F.col("text")).alias("k"), "text", long.alias("long"))
    drawn = keyed.filter(F.when(F.col("long"), sample_below(F.col("k"), max(share, LONG_TEXTS / max(many, 1)))).otherwise(sample_below(F.col("k"), share)))
    each = drawn.groupBy("k").agg(F.first("text").alias("text"), F.first("long").alias("long")).select("k", "long", marks_of("text").alias("marks")).filter(F.length("marks") > 0)
    short = each.filter("not long").orderBy("k").limit(2 * AUDIT_TEXTS).select("k", "marks")
    before = F.sum(F.length("marks") / 8).over(Window.partitionBy("long").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    longer = each.filter("long").orderBy("k").limit(2 * (AUDIT_TEXTS + LONG_TEXTS)).withColumn("before", F.coalesce(before, F.lit(0.0))).filter(F.col("before") + F.when(F.col("before") > 0, F.length("marks") / 8).otherwise(0) <= LONG_SHINGLES)
    found = sorted(short.unionByName(longer.select("k", "marks")).collect(), key=lambda r: bytes(r["k"]))
    sets = [np.frombuffer(bytes(r["marks"]), np.uint64) for r in found]
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    return Audit([bytes(r["k"]) for r in found], sizes, flat[order], np.repeat(np.arange(len(sets), dtype=np.int16), sizes)[order])


def representatives(docs: DataFrame, audit: Audit, similarity: float) -> DataFrame:
    """One row per distinct text that has words: k, rep (its least doc_id), n (its copies), sig, audited (its links in the sample)."""

    @F.pandas_udf("struct<sig:binary,size:int,audited:array<int>>")
    def read(text: pd.Series, key: pd.Series) -> pd.DataFrame:
        sets = [shingles(t) for t in text]
        return pd.DataFrame({
            "sig": pd.Series([signature(s) if len(s) else None for s in sets], dtype=object),
            "size": [len(s) for s in sets],
            "audited": pd.Series([x for s in range(0, len(sets), AT_ONCE) for x in audit.links(sets[s : s + AT_ONCE], [bytes(k) for k in key[s : s + AT_ONCE]], similarity)], dtype=object),
        })

    keyed = docs.select("doc_id", "text", key_of(F.col("text")).alias("k"))
    signed = keyed.select("doc_id", "k", read("text", "k").alias("r")).select("doc_id", "k", "r.*").filter("sig is not null")
    return signed.groupBy("k").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig"), F.first("size").alias("size"), F.first("audited").alias("audited"))


def audited_links(reps: DataFrame) -> dict[int, dict[int, int]]:
    """By sampled text, how many other rows it is truly linked with at each similarity step; a few thousand numbers at most."""
    rows = reps.select("n", F.explode("audited").alias("code")).groupBy("code").agg(F.sum("n").alias("n")).collect()
    out: dict[int, dict[int, int]] = {}
    for r in rows:
        out.setdefault(r["code"] // (STEPS + 1), {})[r["code"] % (STEPS + 1)] = r["n"]
    return out


def class_of(sizes):
    return np.digitize(sizes, CLASSES, right=True)


def _by_stratum(audit: Audit, true: dict[int, dict[int, int]], share) -> dict[int, float]:
    """By class of lengths, the least mean share over texts of about as many links, so that a large group covers up for nobody."""
    strata: dict[tuple[int, int], list[float]] = {}
    for a, steps in true.items():
        strata.setdefault((int(class_of(audit.sizes[a])), len(str(sum(steps.values())))), []).append(share(a, steps))
    out: dict[int, float] = {}
    for (c, _), shares in strata.items():
        out[c] = min(out.get(c, 1.0), sum(shares) / len(shares))
    return out


def prefix_lengths(audit: Audit, true: dict[int, dict[int, int]], similarity: float = SIMILARITY, recall: float = RECALL) -> list[int]:
    """For each class the longest prefix at which its audited links, or links at the threshold if it has none, are found."""
    out = [0] * (len(CLASSES) + 1)
    for length in range(DEPTH, 0, -1):
        found = _by_stratum(audit, true, lambda a, steps, d=length: sum(n * meeting(max(s / STEPS, similarity), d) for s, n in steps.items()) / sum(steps.values()))
        for c, now in enumerate(out):
            if not now and (found.get(c, meeting(similarity, length)) >= recall or length == 1):
                out[c] = length
    return out


def measured_recall(audit: Audit, true: dict[int, dict[int, int]], links: DataFrame) -> dict[int, float]:
    """By class, the share of the sample's links that verification has found."""
    if not true:
        return {}
    keys = links.sparkSession.createDataFrame([(a, audit.keys[a]) for a in true], "a int, k binary")
    got = {r["a"]: r["links"] for r in links.join(F.broadcast(keys), "k").select("a", "links").collect()}
    return _by_stratum(audit, true, lambda a, steps: min(got.get(a, 0) / sum(steps.values()), 1.0))


_ROW = 1 + DEPTH + 16


def trie_neighbours(reps: DataFrame, length: int) -> DataFrame:
    """(a, b): texts that stand next to each other in a tree's sorted paths and share a prefix of this length.

    One binary holds tree, path and text, so ranges of the sort split even the
    texts of one path. Where a range ends, its last and the next one's first row
    are compared on the driver: two rows a partition.
    """
    tree = reps.select("k", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t"))
    path = F.concat(F.expr("unhex(lpad(hex(t), 2, '0'))"), F.expr(f"substring(sig, t * {DEPTH} + 1, {DEPTH})"), F.col("k"))
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("part", pa.int32()), ("last", pa.bool_())])

    def fixed(rows: np.ndarray) -> pa.Array:
        ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])

    def batch(a: np.ndarray, b: np.ndarray, last: bool | None = None) -> pa.RecordBatch:
        part = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays([fixed(a), fixed(b), pa.array([part] * len(a), pa.int32()), pa.array([last] * len(a), pa.bool_())], schema=schema)

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for part in parts:
            if not part.num_rows:
                continue
            col = part.column(0)
            ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
            rows = np.frombuffer(col.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, _ROW)
            if before is None:
                yield batch(rows[:1], rows[:1], False)
                prev = np.vstack([rows[:1], rows[:-1]])
                prev[0, 0] ^= 0xFF
            else:
                prev = np.vstack([before, rows[:-1]])
            same = (rows[:, : 1 + length] == prev[:, : 1 + length]).all(1)
            if same.any():
                yield batch(rows[same, -16:], prev[same, -16:])
            before = rows[-1:].copy()
        if before is not None:
            yield batch(before, before, True)

    found = tree.select(path.alias("p")).repartitionByRange("p").sortWithinPartitions("p").mapInArrow(each, "a binary, b binary, part int, last boolean")
    found = materialise(found, "neighbours")
    edges = sorted(found.filter("last is not null").collect(), key=lambda r: (r["part"], r["last"]))
    bridges = [(bytes(x["a"])[-16:], bytes(y["a"])[-16:]) for x, y in zip(edges[1::2], edges[2::2], strict=False) if x["a"][: 1 + length] == y["a"][: 1 + length]]
    inner = found.filter("last is null").select("a", "b")
    return inner.unionByName(reps.sparkSession.createDataFrame(bridges, "a binary, b binary")) if bridges else inner


def candidates(sig: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which texts share, in some tree, a prefix of the shorter of their two lengths; sig is texts x TREES x DEPTH."""
    meet = np.zeros((len(sig), len(sig)), bool)
    for d in np.unique(lengths):
        short = lengths == d
        path = np.zeros((len(sig), TREES, 8), np.uint8)
        path[:, :, :d] = sig[:, :, :d]
        path = path.view("<u8")[:, :, 0]
        for t in range(TREES):
            order = np.argsort(path[:, t], kind="stable")
            for same in np.split(order, np.flatnonzero(np.diff(path[order, t])) + 1):
                if len(same) > 1 and short[same].any():
                    meet[np.ix_(same[short[same]], same)] = True
    return meet | meet.T


def _verify(rows: pd.DataFrame, lengths: list[int], similarity: float) -> pd.DataFrame:
    """Links within one pair of blocks of one group; one row per text that has any."""
    i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
    block = rows["block"].to_numpy()
    sets = [np.frombuffer(bytes(m), np.uint64) for m in rows["marks"]]
    sizes = np.array([len(s) for s in sets])
    copies = rows["n"].to_numpy()
    flat, ends = np.concatenate(sets), np.cumsum(sizes)
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(len(rows), TREES, DEPTH)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    meet = candidates(sig, np.array(lengths)[class_of(sizes)])
    links, up = np.zeros(len(rows), np.int64), np.arange(len(rows))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a in left:
        others = right[meet[a, right]]
        others = others[others > a] if i == j else others
        lo, hi = np.minimum(sizes[a], sizes[others]), np.maximum(sizes[a], sizes[others])
        others = others[lo >= similarity * hi - 1e-9]
        for part in np.array_split(others, max(1, int(sizes[others].sum()) // 2_000_000 + 1)):
            if not len(part):
                continue
            own = sets[a]
            spans = np.concatenate([flat[ends[b] - sizes[b] : ends[b]] for b in part])
            found = np.searchsorted(own, spans)
            found[found == len(own)] = 0
            shared = np.add.reduceat((own[found] == spans).astype(np.int64), np.r_[0, np.cumsum(sizes[part])[:-1]])
            near = part[shared / (sizes[a] + sizes[part] - shared) >= similarity]
            links[a] += copies[near].sum()
            links[near] += copies[a]
            for b in near:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    linked = np.flatnonzero(links)
    keys = rows["k"].to_numpy()
    return pd.DataFrame({"k": keys[linked], "links": links[linked], "root": [keys[root(x)] for x in linked]})


def verified(docs: DataFrame, reps: DataFrame, groups: DataFrame, lengths: list[int], similarity: float) -> DataFrame:
    """(k, links, root) of every text with a verified link, one row per pair of blocks.

    Only texts of group members leave their partition, once each, as shingles.
    """

    @F.pandas_udf("binary")
    def marks_of(text: pd.Series) -> pd.Series:
        return pd.Series([shingles(t).tobytes() for t in text], dtype=object)

    members = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    known = members.join(reps.select(F.col("k").alias("node"), "n", "sig", "size"), "node")
    blocks = known.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.col("size") * 8) / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = known.join(blocks, "root")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    keys = members.select("node")
    keys = F.broadcast(keys) if members.count() <= BROADCAST_KEYS else keys
    texts = docs.select(key_of(F.col("text")).alias("node"), "text").join(keys, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sent = placed.join(texts.select("node", marks_of("text").alias("marks")), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select(
        F.col("root").alias("group"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("node").alias("k"), "block", "n", "sig", "marks"
    )
    sent = sent.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "k")

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        now = None
        for part in parts:
            for key, rows in part.groupby(["group", "i", "j"], sort=False):
                if key != now and held:
                    yield _verify(pd.concat(held, ignore_index=True), lengths, similarity)
                    held = []
                now = key
                held.append(rows)
        if held:
            yield _verify(pd.concat(held, ignore_index=True), lengths, similarity)

    return sent.mapInPandas(each, "k binary, links long, root binary")


def join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per document: class_id, copy_id, n_links, kept (and k, its text's key).

    class_id is the least doc_id of all documents connected by links, copy_id
    the least of those with the same text, n_links the number of other documents
    linked directly, copies included. One document of each class is kept.
    """
    docs = bounded_batches(docs).select("doc_id", "text")
    audit = audit_sample(docs)
    reps = materialise(representatives(docs, audit, similarity), "reps")
    true = audited_links(reps)
    lengths = prefix_lengths(audit, true, similarity, recall)
    while True:
        neighbours = trie_neighbours(reps, min(lengths))
        groups = components(neighbours)
        found = materialise(verified(docs, reps, groups, lengths, similarity), "links")
        # what led to the links is not read again
        discard(neighbours)
        discard(groups)
        links = found.groupBy("k").agg(F.sum("links").alias("links"))
        share = measured_recall(audit, true, links)
        low = [c for c, r in share.items() if r < AUDIT_RECALL]
        if not low:
            break
        if any(lengths[c] == 1 for c in low):
            raise RuntimeError(f"n-gram join: the audited recall {min(share.values()):.3f} stays below {AUDIT_RECALL} with the shortest prefixes")
        lengths = [d - (c in low) for c, d in enumerate(lengths)]
        discard(found)
    roots = components(found.select(F.col("k").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("k"), "root")
    whole = reps.select("k", "rep", "n").join(links, "k", "left").join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    first = F.min(F.struct(F.col("rep").isNull(), F.col("rep"), F.col("k")))
    classes = whole.groupBy("root").agg(first.alias("first")).select("root", F.col("first.rep").alias("class_id"), F.col("first.k").alias("class_k"))
    whole = whole.join(classes, "root").select("k", "class_id", "class_k", F.col("rep").alias("copy_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    rows = docs.select("doc_id", key_of(F.col("text")).alias("k")).join(whole, "k", "left")
    alone = F.col("n_links").isNull()
    return rows.select(
        "doc_id", "k", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("k") == F.col("class_k")))).alias("kept"),
    )


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each class; of repeated rows (same id and text) one stays."""
    mark = lambda k: F.concat(k, F.coalesce(F.col("doc_id").cast("string").cast("binary"), F.lit(b"")))
    kept = join(docs, **how).filter("kept").select(mark(F.col("k")).alias("__mark"))
    marked = docs.withColumn("__mark", mark(key_of(F.col("text"))))
    return marked.join(kept, "__mark", "left_semi").dropDuplicates(["__mark"]).drop("__mark")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("k")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
shingled AS (
  SELECT DISTINCT text, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT text, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM (SELECT DISTINCT text, w FROM words WHERE len(w) > 0))),
texts AS (
  SELECT w.text, min(doc_id) AS rep, count(*) AS n FROM words w WHERE len(w.w) > 0 GROUP BY w.text),
sizes AS (
  SELECT s.text, t.rep, t.n, count(*) AS m FROM shingled s JOIN texts t USING (text) GROUP BY ALL),
pairs AS (
  SELECT a.text AS ta, b.text AS tb, count(*) AS shared FROM shingled a JOIN shingled b ON a.s = b.s AND a.text <> b.text GROUP BY ALL),
links AS (
  SELECT x.rep AS a, y.rep AS b, y.n AS nb FROM pairs p JOIN sizes x ON x.text = p.ta JOIN sizes y ON y.text = p.tb
  WHERE p.shared::DOUBLE / (x.m + y.m - p.shared) >= 0.8),
reach AS (
  SELECT rep AS a, rep AS b FROM texts UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
class AS (
  SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
degree AS (
  SELECT a AS rep, sum(nb) AS links FROM links GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(t.rep, d.doc_id) AS copy_id,
       (coalesce(g.links, 0) + coalesce(t.n, 1) - 1)::BIGINT AS n_links, coalesce(c.class_id, d.doc_id) = d.doc_id AS kept
FROM words d LEFT JOIN texts t ON t.text = d.text AND len(d.w) > 0 LEFT JOIN class c USING (rep) LEFT JOIN degree g USING (rep)
"""
