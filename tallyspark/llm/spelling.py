"""Operator 12: words one edit apart, by an even-partition pigeonhole join.

A word of length ``l`` is indexed by two segments: its first ``l div 2`` code
points and the rest. A word within one edit of it that is as long or one longer
has one of them intact: the first at its start, or the second at its end, shifted
by the difference in length. So every word probes with these two substrings for
its own length and for the length below. Candidates are verified by an edit
distance that stops above one, inside the join, so that only links become rows;
a candidate found by its second segment counts only if the first differs, so no
pair is found twice. A word's form is its most frequent near word; roots follow
forms by doubling, whose rounds grow with the logarithm of the longest way (which
itself is at most a logarithm of the largest count, as counts double on it).

A segment that more than ``HOT`` words share is split: the words that probe it are
dealt over parts of about ``HOT`` of them, and each part meets all words indexed
under it. No segment's words are collected or listed as pairs.

Defined cases: a null text has no words; a null doc_id counts as an empty text in
the misspelling hash; repeated rows count again; an empty table gives an empty
table; other columns are ignored. Words of any length are compared whole.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import checkpointed, discard, materialise, table

RUN = "([a-zÀ-ÿ]+)"
MIN_CHARS, MIN_COUNT = 5, 3
#: One run in so many loses a code point, by the hash of its document and itself.
TYPO_EVERY = 97
RATIO = 2
#: Words under one segment from which on its probes are dealt over several tasks.
HOT = 1_000
#: The table of such segments is broadcast up to this many rows (some 50 bytes each), else joined by a shuffle.
BROADCAST_SEGMENTS = 100_000


def misspelt(doc_id: Column, run: Column, every: int = TYPO_EVERY) -> Column:
    """``run``, or ``run`` without one code point where the hash says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(F.pmod(h, F.lit(every)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, every: int = TYPO_EVERY, least: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all texts: words of at least ``MIN_CHARS`` code points that occur ``least`` times."""
    lower = F.translate(F.col("text"), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(1))).alias("run")).filter(F.length("run") >= MIN_CHARS)
    words = runs.select(misspelt(F.col("doc_id"), F.col("run"), every).alias("word")).filter(F.length("word") >= MIN_CHARS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _segments(word: Column, length: Column) -> Column:
    """The keys of a word, taken as one of ``length`` code points: that length, which segment, its code points."""
    half = F.floor(length / 2).cast("int")
    first = F.struct(length.alias("l"), F.lit(0).alias("part"), F.substring(word, F.lit(1), half).alias("key"))
    second = F.struct(length.alias("l"), F.lit(1).alias("part"), F.right(word, length - half).alias("key"))
    return F.array(first, second)


def links(words: DataFrame) -> DataFrame:
    """(word, n) to the pairs one edit apart: a, n_a, b, n_b; every pair once, the shorter or smaller word first."""
    chars = F.length("word").cast("int")
    index = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(_segments(F.col("word"), chars)).alias("s")).select("a", "n_a", "s.*")
    keys = F.concat(_segments(F.col("word"), chars), F.when(chars > MIN_CHARS, _segments(F.col("word"), chars - 1)).otherwise(F.array()))
    probe = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.explode(keys).alias("s")).select("b", "n_b", "s.*")
    on = ["l", "part", "key"]
    hot = checkpointed(index.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("parts")).filter("parts > 1"))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_SEGMENTS else hot
    parts = F.coalesce("parts", F.lit(1))
    index = index.join(hot, on, "left").withColumn("dealt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    probe = probe.join(hot, on, "left").withColumn("dealt", F.pmod(F.xxhash64("b"), parts).cast("int")).drop("parts")
    half = F.floor(F.col("l") / 2).cast("int")
    ordered = (F.length("b") > F.col("l")) | (F.col("a") < F.col("b"))
    found_before = (F.col("part") == 1) & (F.substring(F.col("a"), F.lit(1), half) == F.substring(F.col("b"), F.lit(1), half))
    pairs = index.join(probe, [*on, "dealt"])
    return pairs.filter(ordered & ~found_before & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n of every word."""
    pairs = links(words)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m"))))
    near = pairs.select(both.alias("p")).select("p.*")
    near = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("other"))).alias("best"))
    rows = words.join(near, "word", "left")
    holds = -F.col("best.less") >= ratio * F.col("n")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("best.other")).alias("form"), F.when(holds, -F.col("best.less")).alias("form_n"))


def roots(steps: DataFrame) -> DataFrame:
    """(word, form) rows without nulls to (word, root): the last form on the way; ways must not be circular."""
    at = materialise(steps.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialise(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = after.filter("moved").limit(1).count()
        discard(at)
        at = after.drop("moved")
        if not moved:
            return at


def group(docs: DataFrame, every: int = TYPO_EVERY, least: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """One row per word of ``docs``: word, form, root, n, n_near, form_n."""
    words = materialise(vocabulary(docs.select("doc_id", "text"), every, least), "words")
    found = materialise(forms(words, ratio), "forms")
    discard(words)
    ends = roots(found.filter("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE bits AS (
  SELECT range AS i, 0 AS step, range::BIGINT AS c FROM range(256)
  UNION ALL SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run, 1 AS n FROM documents),
distinct_runs AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS h FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda k: ('0x' || h[2 * k + 1 : 2 * k + 2])::BIGINT)),
                                 lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS h
  FROM distinct_runs, crc),
written AS (
  SELECT n, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM written WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
shorter AS (SELECT DISTINCT word, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
masked AS (SELECT word, left(word, i - 1) || '*' || substr(word, i + 1) AS mask FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM masked a JOIN masked b ON a.mask = b.mask AND a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON s.less = w.word
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.less = w.word),
near AS (
  SELECT p.a AS word, count(*)::BIGINT AS n_near, first(w.word ORDER BY w.n DESC, w.word) AS best, max(w.n) AS best_n FROM pairs p JOIN words w ON w.word = p.b GROUP BY p.a),
formed AS (
  SELECT w.word, w.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN m.best_n >= 2 * w.n THEN m.best END AS form, CASE WHEN m.best_n >= 2 * w.n THEN m.best_n END AS form_n
  FROM words w LEFT JOIN near m ON m.word = w.word),
ways AS (
  SELECT word, word AS reached, 0 AS steps FROM formed
  UNION ALL SELECT y.word, f.form, y.steps + 1 FROM ways y JOIN formed f ON f.word = y.reached WHERE f.form IS NOT NULL)
SELECT f.word, f.form, y.root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT word, arg_max(reached, steps) AS root FROM ways GROUP BY word) y ON y.word = f.word
"""
