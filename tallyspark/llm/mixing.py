"""Operator 4: mixing sources to target weights, with DataFrame functions only.

One pass sums the size of every source, a window over that small table shares
the total out by weight (water filling under a cap), and every document is then
emitted ``floor(rate)`` times plus once more with probability ``rate - floor``,
drawn from a hash of its id and text.

Defined cases: a null or blank text has size 0 and is taken 0 times more words;
a null source is a source of its own that sorts last; repeated rows are rows of
their own and share one draw; an empty table gives an empty table; columns of
the input named like a result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import checkpointed, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.0
MAX_REPEAT = 3.0
SEED = "mix-1"
#: Source tables of up to this many rows are broadcast (under 10 MB); larger ones are joined by key and salt.
BROADCAST_SOURCES = 100_000
SALTS = 32


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, max_repeat=MAX_REPEAT) -> DataFrame:
    """(source, size) rows to one row per source: source_size, target, rate.

    A source is held at ``max_repeat`` times its size when the level it would
    get, with every source of a smaller ratio already held, reaches its ratio;
    the level of the first that is not held is the level of all the others.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight)
    per = per.withColumn("held_at", F.lit(float(max_repeat)) * F.col("source_size").cast("double"))
    ratio = F.col("held_at") / F.col("weight")
    whole = Window.partitionBy(F.lit(0))
    order = Window.orderBy(ratio, F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("held_at").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weight_left)
    per = per.withColumn("level", F.max(F.when(F.col("level") < ratio, F.col("level"))).over(whole))
    target = F.least(F.col("held_at"), F.coalesce(F.col("level") * F.col("weight"), F.col("held_at")))
    return per.select("source", "source_size", "weight", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    )


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def with_copies(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies (how often each is emitted)."""
    sized = docs.withColumns({"size": size_of(F.col("text")), "__draw": draw(F.col("doc_id"), F.col("text"), seed)})
    targets = checkpointed(source_targets(docs.select("source", size_of(F.col("text")).alias("size")), **how))
    targets = targets.select(F.col("source").alias("__source"), "source_size", "target", "rate")
    sized = sized.drop("source_size", "target", "rate", "copies")
    same = F.col("source").eqNullSafe(F.col("__source"))
    if targets.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(targets), same)
    else:
        salt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int")
        spread = targets.withColumn("__to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = sized.withColumn("__salt", salt).join(spread, same & (F.col("__salt") == F.col("__to"))).drop("__salt", "__to")
    whole = F.floor("rate")
    return joined.withColumn("copies", (whole + (F.col("__draw") < F.col("rate") - whole).cast("long")).cast("long")).drop("__source", "__draw")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row as often as it is taken."""
    kept = docs.withColumn("__row", F.struct(*[F.col(c) for c in docs.columns])).select("__row", "doc_id", "text", "source")
    out = with_copies(kept, **how).filter("copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT] AS weight, 3.0::DOUBLE * source_size::DOUBLE AS held_at FROM per),
levelled AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(held_at) OVER w, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0::DOUBLE)) AS lv FROM ranked
  WINDOW w AS (ORDER BY held_at / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
topped AS (
  SELECT *, max(CASE WHEN lv < held_at / weight THEN lv END) OVER () AS level FROM levelled),
targets AS (
  SELECT source, source_size, least(held_at, coalesce(level * weight, held_at)) AS target FROM topped),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, s.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies
FROM (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rated)
"""
