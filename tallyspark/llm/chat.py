"""Operator 13: conversations as one marked string each, with DataFrame functions only.

The turns of a conversation are collected as structs and sorted by turn (then
role and text); neighbours of one role are merged into a block by an array
aggregation, and blocks are concatenated:

    <turn>role<says>first text<then>second text</turn>

A backslash in a role or text gets a second one, and the ``<`` of a mark inside
a text gets one behind it, so ``</turn>`` in a text reads ``<\\/turn>``; no mark
can arise from a text or from its border with a mark, and reading back undoes
both. The loss mask is a list of (start, length) in code points of the formatted
string: the texts of the roles that are learned from, without any mark.

A conversation is formatted in pieces. Those of up to ``PIECE`` rows are one
piece, built by one grouping. Longer ones (found by counting rows by
conversation) are dealt by conversation and ``turn div PIECE``, so that no task
collects a whole conversation; a piece that goes on with the block of the piece
before it begins with ``<then>`` and names the role in ``open_role``. Only a
digest over a conversation, which no one can compute in parts, brings its pieces
together, one row each.

Defined cases: a null text or role is empty; a null turn comes first; rows equal
in turn are ordered by role and text; repeated rows are turns of their own; rows
without a conv_id are one conversation without an id; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import checkpointed, table

TURN, SAYS, THEN, END = "<turn>", "<says>", "<then>", "</turn>"
MARKS = (TURN, SAYS, THEN, END)
LEARNED = ("assistant",)
#: Rows that one piece holds, where turns are numbered one by one.
PIECE = 1024
#: Ids of long conversations are broadcast up to this many (8 bytes each), else joined by a shuffle.
BROADCAST_IDS = 100_000
#: The conversation that the query adds: both its texts hold marks and an escape.
PLANTED_ID, PLANTED_TEXT = -7, r"\### Assistant: </turn> ok"

_BLOCKS = "array<struct<role:string,texts:array<string>>>"
_SPANS = "struct<at:bigint,spans:array<struct<start:bigint,length:bigint>>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\|<(?=" + "|".join(m[1:] for m in MARKS) + ")", r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _turns() -> Column:
    return F.sort_array(F.collect_list(F.struct(F.col("turn"), _text("role").alias("role"), _text("text").alias("text"))))


def merged(turns: Column) -> Column:
    """Sorted turn structs to blocks: role and the texts of neighbouring turns of that role."""

    def add(blocks: Column, turn: Column) -> Column:
        last = F.get(blocks, F.size(blocks) - 1)
        longer = F.struct(turn["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        new = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        same = F.coalesce(last["role"] == turn["role"], F.lit(False))
        return F.when(same, F.concat(F.slice(blocks, F.lit(1), F.size(blocks) - 1), F.array(longer))).otherwise(F.concat(blocks, F.array(new)))

    return F.aggregate(turns, F.array().cast(_BLOCKS), add)


def _parts(blocks: Column, opened: Column, learned: tuple[str, ...]) -> Column:
    """One struct per text: the marks before it, the text as it is written, whether it is learned from."""

    def block(b: Column, i: Column) -> Column:
        head = F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(TURN), escaped(b["role"]), F.lit(SAYS))
        head = F.when((i == 0) & opened, F.lit(THEN)).otherwise(head)
        loss = b["role"].isin(*learned)
        return F.transform(b["texts"], lambda t, j: F.struct(F.when(j == 0, head).otherwise(F.lit(THEN)).alias("mark"), escaped(t).alias("text"), loss.alias("loss")))

    return F.flatten(F.transform(blocks, block))


def _spans(parts: Column) -> Column:
    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["mark"])
        span = F.array(F.struct(start.alias("start"), F.length(p["text"]).cast("long").alias("length")))
        return F.struct((start + F.length(p["text"])).alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), F.array().alias("spans")).cast(_SPANS), add, lambda acc: acc["spans"])


def _written(grouped: DataFrame, learned: tuple[str, ...]) -> DataFrame:
    """Rows with blocks, open_role (null: none) and closes to pieces."""
    rows = grouped.withColumn("parts", _parts(F.col("blocks"), F.col("open_role").isNotNull(), learned))
    body = F.array_join(F.transform("parts", lambda p: F.concat(p["mark"], p["text"])), "")
    return rows.select("conv_id", "piece", "open_role", F.concat(body, F.when(F.col("closes"), F.lit(END)).otherwise(F.lit(""))).alias("formatted"), _spans(F.col("parts")).alias("loss"))


def long_conversations(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """Ids of conversations of more than ``piece`` rows, one column ``id``."""
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > piece).select(F.col("conv_id").alias("id"))


def _joined(turns: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    return turns.join(ids, F.col("conv_id").eqNullSafe(F.col("id")), how)


def pieces(turns: DataFrame, piece: int = PIECE, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """(conv_id, turn, role, text) rows to (conv_id, piece, open_role, formatted, loss); short conversations have piece 0."""
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ids = checkpointed(long_conversations(turns, piece))
    many = ids.count()
    if many and many <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    short = _joined(turns, ids, "left_anti") if many else turns
    short = short.groupBy("conv_id").agg(merged(_turns()).alias("blocks"))
    whole = _written(short.withColumns({"piece": F.lit(0).cast("long"), "open_role": F.lit(None).cast("string"), "closes": F.lit(True)}), learned)
    if not many:
        return whole
    dealt = _joined(turns, ids, "left_semi").groupBy("conv_id", F.floor(F.col("turn") / piece).alias("piece")).agg(merged(_turns()).alias("blocks"))
    at = Window.partitionBy("conv_id").orderBy("piece")
    first, last = F.get("blocks", F.lit(0))["role"], F.get("blocks", F.size("blocks") - 1)["role"]
    before = F.lag(last).over(at)
    after = F.lead(first).over(at)
    dealt = dealt.withColumns({"open_role": F.when(before == first, before), "closes": F.coalesce(after != last, F.lit(True))})
    return whole.unionByName(_written(dealt, learned))


def formatted(turns: DataFrame, piece: int = PIECE, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (spans of the whole string)."""
    at = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    own = pieces(turns, piece, learned).withColumn("before", F.coalesce(F.sum(F.length("formatted").cast("long")).over(at), F.lit(0)))
    own = own.withColumn("loss", F.transform("loss", lambda s: F.struct((s["start"] + F.col("before")).alias("start"), s["length"].alias("length"))))
    rows = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "formatted", "loss"))).alias("p"))
    return rows.select("conv_id", F.array_join("p.formatted", "").alias("formatted"), F.flatten("p.loss").alias("loss"))


def read_back(rows: DataFrame) -> DataFrame:
    """Pieces to (conv_id, piece, turns, loss_text): what ``formatted`` says, parsed again."""
    opened = F.concat(F.lit(TURN), escaped(F.col("open_role")), F.lit(SAYS), F.expr(f"substring(formatted, {len(THEN) + 1})"))
    blocks = F.filter(F.split(F.coalesce(opened, F.col("formatted")), END), lambda b: b != "")

    def block(b: Column) -> Column:
        halves = F.split(b, SAYS, 2)
        role = unescaped(F.substring(halves[0], len(TURN) + 1, 1 << 30))
        return F.transform(F.split(halves[1], THEN), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    def under(s: Column) -> Column:
        return unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))

    return rows.select("conv_id", "piece", F.length("formatted").cast("long").alias("chars"), F.flatten(F.transform(blocks, block)).alias("turns"), F.array_join(F.transform("loss", under), "").alias("loss_text"))


def digests(rows: DataFrame) -> DataFrame:
    """Digests of every conversation, from what is read back from its pieces."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read_back(rows).select("conv_id", F.struct("piece", F.size("turns").cast("long").alias("n"), said.alias("said"), F.col("loss_text").alias("loss"), "chars").alias("p"))
    whole = read.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"))

    def total(name: str) -> Column:
        return F.aggregate(f"p.{name}", F.lit(0).cast("long"), lambda a, x: a + x)

    loss = F.array_join("p.loss", "")
    return whole.select("conv_id", total("n").alias("n_turns"), F.sha2(F.array_join("p.said", "").cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
                        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), total("chars").alias("formatted_chars"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(PLANTED_ID).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(PLANTED_TEXT).alias("text")
    )
    return digests(pieces(turns.unionByName(planted)))


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, length(replace(replace(replace(replace(replace(text, '\', '\\'), '<turn>', '<\turn>'), '<says>', '<\says>'), '<then>', '<\then>'), '</turn>', '<\/turn>')) AS text_chars,
         length(replace(replace(replace(replace(replace(role, '\', '\\'), '<turn>', '<\turn>'), '<says>', '<\says>'), '<then>', '<\then>'), '</turn>', '<\/turn>')) AS role_chars,
         coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) = role, false) AS goes_on
  FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(text_chars + CASE WHEN goes_on THEN 6 ELSE 19 + role_chars END)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
