"""Chat formatting against a plain reader and writer."""

import hashlib
import itertools
import random

from pyspark.sql import functions as F

from tallyspark.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["", "<", "\\", "<\\turn>", "<turn>", "</turn>", "a<says>b", "\\<then>\\", "<turn", ">", "</turn</turn>", "<\\", "x\ny\r\n", "😀 é", "$0 $1", "\\### Assistant: </turn> ok", "<<turn>>", "\\\\<says>"]


def rows(n=60, seed=1):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rng.randrange(1, 9)):
            out.append((c, t, rng.choice(["user", "assistant", "assistant", "system", "</turn>\\"]), "".join(rng.choices(NASTY, k=rng.randrange(4)))))
    return out


ODD = [(None, 0, "user", "no id"), (None, 1, "assistant", "yes"), (900, None, "assistant", "first"), (900, 3, None, None), (900, 3, None, None), (901, 0, "assistant", None), (902, 5, "user", "x" * 200_000), (902, 5, "assistant", "same turn"), (902, 5, "assistant", "same turn")]


def expected(data):
    """Digests per conversation, by a sort and a loop."""
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c, own in itertools.groupby(sorted(data, key=key), key=lambda r: r[0]):
        own = [(r[2] or "", r[3] or "") for r in own]
        said, loss = "".join(f"{r}\n{t}\n" for r, t in own), "".join(t for r, t in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_every_conversation_reads_back_whole(spark):
    data = rows() + ODD
    turns = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit("clash") for c in ["blocks", "piece", "formatted", "loss", "id", "p", "parts"]})
    for piece in (1024, 3, 1):  # one grouping, then ever more conversations in pieces
        got = {r["conv_id"]: tuple(r)[1:5] for r in C.digests(C.pieces(turns, piece=piece)).collect()}
        assert got == expected(data)


def test_pieces_join_to_what_one_grouping_gives(spark):
    turns = spark.createDataFrame(rows(30, 7) + ODD, SCHEMA)
    whole = sorted((r["conv_id"] or -1, r["formatted"], [tuple(s) for s in r["loss"]]) for r in C.formatted(turns).collect())
    assert sorted((r["conv_id"] or -1, r["formatted"], [tuple(s) for s in r["loss"]]) for r in C.formatted(turns, piece=2).collect()) == whole
    for _, text, loss in whole:
        for start, length in loss:
            assert not any(m in text[start : start + length] for m in C.MARKS)


def test_neighbours_of_one_role_share_a_block(spark):
    data = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "</turn>"), (1, 3, "assistant", "c")]
    row = C.formatted(spark.createDataFrame(data, SCHEMA)).first()
    assert row["formatted"] == "<turn>user<says>a<then>b</turn><turn>assistant<says><\\/turn><then>c</turn>"
    assert [row["formatted"][s["start"] : s["start"] + s["length"]] for s in row["loss"]] == ["<\\/turn>", "c"]


def test_escapes_are_undone(spark):
    texts = ["".join(t) for t in itertools.product(NASTY[:9], repeat=3)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", C.escaped(F.col("t")).alias("e"), C.unescaped(C.escaped(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"] and not any(m in r["e"] for m in C.MARKS)


def test_a_long_conversation_is_dealt_in_pieces(spark):
    data = [(5, t, "assistant" if t % 3 else "user", f"t{t}") for t in range(500)] + [(6, 0, "user", "short")]
    turns = spark.createDataFrame(data, SCHEMA)
    found = C.pieces(turns, piece=64).groupBy("conv_id").count().collect()
    assert {r["conv_id"]: r["count"] for r in found} == {5: 8, 6: 1}
    assert {r["conv_id"]: tuple(r)[1:5] for r in C.digests(C.pieces(turns, piece=64)).collect()} == expected(data)


def test_empty_table(spark):
    assert C.digests(C.pieces(spark.createDataFrame([], SCHEMA))).collect() == []


def test_no_python_in_the_plan(spark):
    plan = C.digests(C.pieces(spark.createDataFrame(rows(5), SCHEMA)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
