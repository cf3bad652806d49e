"""Checks of what a reviewer sends in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOTE = 500


def valid_marks(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``rows`` (flags, missing, n_rows) with sorted valid flags and missing, and what was rejected.

    A mark is a known field or ``txn.N`` below the row count; only fields can be
    missing, and a missing field is not flagged too.
    """
    known = F.array(*[F.lit(f) for f in fields])

    def good(m):
        row = F.when(m.rlike(r"\Atxn\.\d{1,9}\z"), F.regexp_replace(m, r"txn\.", "").cast("int"))
        return F.array_contains(known, m) | F.coalesce(row < F.col("n_rows"), F.lit(False))

    flags, missing = F.array_distinct("flags"), F.array_distinct("missing")
    kept_missing = F.array_sort(F.filter(missing, lambda m: F.array_contains(known, m)))
    rejected = F.array_sort(F.concat(F.filter(flags, lambda m: ~good(m)), F.filter(missing, lambda m: ~F.array_contains(known, m))))
    kept = F.array_sort(F.array_except(F.filter(flags, good), kept_missing))
    return rows.withColumns({"__f": kept, "__m": kept_missing, "rejected": rejected}).withColumns({"flags": F.col("__f"), "missing": F.col("__m")}).drop("__f", "__m")


def valid_feedback(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``rows`` (item, verdict, note) with valid: a listed item, a known verdict, a short note."""
    known = items.select("item").distinct().withColumn("__listed", F.lit(True))
    ok = F.col("__listed").isNotNull() & F.col("verdict").isin("agree", "disagree") & (F.length(F.coalesce("note", F.lit(""))) <= NOTE)
    return rows.join(known, "item", "left").withColumn("valid", F.coalesce(ok, F.lit(False))).drop("__listed")
