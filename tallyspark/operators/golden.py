"""Snapshots of approved extractions: differences, approval gates, regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGENT_WARNINGS = ("no_opening_balance",)


def diff_rows(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """(doc, path, old, new): fields of rows at the same place that differ, and each document's row count if it does.

    ``old`` and ``new`` have doc, i (from 0, no gaps) and the fields. Rows that
    only the longer side has are counted, not listed.
    """
    a, b = old.select("doc", "i", F.struct(*fields).alias("x")), new.select("doc", "i", F.struct(*fields).alias("y"))
    pairs = a.join(b, ["doc", "i"]).filter("not x <=> y")
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"x.{f}").cast("string").alias("old"), F.col(f"y.{f}").cast("string").alias("new")) for f in fields])
    cells = pairs.select("doc", "i", F.inline(each)).filter("not old <=> new")
    cells = cells.select("doc", F.concat(F.lit("transactions["), F.col("i").cast("string"), F.lit("]."), "field").alias("path"), "old", "new")
    counts = old.groupBy("doc").agg(F.count(F.lit(1)).alias("m")).join(new.groupBy("doc").agg(F.count(F.lit(1)).alias("n")), "doc", "full_outer")
    text = lambda c: F.concat(F.coalesce(c, F.lit(0)).cast("string"), F.lit(" rows"))
    longer = counts.filter("coalesce(m, 0) <> coalesce(n, 0)").select("doc", F.lit("transactions").alias("path"), text(F.col("m")).alias("old"), text(F.col("n")).alias("new"))
    return cells.unionByName(longer)


def diff_section(old: DataFrame, new: DataFrame, section: str, fields: list[str]) -> DataFrame:
    """Changes of a one-row-per-document section; ``present`` tells a missing section from an empty one."""
    a = old.select("doc", F.col("present").alias("p"), F.struct(*fields).alias("x"))
    b = new.select("doc", F.col("present").alias("q"), F.struct(*fields).alias("y"))
    both = a.join(b, "doc", "full_outer").withColumns({"p": F.coalesce("p", F.lit(False)), "q": F.coalesce("q", F.lit(False))})
    whole = lambda there, s: F.when(there, F.to_json(s))
    gone = both.filter("p <> q").select("doc", F.lit(section).alias("path"), whole(F.col("p"), F.col("x")).alias("old"), whole(F.col("q"), F.col("y")).alias("new"))
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"x.{f}").cast("string").alias("old"), F.col(f"y.{f}").cast("string").alias("new")) for f in fields])
    cells = both.filter("p and q and not x <=> y").select("doc", F.inline(each)).filter("not old <=> new")
    return gone.unionByName(cells.select("doc", F.concat(F.lit(f"{section}."), "field").alias("path"), "old", "new"))


def approval_gate(rows: DataFrame) -> DataFrame:
    """``rows`` with the first rule that keeps the owner from approving (null if none does).

    Columns: extraction_id, latest_id, reviewed, marks, validation_status,
    has_statement, warnings (array), acknowledged, n_changed.
    """
    gate = (
        F.when(F.col("latest_id").isNull(), "no_extraction")
        .when(F.col("latest_id") != F.col("extraction_id"), "not_latest")
        .when(~F.col("reviewed"), "no_review")
        .when(F.col("marks") > 0, "review_marks")
        .when(~F.col("has_statement") | (F.col("validation_status") == "FAIL"), "validation_failed")
        .when((F.size("warnings") > 0) & ~F.col("acknowledged"), "warnings")
        .when(F.col("n_changed") > 0, "stale")
    )
    return rows.withColumn("gate", gate)


def agent_gate(rows: DataFrame) -> DataFrame:
    """``rows`` with the first rule that keeps the agent from approving by itself."""
    more = F.array_except("warnings", F.array(*[F.lit(w) for w in AGENT_WARNINGS]))
    gate = (
        F.when(F.col("latest_id").isNull() | (F.col("latest_id") != F.col("extraction_id")), "not_latest")
        .when(F.col("golden"), "already_golden")
        .when(F.coalesce("routing_required", F.lit(True)), "review_required")
        .when(~F.col("has_statement") | (F.col("validation_status") == "FAIL"), "validation_failed")
        .when(F.size(more) > 0, "warnings")
        .when(F.col("n_changed") > 0, "stale")
    )
    return rows.withColumn("gate", gate)


def regression(goldens: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """(doc, status, n_changes): ERROR if it could not be read again, DIFF if anything differs (the workflow too), else PASS."""
    n = changes.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    rows = goldens.select("doc", "workflow").join(fresh.select("doc", F.col("workflow").alias("now"), F.lit(True).alias("read")), "doc", "left").join(n, "doc", "left")
    total = F.coalesce("n", F.lit(0)) + (~F.col("workflow").eqNullSafe(F.col("now"))).cast("int")
    status = F.when(F.col("read").isNull(), "ERROR").when(total > 0, "DIFF").otherwise("PASS")
    return rows.select("doc", status.alias("status"), F.when(F.col("read"), total).cast("long").alias("n_changes"))


def warning_codes(issues: DataFrame) -> DataFrame:
    """(doc, warnings): the distinct codes of each document's warnings, sorted."""
    return issues.filter("severity = 'WARN'").groupBy("doc").agg(F.array_sort(F.collect_set("code")).alias("warnings"))


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    out = None
    for code, fails in rules:
        out = F.when(fails, code) if out is None else out.when(fails, code)
    return out
