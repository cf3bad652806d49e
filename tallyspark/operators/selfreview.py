"""How sure the engine is of each field and of the whole statement: codes and counts, never values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONEY = ("debit", "credit", "balance")
EXPECTED_WARNINGS = ("no_opening_balance",)
STANDING = ("text:descriptions",)


def field_levels(results: DataFrame, issues: DataFrame, headers: DataFrame) -> DataFrame:
    """(doc, field, level) from the checks: high, medium, low or missing.

    ``results``: check_results of every document; ``issues``: all issues;
    ``headers``: the header columns. One grouped pass makes the evidence a row,
    and the fields are one array of it.
    """
    has = lambda *codes: F.bool_or(F.col("code").isin(*codes))
    seen = issues.groupBy("doc").agg(
        *[F.coalesce(has(c), F.lit(False)).alias(c) for c in ("total_debits_mismatch", "total_credits_mismatch", "debit_count_mismatch", "credit_count_mismatch", "closing_balance_mismatch", "net_movement_mismatch", "invalid_ifsc", "invalid_account_number", "invalid_routing_number", "period_reversed", "date_outside_period", "no_opening_balance")],
        F.coalesce(has("balance_mismatch", "malformed_amount", "missing_amount", "negative_amount"), F.lit(False)).alias("bad_money"),
        F.coalesce(has("missing_date", "date_out_of_order", "date_outside_period"), F.lit(False)).alias("bad_dates"),
    )
    chain = results.filter("check = 'balance_chain'").select("doc", F.col("status").alias("chain"), F.col("rows_checked").alias("chain_rows"))
    e = headers.join(chain, "doc", "left").join(seen, "doc", "left")
    flags = [c for c in seen.columns if c != "doc"]
    e = e.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags})
    verified = F.col("chain").isin("PASS", "WARN") & (F.col("chain_rows") > 0)
    money = F.when(verified, F.when(F.col("bad_money"), "low").otherwise("high")).when(F.col("chain") == "FAIL", "low").otherwise("medium")
    either = lambda bad: F.when(F.col(bad), "low").otherwise("high")
    period = F.when(F.col("date_outside_period") | F.col("period_reversed"), "low").otherwise("high")
    closing = F.when(F.col("has_latest"), either("closing_balance_mismatch")).when(F.col("opening").isNotNull(), either("net_movement_mismatch")).otherwise("medium")
    opening = F.when((F.col("chain_rows") > 0) & ~F.col("no_opening_balance") & ~F.col("bad_money"), "high").otherwise("medium")
    there = lambda name, level: F.when(F.col(name).isNull(), "missing").otherwise(level)
    fields = [
        *[(f"transactions.{c}", money) for c in MONEY],
        ("transactions.txn_date", F.when(F.col("bad_dates"), "low").otherwise("high")),
        ("header.ifsc", there("ifsc", either("invalid_ifsc"))),
        ("header.account_number", there("account_number", F.when(F.col("invalid_account_number"), "low").otherwise("medium"))),
        ("header.account_holder_name", there("account_holder_name", F.lit("medium"))),
        ("header.period_start", there("period_start", period)), ("header.period_end", there("period_end", period)),
        ("header.closing_balance", there("closing", closing)), ("header.opening_balance", there("opening", opening)),
        *[(f"summary.{c}", F.when(F.col(c).isNotNull(), either(f"{c}_mismatch"))) for c in ("total_debits", "total_credits", "debit_count", "credit_count")],
        ("header.extra.routing_number", F.when(F.col("routing_number").isNotNull(), either("invalid_routing_number"))),
    ]
    each = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("level")) for k, v in fields])
    return e.select("doc", F.inline(each)).filter("level is not null")


def confidence(basis: DataFrame, fields: DataFrame, items: DataFrame) -> DataFrame:
    """(doc, level, reasons): high, medium or low for each document.

    ``basis``: doc, validation, warnings, has_template, n_rows, expected;
    ``fields``: doc, field, level; ``items``: doc, item, level, muted.
    """
    from tallyspark.functions.text import item_kind

    per = fields.groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "level")))).alias("levels"))
    counted = items.filter(~F.col("muted") & ~F.col("item").isin(*STANDING) & ~F.col("item").endswith(":no_opening_balance"))
    covered = (F.col("item").startswith("field:") | F.col("item").startswith("learning:")) & (F.col("level") != "low")
    asked = counted.filter(~covered).groupBy("doc").agg(F.array_sort(F.collect_set(F.concat(F.lit("check:"), item_kind(F.col("item"))))).alias("checks"), F.bool_or(F.col("level") == "low").alias("low_item"))
    none = F.array().cast("array<string>")
    b = basis.join(per, "doc", "left").join(asked, "doc", "left").withColumns({"checks": F.coalesce("checks", none), "low_item": F.coalesce("low_item", F.lit(False)), "levels": F.coalesce("levels", F.create_map().cast("map<string,string>"))})
    level_of = lambda k: F.try_element_at("levels", F.lit(k))
    one = lambda when, code: F.when(when, F.array(F.lit(code))).otherwise(none)
    unsure_money = F.lit(False)
    for c in MONEY:
        unsure_money = unsure_money | ~level_of(f"transactions.{c}").eqNullSafe("high")
    low_fields = F.array_sort(F.map_keys(F.map_filter("levels", lambda k, v: v == "low")))
    missing = F.filter("expected", lambda k: F.try_element_at(F.col("levels"), k) == "missing")
    named = lambda prefix, xs: F.transform(xs, lambda x: F.concat(F.lit(prefix), x))
    reasons = F.array_distinct(F.concat(
        one(F.col("validation") == "FAIL", "validation_failed"), one(~F.coalesce(F.col("validation").isin("PASS", "WARN", "FAIL"), F.lit(False)), "not_validated"),
        named("warning:", F.filter("warnings", lambda w: ~w.isin(*EXPECTED_WARNINGS))), one(~F.col("has_template"), "no_template"), one(F.col("n_rows") == 0, "no_transactions"),
        one(unsure_money, "money_not_verified"), named("low:", low_fields), named("missing:", missing), F.col("checks"),
    ))
    low = F.coalesce(F.col("validation") == "FAIL", F.lit(False)) | (F.col("n_rows") == 0) | (F.size(low_fields) > 0) | F.col("low_item")
    return b.select("doc", F.when(low, "low").when(F.size(reasons) > 0, "medium").otherwise("high").alias("level"), reasons.alias("reasons"))


def with_history(fields: DataFrame, items: DataFrame, corrections: DataFrame, votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields and items after the owner's earlier feedback on the layout.

    ``corrections``: doc, field, times; ``votes``: doc, kind, agree, disagree.
    A corrected field is not rated high and becomes an item; an item that was
    called useless more often than useful, and twice at least, is muted.
    """
    from tallyspark.functions.text import item_kind

    f = fields.join(corrections, ["doc", "field"], "left")
    f = f.withColumn("level", F.when(F.col("times").isNotNull() & (F.col("level") == "high"), "medium").otherwise(F.col("level")))
    listed = corrections.select("doc", F.concat(F.lit("history:"), "field").alias("item"), F.lit("medium").alias("level"), F.lit(False).alias("muted"))
    each = items.unionByName(listed).withColumn("kind", item_kind(F.col("item"))).join(votes, ["doc", "kind"], "left")
    quiet = F.coalesce((F.col("disagree") >= 2) & (F.col("disagree") > F.col("agree")), F.lit(False))
    return f.select("doc", "field", "level"), each.select("doc", "item", "level", (F.col("muted") | quiet).alias("muted"))


def calibration(fields: DataFrame, items: DataFrame, marks: DataFrame) -> DataFrame:
    """Per document: fields marked wrong that were rated high, rows marked wrong, and those not flagged."""
    wrong = marks.join(fields, (marks["doc"] == fields["doc"]) & (marks["mark"] == fields["field"]), "left").select(marks["doc"], "mark", "level")
    flagged = items.select("doc", F.col("target").alias("mark"), F.lit(True).alias("flagged")).distinct()
    rows = wrong.join(flagged, ["doc", "mark"], "left")
    row = F.when(F.col("mark").startswith("txn."), F.regexp_replace("mark", "txn.", "").cast("int"))
    return rows.groupBy("doc").agg(
        F.array_sort(F.collect_set(F.when(F.col("level") == "high", F.col("mark")))).alias("wrong_but_high"),
        F.count(row).alias("rows_marked"), F.array_sort(F.collect_set(F.when(F.col("flagged").isNull(), row))).alias("rows_not_flagged"),
    )


def ensure_confidence(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored confidence where there is one, else the one computed now."""
    now = fresh.select("doc", F.col("level").alias("__now"))
    return stored.join(now, "doc", "left").withColumn("level", F.coalesce("level", "__now")).drop("__now")
