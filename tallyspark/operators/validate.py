"""Arithmetic and structural checks of ledgers, many documents at a time.

Every check is windows and grouped sums over one partitioning by document, so a
ledger is shuffled once whatever number of checks runs on it. Issues are rows
(doc, check, code, severity, row_index); reports are built from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_doc():
    return Window.partitionBy("doc")


def printed():
    """The rows of a document in the order they are printed."""
    return per_doc().orderBy("i")


def newest_first(txns: DataFrame) -> DataFrame:
    """``txns`` with ``descending``: more dates fall than rise, all are known, two rows at least."""
    before = F.lag("txn_date").over(printed())
    steps = txns.withColumn("__step", F.when(before > F.col("txn_date"), 1).when(before < F.col("txn_date"), -1).otherwise(0))
    known = F.count("txn_date").over(per_doc()) == F.count(F.lit(1)).over(per_doc())
    return steps.withColumn("descending", (F.count(F.lit(1)).over(per_doc()) >= 2) & known & (F.sum("__step").over(per_doc()) > 0)).drop("__step")


def balance_chain(txns: DataFrame) -> DataFrame:
    """``txns`` with expected and outcome: previous balance - debit + credit = balance, oldest first.

    A row that cannot be used, and a row with a balance, starts the chain anew
    from its own balance; a row without one carries the computed balance on.
    """
    rows = newest_first(txns).withColumn("at", F.when(F.col("descending"), -F.col("i")).otherwise(F.col("i")))
    error = F.when(F.col("debit").isNull() & F.col("credit").isNull(), "missing_amount").when((F.coalesce("debit", F.lit(0)) < 0) | (F.coalesce("credit", F.lit(0)) < 0), "negative_amount")
    move = F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))
    order = per_doc().orderBy("at")
    rows = rows.withColumns({"__error": error, "__sum": F.sum(move).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    restart = F.when(F.col("__error").isNotNull() | F.col("balance").isNotNull(), F.struct("balance", "__sum"))
    last = F.last(restart, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__last", last)
    base = F.when(F.col("__last").isNull(), F.col("opening")).otherwise(F.col("__last.balance"))
    expected = base + F.col("__sum") - F.coalesce("__last.__sum", F.lit(0))
    usable = F.col("__error").isNull() & base.isNotNull()
    outcome = (
        F.when(F.col("__error").isNotNull(), F.col("__error"))
        .when(base.isNull(), "unchecked")
        .when(F.col("balance").isNull(), "balance_missing")
        .when(expected == F.col("balance"), "ok")
        .otherwise("balance_mismatch")
    )
    return rows.withColumns({"expected": F.when(usable, expected), "outcome": outcome}).drop("__error", "__sum", "__last", "at")


_SEVERITY = {"missing_amount": "FAIL", "negative_amount": "FAIL", "balance_mismatch": "FAIL", "balance_missing": "WARN"}


def chain_issues(txns: DataFrame) -> DataFrame:
    """Issues of the balance chain; a ledger without any balance has only the one that says so."""
    rows = balance_chain(txns).withColumn("__some", F.max(F.col("balance").isNotNull()).over(per_doc()))
    severity = F.create_map(*[F.lit(x) for kv in _SEVERITY.items() for x in kv])
    own = rows.filter("__some and outcome not in ('ok', 'unchecked')").select("doc", F.lit("balance_chain").alias("check"), F.col("outcome").alias("code"), severity[F.col("outcome")].alias("severity"), F.col("i").alias("row_index"))
    per = rows.groupBy("doc").agg(F.max("__some").alias("some"), F.first("opening").alias("opening"))
    none = per.filter("not some").select("doc", F.lit("balance_chain").alias("check"), F.lit("no_running_balance").alias("code"), F.lit("WARN").alias("severity"), F.lit(None).cast("int").alias("row_index"))
    start = per.filter("some and opening is null").select("doc", F.lit("balance_chain").alias("check"), F.lit("no_opening_balance").alias("code"), F.lit("WARN").alias("severity"), F.lit(0).alias("row_index"))
    return own.unionByName(none).unionByName(start)


def totals(txns: DataFrame) -> DataFrame:
    """Per document: sums and counts of debits and credits, and the latest balance."""
    rows = newest_first(txns)
    latest = F.min_by("balance", F.when(F.col("descending"), F.col("i")).otherwise(-F.col("i")))
    return rows.groupBy("doc").agg(
        F.coalesce(F.sum("debit"), F.lit(0)).alias("debits"), F.coalesce(F.sum("credit"), F.lit(0)).alias("credits"),
        F.count("debit").alias("n_debit"), F.count("credit").alias("n_credit"), F.count(F.lit(1)).alias("n_rows"), latest.alias("latest"),
    )


def comparisons(txns: DataFrame, headers: DataFrame) -> DataFrame:
    """(doc, code, extracted, printed): up to six figures, each where the document prints it."""
    t = headers.join(totals(txns), "doc", "left")
    zero = F.lit(0).cast("long")
    debits, credits = F.coalesce("debits", zero), F.coalesce("credits", zero)
    figures = [
        ("closing_balance_mismatch", F.col("latest"), F.when(F.col("latest").isNotNull(), F.col("closing"))),
        ("net_movement_mismatch", F.col("opening") - debits + credits, F.when(F.col("opening").isNotNull(), F.col("closing"))),
        ("total_debits_mismatch", debits, F.col("total_debits")),
        ("total_credits_mismatch", credits, F.col("total_credits")),
        ("debit_count_mismatch", F.coalesce("n_debit", zero), F.col("debit_count")),
        ("credit_count_mismatch", F.coalesce("n_credit", zero), F.col("credit_count")),
    ]
    each = F.array(*[F.struct(F.lit(c).alias("code"), e.cast("long").alias("extracted"), p.cast("long").alias("printed")) for c, e, p in figures])
    return t.select("doc", F.inline(each)).filter("printed is not null")


def reconciliation_issues(txns: DataFrame, headers: DataFrame) -> DataFrame:
    wrong = comparisons(txns, headers).filter("not extracted <=> printed")
    return wrong.select("doc", F.lit("reconciliation").alias("check"), "code", F.lit("FAIL").alias("severity"), F.lit(None).cast("int").alias("row_index"))


def row_issues(txns: DataFrame, headers: DataFrame) -> DataFrame:
    """Both amounts, no date, a date out of the statement's own order or outside its period."""
    rows = newest_first(txns).join(headers.select("doc", "period_start", "period_end"), "doc", "left")
    before = F.last("txn_date", ignorenulls=True).over(printed().rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before)
    wrong = F.when(F.col("descending"), F.col("txn_date") > F.col("before")).otherwise(F.col("txn_date") < F.col("before"))
    outside = F.coalesce(F.col("txn_date") < F.col("period_start"), F.lit(False)) | F.coalesce(F.col("txn_date") > F.col("period_end"), F.lit(False))
    found = [
        _issue("both_debit_and_credit", "FAIL", F.col("debit").isNotNull() & F.col("credit").isNotNull()),
        _issue("missing_date", "FAIL", F.col("txn_date").isNull()),
        _issue("date_out_of_order", "WARN", F.coalesce(wrong, F.lit(False))),
        _issue("date_outside_period", "WARN", outside),
    ]
    return rows.select("doc", F.col("i").alias("row_index"), F.inline(F.filter(F.array(*found), lambda x: x.isNotNull()))).select("doc", F.lit("rows").alias("check"), "code", "severity", "row_index")


def _issue(code: str, severity: str, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))


def routing_number_valid(number: Column) -> Column:
    """Nine digits whose sum with weights 3, 7, 1 is a multiple of ten."""
    digits = [F.substring(number, k + 1, 1).try_cast("int") for k in range(9)]
    total = sum((w * d for w, d in zip((3, 7, 1) * 3, digits, strict=True)), F.lit(0))
    return F.coalesce(number.rlike(r"\A[0-9]{9}\z") & (total % 10 == 0), F.lit(False))


def header_checks(headers: DataFrame) -> DataFrame:
    """``headers`` with the array of its issues and how many fields were checked."""
    both = F.col("period_start").isNotNull() & F.col("period_end").isNotNull()
    missing = ("account_holder_name", "account_number", "period_start", "period_end")
    found = [
        _issue("invalid_ifsc", "FAIL", F.col("ifsc").isNotNull() & ~F.col("ifsc").rlike(r"\A[A-Z]{4}0[A-Z0-9]{6}\z")),
        _issue("invalid_account_number", "FAIL", F.col("account_number").isNotNull() & ~F.col("account_number").rlike(r"\A[0-9X*]{6,20}\z")),
        _issue("invalid_routing_number", "FAIL", F.col("routing_number").isNotNull() & ~routing_number_valid(F.col("routing_number"))),
        _issue("period_reversed", "FAIL", both & (F.col("period_start") > F.col("period_end"))),
        *[_issue("missing_header_field", "WARN", F.col(c).isNull()) for c in missing],
    ]
    checked = sum((F.col(c).isNotNull().cast("int") for c in ("ifsc", "account_number", "routing_number")), both.cast("int"))
    return headers.select("doc", F.filter(F.array(*found), lambda x: x.isNotNull()).alias("found"), checked.cast("long").alias("rows_checked"))


def header_issues(headers: DataFrame) -> DataFrame:
    return header_checks(headers).select("doc", F.inline("found")).select("doc", F.lit("header").alias("check"), "code", "severity", F.lit(None).cast("int").alias("row_index"))


def _status(n_fail: Column, n_issues: Column, checked: Column) -> Column:
    return F.when(n_fail > 0, "FAIL").when(n_issues > 0, "WARN").when(checked > 0, "PASS").otherwise("SKIP")


def check_results(txns: DataFrame, headers: DataFrame) -> DataFrame:
    """(doc, check, status, rows_checked, n_fail, n_warn) for the four checks of every document."""
    chain = balance_chain(txns).groupBy("doc").agg(
        F.max(F.col("balance").isNotNull()).alias("some"), F.count_if(F.col("outcome").isin("ok", "balance_mismatch")).alias("rows_checked"),
        F.count_if(F.col("outcome").isin("missing_amount", "negative_amount", "balance_mismatch")).alias("n_fail"),
        (F.count_if(F.col("outcome") == "balance_missing") + F.max(F.col("opening").isNull()).cast("long")).alias("n_warn"),
    )
    zero = F.lit(0).cast("long")
    some = F.col("some")
    chain = chain.select(
        "doc", F.lit("balance_chain").alias("check"), F.when(some, F.col("rows_checked")).otherwise(zero).alias("rows_checked"), F.when(some, F.col("n_fail")).otherwise(zero).alias("n_fail"),
        F.when(some, F.col("n_warn")).otherwise(F.lit(1)).cast("long").alias("n_warn"), (~some).alias("skipped"),
    )
    recon = comparisons(txns, headers).groupBy("doc").agg(F.count(F.lit(1)).alias("rows_checked"), F.count_if(F.expr("not extracted <=> printed")).alias("n_fail"))
    recon = headers.select("doc").join(recon, "doc", "left").select("doc", F.lit("reconciliation").alias("check"), F.coalesce("rows_checked", zero).alias("rows_checked"), F.coalesce("n_fail", zero).alias("n_fail"), zero.alias("n_warn"), F.lit(False).alias("skipped"))
    counts = txns.groupBy("doc").agg(F.count(F.lit(1)).alias("rows_checked"))
    per_row = row_issues(txns, headers).groupBy("doc").agg(F.count_if(F.col("severity") == "FAIL").alias("n_fail"), F.count_if(F.col("severity") == "WARN").alias("n_warn"))
    rows = counts.join(per_row, "doc", "left").select("doc", F.lit("rows").alias("check"), "rows_checked", F.coalesce("n_fail", zero).alias("n_fail"), F.coalesce("n_warn", zero).alias("n_warn"), F.lit(False).alias("skipped"))
    size = lambda s: F.size(F.filter("found", lambda x: x["severity"] == s)).cast("long")
    head = header_checks(headers).select("doc", F.lit("header").alias("check"), "rows_checked", size("FAIL").alias("n_fail"), size("WARN").alias("n_warn"), F.lit(False).alias("skipped"))
    each = chain.unionByName(recon).unionByName(rows).unionByName(head)
    status = F.when(F.col("skipped"), "SKIP").otherwise(_status(F.col("n_fail"), F.col("n_fail") + F.col("n_warn"), F.col("rows_checked")))
    return each.select("doc", "check", status.alias("status"), "rows_checked", "n_fail", "n_warn")


def reports(results: DataFrame) -> DataFrame:
    """One row per document: status, verified and the status of each check."""
    sums = results.groupBy("doc").agg(
        F.max(F.col("status") == "FAIL").alias("failed"), F.max(F.col("status") == "WARN").alias("warned"),
        F.max(F.col("check").isin("balance_chain", "reconciliation") & (F.col("status") == "PASS")).alias("proved"),
        *[F.max(F.when(F.col("check") == c, F.col("status"))).alias(c) for c in ("balance_chain", "reconciliation", "rows", "header")],
    )
    status = F.when(F.col("failed"), "FAIL").when(~F.col("proved") | F.col("warned"), "WARN").otherwise("PASS")
    return sums.select("doc", status.alias("status"), (~F.col("failed") & F.col("proved")).alias("verified"), "balance_chain", "reconciliation", "rows", "header")
