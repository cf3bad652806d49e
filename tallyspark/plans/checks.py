"""Queries of the validation operators over the ledger view, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import validate as v
from tallyspark.plans.bindings import HEADERS_SQL, LEDGER_SQL, headers, ledger
from tallyspark.plans.registry import query

_ORDERED = f"""WITH RECURSIVE {LEDGER_SQL},
steps AS (
  SELECT *, lag(txn_date) OVER (PARTITION BY doc ORDER BY i) AS prev_on FROM ledger),
ways AS (
  SELECT doc, count(*) >= 2 AND count(*) FILTER (WHERE txn_date IS NULL) = 0
              AND count(*) FILTER (WHERE prev_on > txn_date) > count(*) FILTER (WHERE prev_on < txn_date) AS descending FROM steps GROUP BY doc)"""

#: The oracle walks each ledger row by row with recursion, unlike the windows it checks.
_WALK = f"""{_ORDERED},
seq AS (
  SELECT l.*, descending, row_number() OVER (PARTITION BY l.doc ORDER BY CASE WHEN descending THEN -i ELSE i END) AS pos
  FROM ledger l JOIN ways USING (doc)),
walk AS (
  SELECT doc, 0::BIGINT AS pos, opening AS prev, NULL::VARCHAR AS outcome, NULL::BIGINT AS expected FROM (SELECT DISTINCT doc, opening FROM seq)
  UNION ALL
  SELECT s.doc, s.pos,
    CASE WHEN (s.debit IS NULL AND s.credit IS NULL) OR coalesce(s.debit, 0) < 0 OR coalesce(s.credit, 0) < 0 OR w.prev IS NULL OR s.balance IS NOT NULL THEN s.balance
         ELSE w.prev - coalesce(s.debit, 0) + coalesce(s.credit, 0) END,
    CASE WHEN s.debit IS NULL AND s.credit IS NULL THEN 'missing_amount' WHEN coalesce(s.debit, 0) < 0 OR coalesce(s.credit, 0) < 0 THEN 'negative_amount'
         WHEN w.prev IS NULL THEN 'unchecked' WHEN s.balance IS NULL THEN 'balance_missing'
         WHEN w.prev - coalesce(s.debit, 0) + coalesce(s.credit, 0) = s.balance THEN 'ok' ELSE 'balance_mismatch' END,
    CASE WHEN (s.debit IS NULL AND s.credit IS NULL) OR coalesce(s.debit, 0) < 0 OR coalesce(s.credit, 0) < 0 THEN NULL ELSE w.prev - coalesce(s.debit, 0) + coalesce(s.credit, 0) END
  FROM walk w JOIN seq s ON s.doc = w.doc AND s.pos = w.pos + 1),
outcomes AS (
  SELECT s.doc, s.i, s.o_orderkey, s.balance, s.opening, w.expected, w.outcome FROM walk w JOIN seq s USING (doc, pos))"""


@query("val1_balance_chain", f"{_WALK} SELECT doc, i, o_orderkey, expected, outcome FROM outcomes")
def val1_balance_chain(spark, d):
    return v.balance_chain(ledger(spark, d)).select("doc", "i", "o_orderkey", F.col("expected").cast("long").alias("expected"), "outcome")


@query(
    "val1_chain_issues",
    f"""{_WALK} SELECT doc, outcome AS code, CASE WHEN outcome = 'balance_missing' THEN 'WARN' ELSE 'FAIL' END AS severity, i AS row_index
FROM outcomes WHERE outcome NOT IN ('ok', 'unchecked') AND doc IN (SELECT doc FROM ledger WHERE balance IS NOT NULL)
UNION ALL SELECT doc, 'no_running_balance', 'WARN', NULL FROM ledger GROUP BY doc HAVING count(balance) = 0
UNION ALL SELECT doc, 'no_opening_balance', 'WARN', 0 FROM ledger GROUP BY doc HAVING count(balance) > 0 AND count(opening) = 0""",
)
def val1_chain_issues(spark, d):
    return v.chain_issues(ledger(spark, d)).select("doc", "code", "severity", "row_index")


_COMPARED = f"""{_ORDERED}, {HEADERS_SQL},
sums AS (
  SELECT l.doc, coalesce(sum(debit), 0) AS debits, coalesce(sum(credit), 0) AS credits, count(debit) AS n_debit, count(credit) AS n_credit,
         arg_min(struct_pack(b := balance), CASE WHEN descending THEN i ELSE -i END).b AS latest_balance
  FROM ledger l JOIN ways USING (doc) GROUP BY l.doc),
compared AS (
  SELECT doc, 'closing_balance_mismatch' AS code, latest_balance AS extracted, closing AS printed FROM headers JOIN sums USING (doc) WHERE latest_balance IS NOT NULL AND closing IS NOT NULL
  UNION ALL SELECT doc, 'net_movement_mismatch', opening - debits + credits, closing FROM headers JOIN sums USING (doc) WHERE opening IS NOT NULL AND closing IS NOT NULL
  UNION ALL SELECT doc, 'total_debits_mismatch', debits, total_debits FROM headers JOIN sums USING (doc) WHERE total_debits IS NOT NULL
  UNION ALL SELECT doc, 'total_credits_mismatch', credits, total_credits FROM headers JOIN sums USING (doc) WHERE total_credits IS NOT NULL
  UNION ALL SELECT doc, 'debit_count_mismatch', n_debit, debit_count FROM headers JOIN sums USING (doc) WHERE debit_count IS NOT NULL
  UNION ALL SELECT doc, 'credit_count_mismatch', n_credit, credit_count FROM headers JOIN sums USING (doc) WHERE credit_count IS NOT NULL)"""


@query("val2_reconciliation", f"{_COMPARED} SELECT doc, code, extracted::BIGINT AS extracted, printed::BIGINT AS printed, extracted = printed AS equal FROM compared")
def val2_reconciliation(spark, d):
    return v.comparisons(ledger(spark, d), headers(spark, d)).withColumn("equal", F.expr("extracted <=> printed"))


_ROWS = f"""{_ORDERED}, {HEADERS_SQL},
placed AS (
  SELECT l.doc, l.i, l.debit, l.credit, l.txn_date, descending, period_start, period_end, last_value(l.txn_date IGNORE NULLS) OVER (PARTITION BY l.doc ORDER BY l.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM ledger l JOIN ways USING (doc) LEFT JOIN headers h ON h.doc = l.doc),
row_found AS (
  SELECT doc, 'both_debit_and_credit' AS code, 'FAIL' AS severity, i AS row_index FROM placed WHERE debit IS NOT NULL AND credit IS NOT NULL
  UNION ALL SELECT doc, 'missing_date', 'FAIL', i FROM placed WHERE txn_date IS NULL
  UNION ALL SELECT doc, 'date_out_of_order', 'WARN', i FROM placed WHERE CASE WHEN descending THEN txn_date > before ELSE txn_date < before END
  UNION ALL SELECT doc, 'date_outside_period', 'WARN', i FROM placed WHERE txn_date < period_start OR txn_date > period_end)"""


@query("val3_rows", f"{_ROWS} SELECT * FROM row_found")
def val3_rows(spark, d):
    return v.row_issues(ledger(spark, d), headers(spark, d)).drop("check")


_HEADER = f"""WITH {LEDGER_SQL}, {HEADERS_SQL},
digits AS (
  SELECT doc, routing_number, list_sum(list_transform(range(1, 10), lambda k: (CASE k % 3 WHEN 1 THEN 3 WHEN 2 THEN 7 ELSE 1 END) * try_cast(substr(routing_number, k, 1) AS INT))) AS total FROM headers),
head_found AS (
  SELECT doc, 'invalid_ifsc' AS code, 'FAIL' AS severity FROM headers WHERE NOT regexp_full_match(ifsc, '[A-Z]{{4}}0[A-Z0-9]{{6}}')
  UNION ALL SELECT doc, 'invalid_account_number', 'FAIL' FROM headers WHERE NOT regexp_full_match(account_number, '[0-9X*]{{6,20}}')
  UNION ALL SELECT doc, 'invalid_routing_number', 'FAIL' FROM digits WHERE routing_number IS NOT NULL AND NOT (regexp_full_match(routing_number, '[0-9]{{9}}') AND coalesce(total % 10 = 0, false))
  UNION ALL SELECT doc, 'period_reversed', 'FAIL' FROM headers WHERE period_start > period_end
  UNION ALL SELECT doc, 'missing_header_field', 'WARN' FROM headers, unnest([account_holder_name IS NULL, account_number IS NULL, period_start IS NULL, period_end IS NULL]) AS t(gone) WHERE gone)"""


@query("val4_header", f"{_HEADER} SELECT * FROM head_found")
def val4_header(spark, d):
    return v.header_issues(headers(spark, d)).select("doc", "code", "severity")


_RESULTS = (
    _WALK
    + _COMPARED[len(_ORDERED) :]
    + _ROWS[len(_ORDERED) + len(HEADERS_SQL) + 2 :]
    + _HEADER[len(f"WITH {LEDGER_SQL}, {HEADERS_SQL}") :]
    + """,
results AS (
  SELECT doc, 'balance_chain' AS "check", CASE WHEN count(balance) = 0 THEN 'SKIP' WHEN count(*) FILTER (WHERE outcome IN ('missing_amount', 'negative_amount', 'balance_mismatch')) > 0 THEN 'FAIL'
         WHEN count(*) FILTER (WHERE outcome = 'balance_missing') > 0 OR count(opening) = 0 THEN 'WARN' WHEN count(*) FILTER (WHERE outcome = 'ok') > 0 THEN 'PASS' ELSE 'SKIP' END AS status,
         CASE WHEN count(balance) = 0 THEN 0 ELSE count(*) FILTER (WHERE outcome IN ('ok', 'balance_mismatch')) END AS rows_checked FROM outcomes GROUP BY doc
  UNION ALL SELECT h.doc, 'reconciliation', CASE WHEN count(*) FILTER (WHERE extracted <> printed) > 0 THEN 'FAIL' WHEN count(code) > 0 THEN 'PASS' ELSE 'SKIP' END, count(code) FROM headers h LEFT JOIN compared c ON c.doc = h.doc GROUP BY h.doc
  UNION ALL SELECT l.doc, 'rows', CASE WHEN coalesce(any_value(f), 0) > 0 THEN 'FAIL' WHEN coalesce(any_value(w), 0) > 0 THEN 'WARN' ELSE 'PASS' END, count(*)
    FROM ledger l LEFT JOIN (SELECT doc, count(*) FILTER (WHERE severity = 'FAIL') AS f, count(*) FILTER (WHERE severity = 'WARN') AS w FROM row_found GROUP BY doc) r ON r.doc = l.doc GROUP BY l.doc
  UNION ALL SELECT h.doc, 'header', CASE WHEN coalesce(any_value(f), 0) > 0 THEN 'FAIL' WHEN coalesce(any_value(w), 0) > 0 THEN 'WARN' WHEN any_value(n) > 0 THEN 'PASS' ELSE 'SKIP' END, any_value(n)
    FROM (SELECT doc, (ifsc IS NOT NULL)::INT + (account_number IS NOT NULL)::INT + (routing_number IS NOT NULL)::INT + (period_start IS NOT NULL AND period_end IS NOT NULL)::INT AS n FROM headers) h
    LEFT JOIN (SELECT doc, count(*) FILTER (WHERE severity = 'FAIL') AS f, count(*) FILTER (WHERE severity = 'WARN') AS w FROM head_found GROUP BY doc) r ON r.doc = h.doc GROUP BY h.doc)"""
)


@query("val5_check_results", f'{_RESULTS} SELECT doc, "check", status, rows_checked::BIGINT AS rows_checked FROM results')
def val5_check_results(spark, d):
    return v.check_results(ledger(spark, d), headers(spark, d)).select("doc", "check", "status", "rows_checked")


REPORT_SQL = f"""{_RESULTS},
report AS (
  SELECT doc, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN NOT bool_or("check" IN ('balance_chain', 'reconciliation') AND status = 'PASS') OR bool_or(status = 'WARN') THEN 'WARN' ELSE 'PASS' END AS status,
         NOT bool_or(status = 'FAIL') AND bool_or("check" IN ('balance_chain', 'reconciliation') AND status = 'PASS') AS verified,
         any_value(status) FILTER (WHERE "check" = 'balance_chain') AS balance_chain, any_value(status) FILTER (WHERE "check" = 'reconciliation') AS reconciliation,
         any_value(status) FILTER (WHERE "check" = 'rows') AS rows, any_value(status) FILTER (WHERE "check" = 'header') AS header
  FROM results GROUP BY doc)"""


@query("val5_report", f"{REPORT_SQL} SELECT * FROM report")
def val5_report(spark, d):
    return v.reports(v.check_results(ledger(spark, d), headers(spark, d)))


@query("val6_newest_first", f"{_ORDERED} SELECT doc, descending FROM ways")
def val6_newest_first(spark, d):
    return v.newest_first(ledger(spark, d)).groupBy("doc").agg(F.max("descending").alias("descending"))


@query("agg1_totals", f"{_COMPARED} SELECT doc, debits::BIGINT AS debits, credits::BIGINT AS credits, n_debit, n_credit, latest_balance AS latest FROM sums")
def agg1_totals(spark, d):
    return v.totals(ledger(spark, d)).select("doc", F.col("debits").cast("long").alias("debits"), F.col("credits").cast("long").alias("credits"), "n_debit", "n_credit", "latest")


@query("agg2_date_steps", f"{_ORDERED} SELECT doc, count(*) FILTER (WHERE prev_on < txn_date) AS up, count(*) FILTER (WHERE prev_on > txn_date) AS down FROM steps GROUP BY doc")
def agg2_date_steps(spark, d):
    before = F.lag("txn_date").over(v.printed())
    steps = ledger(spark, d).withColumn("before", before)
    return steps.groupBy("doc").agg(F.count_if(F.col("before") < F.col("txn_date")).alias("up"), F.count_if(F.col("before") > F.col("txn_date")).alias("down"))


@query("win7_first_last_chronological", f"{_ORDERED} SELECT l.doc, arg_min(o_orderkey, CASE WHEN descending THEN -i ELSE i END) AS first_key, arg_max(o_orderkey, CASE WHEN descending THEN -i ELSE i END) AS last_key FROM ledger l JOIN ways USING (doc) GROUP BY l.doc")
def win7_first_last_chronological(spark, d):
    at = F.when(F.col("descending"), -F.col("i")).otherwise(F.col("i"))
    return v.newest_first(ledger(spark, d)).groupBy("doc").agg(F.min_by("o_orderkey", at).alias("first_key"), F.max_by("o_orderkey", at).alias("last_key"))


@query("fn10_routing_numbers", f"{_HEADER} SELECT doc, coalesce(regexp_full_match(routing_number, '[0-9]{{9}}') AND total % 10 = 0, false) AS valid FROM digits")
def fn10_routing_numbers(spark, d):
    return headers(spark, d).select("doc", v.routing_number_valid(F.col("routing_number")).alias("valid"))


@query("fn20_direction_amount", f"WITH {LEDGER_SQL} SELECT o_orderkey, CASE WHEN debit IS NOT NULL AND credit IS NULL THEN 'DEBIT' WHEN credit IS NOT NULL AND debit IS NULL THEN 'CREDIT' END AS direction, CASE WHEN (debit IS NULL) <> (credit IS NULL) THEN coalesce(debit, credit) END AS amount FROM ledger")
def fn20_direction_amount(spark, d):
    debit, credit = F.col("debit").isNotNull(), F.col("credit").isNotNull()
    one = debit != credit
    return ledger(spark, d).select("o_orderkey", F.when(one, F.when(debit, "DEBIT").otherwise("CREDIT")).alias("direction"), F.when(one, F.coalesce("debit", "credit")).alias("amount"))
