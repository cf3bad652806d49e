"""Queries of snapshots, approval and self-review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators import golden as G
from tallyspark.operators import selfreview as R
from tallyspark.operators import validate as v
from tallyspark.plans import store as P
from tallyspark.plans.bindings import headers, ledger, table
from tallyspark.plans.checks import _RESULTS
from tallyspark.plans.registry import query
from tallyspark.sources.tables import stored

FIELDS = ["status", "price", "priority"]


def golden_pair(spark, d) -> tuple[DataFrame, DataFrame]:
    """Orders as rows of their customer's snapshot, and the same after a change of the reader."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("doc"), F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") * 100).cast("long").alias("price"), F.col("o_orderpriority").alias("priority"))
    place = lambda df: df.withColumn("i", F.row_number().over(Window.partitionBy("doc").orderBy("o_orderkey")) - 1).drop("o_orderkey")
    changed = rows.filter(k % 43 != 0).withColumns({"status": F.when(k % 40 == 0, "X").otherwise(F.col("status")), "price": F.when(k % 41 == 0, F.col("price") + 1).otherwise(F.col("price")), "priority": F.when(k % 47 != 0, F.col("priority"))})
    return place(rows), place(changed)


DIFF = """WITH a AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS price, o_orderpriority AS priority FROM orders),
b AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, CASE WHEN o_orderkey % 40 = 0 THEN 'X' ELSE o_orderstatus END AS status, CAST(round(o_totalprice * 100) AS BIGINT) + (o_orderkey % 41 = 0)::INT AS price,
  CASE WHEN o_orderkey % 47 <> 0 THEN o_orderpriority END AS priority FROM orders WHERE o_orderkey % 43 <> 0),
na AS (SELECT doc, count(*) AS m FROM a GROUP BY doc), nb AS (SELECT doc, count(*) AS n FROM b GROUP BY doc),
changes AS (
  SELECT doc, 'transactions[' || i || '].status' AS path, a.status AS old, b.status AS new FROM a JOIN b USING (doc, i) WHERE a.status IS DISTINCT FROM b.status
  UNION ALL SELECT doc, 'transactions[' || i || '].price', a.price::VARCHAR, b.price::VARCHAR FROM a JOIN b USING (doc, i) WHERE a.price IS DISTINCT FROM b.price
  UNION ALL SELECT doc, 'transactions[' || i || '].priority', a.priority, b.priority FROM a JOIN b USING (doc, i) WHERE a.priority IS DISTINCT FROM b.priority
  UNION ALL SELECT doc, 'transactions', coalesce(m, 0) || ' rows', coalesce(n, 0) || ' rows' FROM na FULL JOIN nb USING (doc) WHERE coalesce(m, 0) <> coalesce(n, 0))"""


@query("gld2_diff", f"{DIFF} SELECT * FROM changes")
def gld2_diff(spark, d):
    return G.diff_rows(*golden_pair(spark, d), FIELDS)


@query("gld2_diff_with_itself", f"{DIFF} SELECT * FROM changes WHERE false")
def gld2_diff_with_itself(spark, d):
    old, _ = golden_pair(spark, d)
    return G.diff_rows(old, old, FIELDS)


@query("gld2_diff_summary", """WITH a AS (SELECT c_custkey AS doc, c_custkey % 7 <> 0 AS p, c_name, c_mktsegment FROM customer),
b AS (SELECT c_custkey AS doc, c_custkey % 5 <> 0 AS q, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_custkey % 13 = 0 THEN 'OTHER' ELSE c_mktsegment END AS c_mktsegment FROM customer)
SELECT doc, 'summary' AS path, p AS was, q AS is_now FROM a JOIN b USING (doc) WHERE p <> q
UNION ALL SELECT doc, 'summary.c_name', true, true FROM a JOIN b USING (doc) WHERE p AND q AND a.c_name IS DISTINCT FROM b.c_name
UNION ALL SELECT doc, 'summary.c_mktsegment', true, true FROM a JOIN b USING (doc) WHERE p AND q AND a.c_mktsegment IS DISTINCT FROM b.c_mktsegment""")
def gld2_diff_summary(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    old = rows.select(k.alias("doc"), (k % 7 != 0).alias("present"), "c_name", "c_mktsegment")
    new = rows.select(k.alias("doc"), (k % 5 != 0).alias("present"), F.when(k % 11 != 0, F.col("c_name")).alias("c_name"), F.when(k % 13 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    out = G.diff_section(old, new, "summary", ["c_name", "c_mktsegment"])
    whole = F.col("path") == "summary"
    return out.select("doc", "path", F.when(whole, F.col("old").isNotNull()).otherwise(F.lit(True)).alias("was"), F.when(whole, F.col("new").isNotNull()).otherwise(F.lit(True)).alias("is_now"))


@query("gld5_regression", f"""{DIFF}, n AS (SELECT doc, count(*) AS n FROM changes GROUP BY doc), k AS (SELECT DISTINCT doc FROM a),
j AS (SELECT doc, doc % 25 <> 0 AS was_read, coalesce(n, 0) + (doc % 31 = 0)::INT AS total FROM k LEFT JOIN n USING (doc))
SELECT doc, CASE WHEN NOT was_read THEN 'ERROR' WHEN total > 0 THEN 'DIFF' ELSE 'PASS' END AS status, CASE WHEN was_read THEN total END::BIGINT AS n_changes FROM j""")
def gld5_regression(spark, d):
    old, new = golden_pair(spark, d)
    docs = old.select("doc").distinct()
    fresh = docs.filter("doc % 25 <> 0").withColumn("workflow", F.when(F.col("doc") % 31 == 0, "unknown").otherwise("known"))
    return G.regression(docs.withColumn("workflow", F.lit("known")), fresh, G.diff_rows(old, new, FIELDS))


def _candidates(spark, d) -> DataFrame:
    rows = P.extractions(spark, d)
    last = rows.groupBy("document_id").agg(F.max("id").alias("latest_id"))
    marks = P.reviews(spark, d).select(F.col("extraction_id").alias("id"), (F.size("flags") + F.size("missing")).alias("marks"), F.lit(True).alias("reviewed"))
    gold = P.goldens(spark, d).filter("status = 'active'").select("document_id").distinct().withColumn("golden", F.lit(True))
    e = F.col("id")
    out = rows.join(last, "document_id").join(marks, "id", "left").join(gold, "document_id", "left").withColumn("extraction_id", e)
    warnings = F.when(e % 6 == 1, F.array(F.lit("no_opening_balance"))).when(e % 6 == 2, F.array(F.lit("date_out_of_order"), F.lit("no_opening_balance"))).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"reviewed": F.coalesce("reviewed", F.lit(False)), "marks": F.coalesce("marks", F.lit(0)), "golden": F.coalesce("golden", F.lit(False)), "has_statement": e % 29 != 0, "validation_status": F.when(e % 7 == 0, "FAIL").otherwise("PASS"), "warnings": warnings, "acknowledged": e % 2 == 0, "n_changed": (e % 8 == 3).cast("int")})


_GATES = f"""WITH {P.CTE}, c AS (SELECT e, document_id, e % 6 AS w, e = max(e) OVER (PARTITION BY document_id) AS newest, event_type IN ('purchase', 'error') AS reviewed, event_type = 'error' AND e % 6 = 0 AS marked,
  document_id IN (SELECT document_id FROM gd WHERE status = 'active') AS golden FROM ev)"""


@query("gld3_approval_gate", f"{_GATES} SELECT e AS id, CASE WHEN NOT newest THEN 'not_latest' WHEN NOT reviewed THEN 'no_review' WHEN marked THEN 'review_marks' WHEN e % 29 = 0 OR e % 7 = 0 THEN 'validation_failed' WHEN w IN (1, 2) AND e % 2 = 1 THEN 'warnings' WHEN e % 8 = 3 THEN 'stale' END AS gate FROM c")
def gld3_approval_gate(spark, d):
    return G.approval_gate(_candidates(spark, d)).select("id", "gate")


@query("gld4_agent_gate", f"{_GATES} SELECT e AS id, CASE WHEN NOT newest THEN 'not_latest' WHEN golden THEN 'already_golden' WHEN e % 10 = 0 OR e % 3 <> 0 THEN 'review_required' WHEN e % 29 = 0 OR e % 7 = 0 THEN 'validation_failed' WHEN w = 2 THEN 'warnings' WHEN e % 8 = 3 THEN 'stale' END AS gate FROM c")
def gld4_agent_gate(spark, d):
    return G.agent_gate(_candidates(spark, d)).select("id", "gate")


def _all_issues(spark, d) -> DataFrame:
    return _issues_of(ledger(spark, d), headers(spark, d))


def _issues_of(t, h) -> DataFrame:
    return v.chain_issues(t).unionByName(v.reconciliation_issues(t, h)).unionByName(v.row_issues(t, h)).unionByName(v.header_issues(h))


_ALL = f"""{_RESULTS},
all_found AS (
  SELECT doc, outcome AS code, CASE WHEN outcome = 'balance_missing' THEN 'WARN' ELSE 'FAIL' END AS severity FROM outcomes WHERE outcome NOT IN ('ok', 'unchecked') AND doc IN (SELECT doc FROM ledger WHERE balance IS NOT NULL)
  UNION ALL SELECT doc, 'no_running_balance', 'WARN' FROM ledger GROUP BY doc HAVING count(balance) = 0
  UNION ALL SELECT doc, 'no_opening_balance', 'WARN' FROM ledger GROUP BY doc HAVING count(balance) > 0 AND count(opening) = 0
  UNION ALL SELECT doc, code, 'FAIL' FROM compared WHERE extracted <> printed
  UNION ALL SELECT doc, code, severity FROM row_found UNION ALL SELECT doc, code, severity FROM head_found)"""


@query("flt5_warning_codes", f"{_ALL} SELECT doc, list_sort(list(DISTINCT code)) AS warnings FROM all_found WHERE severity = 'WARN' GROUP BY doc")
def flt5_warning_codes(spark, d):
    return G.warning_codes(_all_issues(spark, d))


_LEVELS = f"""{_ALL},
seen AS (SELECT doc, list(DISTINCT code) AS codes FROM all_found GROUP BY doc),
ch AS (SELECT doc, status AS chain, rows_checked AS n FROM results WHERE "check" = 'balance_chain'),
lat AS (SELECT doc, latest_balance IS NOT NULL AS has_latest FROM sums),
ev2 AS (SELECT h.*, chain, n, has_latest, coalesce(codes, []) AS codes, coalesce(list_has_any(codes, ['balance_mismatch', 'missing_amount', 'negative_amount']), false) AS bad_money FROM headers h LEFT JOIN ch USING (doc) LEFT JOIN lat USING (doc) LEFT JOIN seen USING (doc)),
lv AS (
  SELECT doc, unnest(['transactions.debit', 'transactions.credit', 'transactions.balance']) AS field, CASE WHEN chain IN ('PASS', 'WARN') AND n > 0 THEN CASE WHEN bad_money THEN 'low' ELSE 'high' END WHEN chain = 'FAIL' THEN 'low' ELSE 'medium' END AS level FROM ev2
  UNION ALL SELECT doc, 'transactions.txn_date', CASE WHEN list_has_any(codes, ['missing_date', 'date_out_of_order', 'date_outside_period']) THEN 'low' ELSE 'high' END FROM ev2
  UNION ALL SELECT doc, 'header.ifsc', CASE WHEN ifsc IS NULL THEN 'missing' WHEN list_contains(codes, 'invalid_ifsc') THEN 'low' ELSE 'high' END FROM ev2
  UNION ALL SELECT doc, 'header.account_number', CASE WHEN account_number IS NULL THEN 'missing' WHEN list_contains(codes, 'invalid_account_number') THEN 'low' ELSE 'medium' END FROM ev2
  UNION ALL SELECT doc, 'header.account_holder_name', CASE WHEN account_holder_name IS NULL THEN 'missing' ELSE 'medium' END FROM ev2
  UNION ALL SELECT doc, 'header.period_start', CASE WHEN period_start IS NULL THEN 'missing' WHEN list_has_any(codes, ['date_outside_period', 'period_reversed']) THEN 'low' ELSE 'high' END FROM ev2
  UNION ALL SELECT doc, 'header.period_end', CASE WHEN period_end IS NULL THEN 'missing' WHEN list_has_any(codes, ['date_outside_period', 'period_reversed']) THEN 'low' ELSE 'high' END FROM ev2
  UNION ALL SELECT doc, 'header.closing_balance', CASE WHEN closing IS NULL THEN 'missing' WHEN has_latest THEN CASE WHEN list_contains(codes, 'closing_balance_mismatch') THEN 'low' ELSE 'high' END WHEN opening IS NOT NULL THEN CASE WHEN list_contains(codes, 'net_movement_mismatch') THEN 'low' ELSE 'high' END ELSE 'medium' END FROM ev2
  UNION ALL SELECT doc, 'header.opening_balance', CASE WHEN opening IS NULL THEN 'missing' WHEN n > 0 AND NOT list_contains(codes, 'no_opening_balance') AND NOT bad_money THEN 'high' ELSE 'medium' END FROM ev2
  UNION ALL SELECT doc, 'summary.total_debits', CASE WHEN list_contains(codes, 'total_debits_mismatch') THEN 'low' ELSE 'high' END FROM ev2 WHERE total_debits IS NOT NULL
  UNION ALL SELECT doc, 'summary.total_credits', CASE WHEN list_contains(codes, 'total_credits_mismatch') THEN 'low' ELSE 'high' END FROM ev2 WHERE total_credits IS NOT NULL
  UNION ALL SELECT doc, 'summary.debit_count', CASE WHEN list_contains(codes, 'debit_count_mismatch') THEN 'low' ELSE 'high' END FROM ev2 WHERE debit_count IS NOT NULL
  UNION ALL SELECT doc, 'summary.credit_count', CASE WHEN list_contains(codes, 'credit_count_mismatch') THEN 'low' ELSE 'high' END FROM ev2 WHERE credit_count IS NOT NULL
  UNION ALL SELECT doc, 'header.extra.routing_number', CASE WHEN list_contains(codes, 'invalid_routing_number') THEN 'low' ELSE 'high' END FROM ev2 WHERE routing_number IS NOT NULL)"""


def _levels(spark, d) -> DataFrame:
    t, h = ledger(spark, d), headers(spark, d)
    return _levels_of(t, h, v.check_results(t, h), _all_issues(spark, d))


def _levels_of(t, h, results, issues) -> DataFrame:
    latest = v.totals(t).select("doc", F.col("latest").isNotNull().alias("has_latest"))
    return R.field_levels(results, issues, h.join(latest, "doc", "left"))


@query("rev1_field_levels", f"{_LEVELS} SELECT * FROM lv")
def rev1_field_levels(spark, d):
    return _levels(spark, d)


@query("rev2_confidence", f"""{_LEVELS},
ov AS (SELECT doc, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN NOT bool_or("check" IN ('balance_chain', 'reconciliation') AND status = 'PASS') OR bool_or(status = 'WARN') THEN 'WARN' ELSE 'PASS' END AS status FROM results GROUP BY doc),
warn AS (SELECT doc, list_sort(list(DISTINCT code)) AS ws FROM all_found WHERE severity = 'WARN' GROUP BY doc),
lows AS (SELECT doc, list_sort(list(field) FILTER (WHERE level = 'low')) AS low, bool_or(field IN ('transactions.debit', 'transactions.credit', 'transactions.balance') AND level <> 'high') AS unsure, bool_or(field = 'header.ifsc' AND level = 'missing') AS no_ifsc FROM lv GROUP BY doc)
SELECT doc, CASE WHEN status = 'FAIL' OR len(coalesce(low, [])) > 0 OR doc % 10 = 0 THEN 'low' WHEN len(list_filter(coalesce(ws, []), lambda w: w <> 'no_opening_balance')) > 0 OR doc % 9 = 0 OR unsure OR no_ifsc OR doc % 10 = 1 THEN 'medium' ELSE 'high' END AS level,
  list_concat(CASE WHEN status = 'FAIL' THEN ['validation_failed'] ELSE [] END, list_transform(list_filter(coalesce(ws, []), lambda w: w <> 'no_opening_balance'), lambda w: 'warning:' || w), CASE WHEN doc % 9 = 0 THEN ['no_template'] ELSE [] END, CASE WHEN unsure THEN ['money_not_verified'] ELSE [] END,
    list_transform(coalesce(low, []), lambda f: 'low:' || f), CASE WHEN no_ifsc THEN ['missing:header.ifsc'] ELSE [] END, CASE WHEN doc % 10 = 0 THEN ['check:row:*:money'] WHEN doc % 10 = 1 THEN ['check:text:x:*:*'] ELSE [] END) AS reasons
FROM ov LEFT JOIN warn USING (doc) LEFT JOIN lows USING (doc)""")
def rev2_confidence(spark, d):
    t, h = stored(ledger(spark, d), "ledger"), stored(headers(spark, d), "headers")
    results, issues = stored(v.check_results(t, h), "results"), stored(_issues_of(t, h).select("doc", "code", "severity"), "issues")
    report = v.reports(results).select("doc", F.col("status").alias("validation"))
    counts = t.groupBy("doc").agg(F.count(F.lit(1)).alias("n_rows"))
    basis = report.join(counts, "doc").join(G.warning_codes(issues), "doc", "left")
    basis = basis.withColumns({"warnings": F.coalesce("warnings", F.array().cast("array<string>")), "has_template": F.col("doc") % 9 != 0, "expected": F.array(F.lit("header.ifsc"))})
    n = F.col("doc") % 10
    item = F.when(n == 0, "row:3:money").when(n == 1, "text:x:4:0").when(n == 2, "field:header.branch").when(n == 3, "text:descriptions").when(n == 4, "row:0:no_opening_balance").otherwise("row:7:money")
    items = t.select("doc").distinct().select("doc", item.alias("item"), F.when(n == 0, "low").otherwise("medium").alias("level"), (n > 4).alias("muted"))
    return R.confidence(basis, _levels_of(t, h, results, issues), items)


@query("rev3_history", f"{_LEVELS} SELECT doc, field, CASE WHEN level = 'high' AND ((field = 'header.ifsc' AND doc % 3 = 0) OR (field = 'transactions.debit' AND doc % 5 = 0)) THEN 'medium' ELSE level END AS level FROM lv")
def rev3_history(spark, d):
    docs = headers(spark, d).select("doc")
    wrong = docs.filter("doc % 3 = 0").select("doc", F.lit("header.ifsc").alias("field"), F.lit(1).alias("times")).unionByName(docs.filter("doc % 5 = 0").select("doc", F.lit("transactions.debit").alias("field"), F.lit(2).alias("times")))
    items = docs.select("doc", F.lit("row:1:money").alias("item"), F.lit("low").alias("level"), F.lit(False).alias("muted"))
    votes = docs.select("doc", F.lit("row:*:money").alias("kind"), (F.col("doc") % 3).alias("agree"), (F.col("doc") % 4).alias("disagree"))
    return R.with_history(_levels(spark, d), items, wrong, votes)[0]


@query("rev3_muted_items", """SELECT o_custkey AS doc, 'row:1:money' AS item, o_custkey % 4 >= 2 AND o_custkey % 4 > o_custkey % 3 AS muted FROM orders GROUP BY o_custkey
UNION ALL SELECT o_custkey, 'history:header.ifsc', false FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey""")
def rev3_muted_items(spark, d):
    docs = table(spark, d, "orders").select(F.col("o_custkey").alias("doc")).distinct()
    wrong = docs.filter("doc % 3 = 0").select("doc", F.lit("header.ifsc").alias("field"), F.lit(1).alias("times"))
    fields = docs.select("doc", F.lit("header.ifsc").alias("field"), F.lit("high").alias("level"))
    items = docs.select("doc", F.lit("row:1:money").alias("item"), F.lit("low").alias("level"), F.lit(False).alias("muted"))
    votes = docs.select("doc", F.lit("row:*:money").alias("kind"), (F.col("doc") % 3).alias("agree"), (F.col("doc") % 4).alias("disagree"))
    return R.with_history(fields, items, wrong, votes)[1].select("doc", "item", "muted")


@query("rev4_calibration", f"""{_LEVELS}, marked AS (SELECT DISTINCT doc FROM lv WHERE doc % 2 = 0)
SELECT m.doc, CASE WHEN any_value(l.level) = 'high' THEN ['header.ifsc'] ELSE [] END AS wrong_but_high, 2::BIGINT AS rows_marked, CASE WHEN m.doc % 4 = 0 THEN [5] ELSE [2, 5] END AS rows_not_flagged
FROM marked m LEFT JOIN lv l ON l.doc = m.doc AND l.field = 'header.ifsc' GROUP BY m.doc""")
def rev4_calibration(spark, d):
    docs = headers(spark, d).select("doc").filter("doc % 2 = 0")
    marks = docs.select("doc", F.explode(F.array(F.lit("header.ifsc"), F.lit("txn.2"), F.lit("txn.5"))).alias("mark"))
    items = docs.filter("doc % 4 = 0").select("doc", F.lit("txn.2").alias("target"))
    return R.calibration(_levels(spark, d), items, marks)


@query("rev5_ensure_confidence", "SELECT c_custkey AS doc, CASE WHEN c_custkey % 3 = 0 THEN 'high' ELSE 'medium' END AS level FROM customer")
def rev5_ensure_confidence(spark, d):
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc"))
    stored = docs.withColumn("level", F.when(F.col("doc") % 3 == 0, "high"))
    return R.ensure_confidence(stored, docs.withColumn("level", F.lit("medium")))


@query("set5_agent_warnings", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ['a', 'b'] WHEN event_id % 3 = 1 THEN ['b'] ELSE [] END AS rest FROM events")
def set5_agent_warnings(spark, d):
    e = F.col("event_id")
    codes = F.when(e % 3 == 0, F.array(F.lit("a"), F.lit("no_opening_balance"), F.lit("b"))).when(e % 3 == 1, F.array(F.lit("b"))).otherwise(F.array(F.lit("no_opening_balance")))
    return table(spark, d, "events").select("event_id", F.array_except(codes, F.array(*[F.lit(w) for w in G.AGENT_WARNINGS])).alias("rest"))


@query("flt2_review_marks", """WITH n AS (SELECT o_custkey AS doc, count(*) AS rows FROM orders GROUP BY 1)
SELECT doc, list_sort(list_concat(CASE WHEN doc % 2 = 0 THEN ['header.branch'] ELSE [] END, CASE WHEN rows > 4 THEN ['txn.4'] ELSE [] END)) AS flags, ['header.ifsc'] AS missing, list_sort(list_concat(['nonsense'], CASE WHEN rows <= 4 THEN ['txn.4'] ELSE [] END)) AS rejected FROM n""")
def flt2_review_marks(spark, d):
    from tallyspark.operators.review import valid_marks

    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.count(F.lit(1)).alias("n_rows"))
    flags = F.concat(F.array(F.lit("txn.4"), F.lit("nonsense"), F.lit("header.ifsc"), F.lit("txn.4")), F.when(F.col("doc") % 2 == 0, F.array(F.lit("header.branch"))).otherwise(F.array().cast("array<string>")))
    return valid_marks(n.withColumns({"flags": flags, "missing": F.array(F.lit("header.ifsc"))}), ["header.branch", "header.ifsc"]).select("doc", "flags", "missing", "rejected")


@query("flt3_agent_feedback", "SELECT event_id, event_type IN ('click', 'view', 'error') AND event_id % 3 <> 2 AND event_id % 7 <> 0 AS valid FROM events")
def flt3_agent_feedback(spark, d):
    from tallyspark.operators.review import valid_feedback

    e = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("item"), F.when(e % 3 == 0, "agree").when(e % 3 == 1, "disagree").otherwise("maybe").alias("verdict"), F.when(e % 7 == 0, F.repeat(F.lit("x"), F.lit(501))).otherwise("short").alias("note"))
    known = spark.createDataFrame([("click",), ("view",), ("error",)], "item string")
    return valid_feedback(rows, known).select("event_id", "valid")


@query("set1_flags_minus_missing", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN ['a'] ELSE ['a', 'c'] END AS flags FROM part")
def set1_flags_minus_missing(spark, d):
    flags = F.array(F.lit("c"), F.lit("a"), F.lit("a"), F.lit("b"))
    missing = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("b")))
    return table(spark, d, "part").select("p_partkey", F.array_sort(F.array_except(flags, missing)).alias("flags"))
