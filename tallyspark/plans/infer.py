"""Queries of layout inference: cells of line items as a table to be profiled, words as headings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import infer as I
from tallyspark.operators import lines as L
from tallyspark.plans.bindings import LEDGER_SQL, ledger, spread, table
from tallyspark.plans.registry import query
from tallyspark.plans.words import WORDS_SQL, _lines, statement_words, words


def cells(spark, d) -> DataFrame:
    """Per supplier a printed table: number, date, text, debit, credit, balance, short text."""
    r = spread(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_returnflag", "l_linestatus"))
    row = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    even = F.col("l_orderkey") % 2 == 0
    cols = [F.date_format("l_shipdate", "dd/MM/yyyy"), F.concat(F.lit("ORDER "), F.col("l_orderkey").cast("string"), F.lit(" shipped")), F.when(even, price).otherwise("-"), F.when(~even, price).otherwise(""), price, F.concat("l_returnflag", "l_linestatus")]
    each = F.array(*[F.struct(F.lit(k).alias("c"), v.alias("text")) for k, v in enumerate(cols)])
    return r.select(F.col("l_suppkey").alias("doc"), row.alias("row"), F.inline(each))


CELLS_SQL = """cells AS (
  SELECT l_suppkey AS doc, l_orderkey * 10 + l_linenumber AS row, unnest(range(0, 6)) AS c,
    unnest([strftime(l_shipdate, '%d/%m/%Y'), 'ORDER ' || l_orderkey || ' shipped', CASE WHEN l_orderkey % 2 = 0 THEN printf('%.2f', l_extendedprice) ELSE '-' END, CASE WHEN l_orderkey % 2 = 1 THEN printf('%.2f', l_extendedprice) ELSE '' END, printf('%.2f', l_extendedprice), l_returnflag || l_linestatus]) AS text FROM lineitem),
stats AS (
  SELECT doc, c::INT AS c, count(*) FILTER (WHERE text NOT IN ('', '-')) AS count, count(*) AS n, sum(length(text)) FILTER (WHERE text NOT IN ('', '-')) AS len FROM cells GROUP BY doc, c)"""


@query("inf3_column_stats", f"WITH {CELLS_SQL} SELECT doc, c, count::DOUBLE / n AS fill, CASE WHEN c = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS date, CASE WHEN c IN (2, 3, 4) AND count > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS amount, coalesce(len, 0)::DOUBLE / greatest(count, 1) AS avg_len, count FROM stats")
def inf3_column_stats(spark, d):
    return I.column_stats(cells(spark, d))


@query("inf5_content_roles", f"WITH {CELLS_SQL} SELECT doc, c, CASE c WHEN 0 THEN 'txn_date' WHEN 1 THEN 'description' WHEN 2 THEN 'debit' WHEN 3 THEN 'credit' WHEN 4 THEN 'balance' ELSE 'reference' END AS role FROM stats")
def inf5_content_roles(spark, d):
    return I.content_roles(I.column_stats(cells(spark, d))).select("doc", "c", "role")


@query("inf4_roles_usable", f"WITH {CELLS_SQL} SELECT DISTINCT doc, doc % 3 <> 0 AS usable FROM stats")
def inf4_roles_usable(spark, d):
    roles = I.content_roles(I.column_stats(cells(spark, d)))
    spoiled = roles.withColumn("role", F.when((F.col("doc") % 3 == 0) & (F.col("role") == "description"), "balance").when((F.col("doc") % 3 == 0) & (F.col("role") == "balance"), "description").otherwise(F.col("role")))
    return I.roles_usable(spoiled)


@query("inf6_debit_credit_orders", f"WITH {CELLS_SQL} SELECT doc, c, 0 AS variant, CASE c WHEN 0 THEN 'txn_date' WHEN 1 THEN 'description' WHEN 2 THEN 'debit' WHEN 3 THEN 'credit' WHEN 4 THEN 'balance' ELSE 'reference' END AS role FROM stats UNION ALL SELECT doc, c, 1, CASE c WHEN 0 THEN 'txn_date' WHEN 1 THEN 'description' WHEN 2 THEN 'credit' WHEN 3 THEN 'debit' WHEN 4 THEN 'balance' ELSE 'reference' END FROM stats")
def inf6_debit_credit_orders(spark, d):
    roles = I.content_roles(I.column_stats(cells(spark, d))).select("doc", "c", "role")
    return I.debit_credit_orders(roles).select("doc", "c", "variant", "role")


@query("inf2_label_roles", """SELECT p_partkey AS doc, unnest(range(0, 6))::INT AS c, unnest(['txn_date', 'value_date', 'description', CASE WHEN p_partkey % 2 = 0 THEN 'debit' ELSE 'amount' END, 'balance', NULL]) AS role FROM part""")
def inf2_label_roles(spark, d):
    k = F.col("p_partkey")
    labels = F.array(F.lit("Txn Date"), F.lit("Post DT."), F.lit("Particulars / Narration"), F.when(k % 2 == 0, "Withdrawal Amount (INR)").otherwise("Amount"), F.lit("Running Balance"), F.lit("Details"))
    rows = table(spark, d, "part").select(k.alias("doc"), F.posexplode(labels).alias("c", "label"))
    return I.label_roles(rows).select("doc", "c", "role")


@query("inf8_best_candidate", "SELECT o_custkey AS doc, (o_orderkey % 3)::INT AS variant, o_orderkey % 7 AS score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 7, o_orderkey % 3) AS k FROM orders) WHERE k = 1")
def inf8_best_candidate(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), (k % 3).cast("int").alias("variant"), F.least(k % 7, F.lit(3)).alias("n_fail"), ((k % 7) - F.least(k % 7, F.lit(3))).alias("n_problems"))
    return I.best_candidate(rows)


@query("det4_first_not_failed", "SELECT doc, template, status FROM (SELECT o_custkey AS doc, o_orderkey AS template, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'F') WHERE k = 1")
def det4_first_not_failed(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("rank"), F.col("o_orderkey").alias("template"), F.when(F.col("o_orderstatus") == "F", "FAIL").otherwise(F.col("o_orderstatus")).alias("status"))
    return I.first_not_failed(rows)


TEMPLATES = [("en/a/v1", "en", "a", 1, ["of the", "and the"]), ("en/a/v2", "en", "a", 2, ["of the", "and the"]), ("en/b/v1", "en", "b", 1, ["that"]), ("de/c/v1", "de", "c", 1, ["die", "und", "von"]), ("xx/none/v1", "xx", "none", 1, [])]
_FOUND = lambda words: " AND ".join(rf"regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_]){w.replace(' ', chr(92) + 's+')}([^\p{{L}}\p{{N}}_]|$)')" for w in words)


@query("det3_detect", f"""WITH hits AS (SELECT doc_id AS doc, 'en/a/v1' AS template, -2 AS k, 'en' AS b, 'a' AS l, -1 AS v FROM documents WHERE {_FOUND(["of the", "and the"])} UNION ALL SELECT doc_id, 'en/a/v2', -2, 'en', 'a', -2 FROM documents WHERE {_FOUND(["of the", "and the"])}
UNION ALL SELECT doc_id, 'en/b/v1', -1, 'en', 'b', -1 FROM documents WHERE {_FOUND(["that"])} UNION ALL SELECT doc_id, 'de/c/v1', -3, 'de', 'c', -1 FROM documents WHERE {_FOUND(["die", "und", "von"])})
SELECT doc, template, (row_number() OVER (PARTITION BY doc ORDER BY k, b, l, v) - 1)::INT AS rank FROM hits""")
def det3_detect(spark, d):
    known = spark.createDataFrame(TEMPLATES, "template string, bank string, layout string, version int, markers array<string>")
    return I.detect(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), known)


@query("inf11_merged_spans", f"""WITH RECURSIVE {WORDS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY x0, seq) AS n FROM words),
g AS (SELECT doc, page, n, x0, x1, x1 AS stop, 0 AS span FROM o WHERE n = 1 UNION ALL SELECT o.doc, o.page, o.n, o.x0, o.x1, CASE WHEN o.x0 - g.stop > 28 THEN o.x1 ELSE greatest(o.x1, g.stop) END, g.span + (o.x0 - g.stop > 28)::INT FROM g JOIN o ON o.doc = g.doc AND o.page = g.page AND o.n = g.n + 1)
SELECT doc, page, span::BIGINT AS span, min(x0) AS x0, max(x1) AS x1 FROM g GROUP BY ALL""")
def inf11_merged_spans(spark, d):
    """The oracle follows each span word by word; heights are 35, so words join within 28."""
    ws = words(spark, d)
    heights = I.word_heights(ws)
    return I.merged_spans(ws.join(heights, ["doc", "page"]), 0.8 * F.col("height")).select("doc", "page", "span", "x0", "x1")


@query("agg13_word_heights", f"WITH RECURSIVE {WORDS_SQL} SELECT doc, page, median(bottom - top)::DOUBLE AS height FROM words GROUP BY doc, page")
def agg13_word_heights(spark, d):
    return I.word_heights(words(spark, d))


@query("inf13_best_gap", f"""WITH RECURSIVE {WORDS_SQL},
e AS (SELECT DISTINCT doc, page, line_no, unnest([1000, 3500, CASE WHEN x0 > 1000 AND x0 < 3500 THEN x0 ELSE 1000 END, CASE WHEN x1 > 1000 AND x1 < 3500 THEN x1 ELSE 1000 END]) AS a FROM lined),
r AS (SELECT *, lead(a) OVER (PARTITION BY doc, page, line_no ORDER BY a) AS b FROM e),
j AS (SELECT r.doc, r.page, r.line_no, a, b, count(*) FILTER (WHERE l.x0 < (a + b) / 2.0 AND l.x1 > (a + b) / 2.0) AS n FROM r JOIN lined l ON l.doc = r.doc AND l.page = r.page AND l.line_no = r.line_no WHERE b IS NOT NULL GROUP BY ALL)
SELECT doc, page, line_no::INT AS line_no, (a + b) / 2.0::DOUBLE AS gap FROM j QUALIFY row_number() OVER (PARTITION BY doc, page, line_no ORDER BY n, a - b, a) = 1""")
def inf13_best_gap(spark, d):
    return _lines(spark, d).select("doc", "page", "line_no", I.best_gap(F.col("ws"), F.lit(1000), F.lit(3500)).alias("gap"))


@query("inf14_samples", f"WITH {CELLS_SQL} SELECT doc, c::INT AS c, row_number() OVER (PARTITION BY doc, c ORDER BY row, text) AS nth, substr(text, 1, 24) AS text FROM cells WHERE text NOT IN ('', '-', '--', '0.00', 'NA', 'N/A') QUALIFY nth <= 3")
def inf14_samples(spark, d):
    return I.samples(cells(spark, d))


@query("inf10_transaction_lines", f"WITH {LEDGER_SQL} SELECT doc, count(*) AS n_lines FROM ledger WHERE debit IS NOT NULL OR credit IS NOT NULL OR balance IS NOT NULL GROUP BY doc")
def inf10_transaction_lines(spark, d):
    lines = L.group_lines(statement_words(spark, d))
    return lines.filter(I.is_transaction(F.col("ws"))).groupBy("doc").agg(F.count(F.lit(1)).alias("n_lines"))


@query("inf9_table_starts", f"WITH {LEDGER_SQL}, p AS (SELECT doc, (i // 25 + 1)::INT AS page, count(*) AS n FROM ledger WHERE debit IS NOT NULL OR credit IS NOT NULL OR balance IS NOT NULL GROUP BY ALL) SELECT doc, page FROM p WHERE n >= 2")
def inf9_table_starts(spark, d):
    return I.table_starts(L.group_lines(statement_words(spark, d))).select("doc", "page")


@query("inf12_heading_lines", f"""WITH {LEDGER_SQL}, p AS (SELECT doc, (i // 25 + 1)::INT AS page, count(*) AS n, min(i % 25) FILTER (WHERE debit IS NOT NULL OR credit IS NOT NULL OR balance IS NOT NULL) AS f FROM ledger GROUP BY ALL)
SELECT doc, page, CASE WHEN f = 0 THEN 'Date Details Debit Credit Balance' ELSE 'second line' END AS text FROM p WHERE n >= 2""")
def inf12_heading_lines(spark, d):
    """What stands close over the first row with an amount: the heading, or the end of a row without one."""
    from tallyspark.plans.engine import labelled_words

    lines = L.group_lines(labelled_words(spark, d))
    return lines.join(I.heading_lines(lines, I.table_starts(lines)), ["doc", "page", "line_no"]).select("doc", "page", "text")


@query("inf15_word_roles", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS usable, CASE p_partkey % 4 WHEN 0 THEN 'columns' WHEN 1 THEN 'columns' WHEN 2 THEN 'signed' ELSE 'dr_cr' END AS mode FROM part")
def inf15_word_roles(spark, d):
    sets = [["txn_date", "description", "debit", "credit", "balance"], ["txn_date", "debit", "credit", "balance"], ["txn_date", "description", "amount", "balance"], ["txn_date", "description", "amount", "dr_cr", "debit", "balance"]]
    roles = F.element_at(F.array(*[F.array(*[F.lit(r) for r in s]) for s in sets]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", I.word_roles_usable(roles).alias("usable"), I.amount_mode(roles).alias("mode"))


@query("inf16_role_problems", "SELECT p_partkey, CASE p_partkey % 6 WHEN 1 THEN 'role_twice' WHEN 2 THEN 'no_date' WHEN 3 THEN 'no_description' WHEN 4 THEN 'no_debit_credit' WHEN 5 THEN 'amount_beside_pair' END AS problem FROM part")
def inf16_role_problems(spark, d):
    sets = [["txn_date", "description", "debit", "credit", "ignore", "ignore"], ["txn_date", "txn_date", "description"], ["description", "debit"], ["txn_date", "debit"], ["txn_date", "description", "debit"], ["txn_date", "description", "amount", "debit"]]
    roles = F.element_at(F.array(*[F.array(*[F.lit(r) for r in s]) for s in sets]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", I.role_problem(roles, I.amount_mode(roles)).alias("problem"))


@query("inf16_content_problems", f"WITH {CELLS_SQL} SELECT DISTINCT doc, 1 AS c, 'balance' AS role, 'not_amounts' AS problem FROM stats WHERE doc % 2 = 0 UNION ALL SELECT DISTINCT doc, 5, 'value_date', 'not_dates' FROM stats")
def inf16_content_problems(spark, d):
    s = I.samples(cells(spark, d)).groupBy("doc", "c").agg(F.collect_list("text").alias("samples"))
    role = F.when(F.col("c") == 0, "txn_date").when((F.col("c") == 1) & (F.col("doc") % 2 == 0), "balance").when(F.col("c") == 1, "description").when(F.col("c") == 4, "credit").when(F.col("c") == 5, "value_date").otherwise("debit")
    return I.content_problem(s.withColumn("role", role))


@query("inf16_longest_description", f"WITH {CELLS_SQL} SELECT DISTINCT doc, doc % 2 = 0 AS good FROM stats")
def inf16_longest_description(spark, d):
    text = F.when(F.col("doc") % 2 == 0, F.col("c") == 1).otherwise(F.col("c") == 5)
    rows = cells(spark, d).filter("c in (1, 5)").withColumn("role", F.when(text, "description").otherwise("reference"))
    return I.description_is_longest(rows)


@query("win5_monotone", f"WITH {LEDGER_SQL}, s AS (SELECT doc, txn_date, lag(txn_date) OVER (PARTITION BY doc ORDER BY i) AS b FROM ledger) SELECT doc, coalesce(bool_and(b <= txn_date), true) AS rising, coalesce(bool_and(b >= txn_date), true) AS falling FROM s GROUP BY doc")
def win5_monotone(spark, d):
    from tallyspark.operators.validate import printed

    rows = ledger(spark, d).withColumn("before", F.lag("txn_date").over(printed()))
    return rows.groupBy("doc").agg(F.coalesce(F.bool_and(F.col("before") <= F.col("txn_date")), F.lit(True)).alias("rising"), F.coalesce(F.bool_and(F.col("before") >= F.col("txn_date")), F.lit(True)).alias("falling"))
