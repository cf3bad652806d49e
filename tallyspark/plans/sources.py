"""Queries of sources and sinks: what is written is read again and compared with where it came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.plans.bindings import LEDGER_SQL, ledger, table
from tallyspark.plans.registry import query
from tallyspark.plans.words import WORDS_SQL, words
from tallyspark.sources import layouts as Y
from tallyspark.sources import statements as T
from tallyspark.sources.tables import stored


@query("src5_recorded_layouts", f"WITH RECURSIVE {WORDS_SQL} SELECT doc, page, (seq - min(seq) OVER (PARTITION BY doc, page))::INT AS seq, text, x0 / 10.0::DOUBLE AS x0, x1 / 10.0::DOUBLE AS x1, top / 10.0::DOUBLE AS top, bottom / 10.0::DOUBLE AS bottom FROM words")
def src5_recorded_layouts(spark, d):
    points = words(spark, d, dealt=True).withColumns({c: F.col(c) / 10.0 for c in ("x0", "x1", "top", "bottom")})
    return Y.parse_layouts(Y.layouts_json(points, 595.0, 842.0))


@query("src2_chars_to_words", f"WITH RECURSIVE {WORDS_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY seq) AS k, seq - min(seq) OVER (PARTITION BY doc, page) AS n FROM words) SELECT doc, page, n::INT AS seq, CASE WHEN seq % 5 = 0 THEN text || '-' ELSE text END AS text FROM w")
def src2_chars_to_words(spark, d):
    """Words spelled out as characters: apart by a blank, by a jump back, or by a soft break."""
    w = words(spark, d, dealt=True)
    ends = F.when(F.col("seq") % 5 == 0, F.array(F.lit(chr(0xFFFE)))).when(F.col("seq") % 2 == 0, F.array(F.lit(" "))).otherwise(F.array().cast("array<string>"))
    spelled = F.concat(F.filter(F.split("text", ""), lambda c: c != ""), ends)
    left = F.when(F.col("seq") % 2 == 1, 1000.0).otherwise(5000.0)
    each = w.select("doc", "page", "seq", left.alias("left"), F.posexplode(spelled).alias("k", "ch"))
    x = F.col("left") + F.col("k") * 5.0
    chars = each.select("doc", "page", (F.col("seq") * 10000 + F.col("k")).alias("seq"), "ch", x.alias("x0"), (x + 5.0).alias("x1"), (F.col("seq") * 20.0).alias("top"), (F.col("seq") * 20.0 + 9.0).alias("bottom"))
    return Y.chars_to_words(chars).select("doc", "page", "seq", "text")


@query("src6_content_ids", "SELECT sha256(text) AS document_id, 'd' || min(lpad(doc_id::VARCHAR, 12, '0')) AS name, strlen(any_value(text)) AS size, count(*) AS copies FROM documents GROUP BY text")
def src6_content_ids(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("name"), F.col("text").cast("binary").alias("content"))
    return T.stored_documents(rows)


def _files(spark, d):
    k = F.col("p_partkey")
    own = F.concat_ws("/", "p_brand", F.concat(F.lit("layout-"), (F.col("p_size") % 3).cast("string")), F.concat(F.lit("v"), (k % 4 + 1).cast("string")))
    shown = F.when(k % 10 == 0, F.lit("moved/elsewhere/v1")).otherwise(own)
    return table(spark, d, "part").select(
        F.concat(F.lit("r"), F.lpad(k.cast("string"), 9, "0"), F.lit("/"), shown, F.lit(".json")).alias("path"), F.col("p_brand").alias("bank_code"), F.concat(F.lit("layout-"), (F.col("p_size") % 3).cast("string")).alias("layout_id"),
        (k % 4 + 1).cast("int").alias("version"), F.when(k % 7 == 0, "candidate").otherwise("approved").alias("status"),
    )


REG = "f AS (SELECT 'r' || lpad(p_partkey::VARCHAR, 9, '0') || '/' || CASE WHEN p_partkey % 10 = 0 THEN 'moved/elsewhere/v1' ELSE p_brand || '/layout-' || (p_size % 3) || '/v' || (p_partkey % 4 + 1) END || '.json' AS path, p_brand AS bank_code, 'layout-' || (p_size % 3) AS layout_id, (p_partkey % 4 + 1)::INT AS version, CASE WHEN p_partkey % 7 = 0 THEN 'candidate' ELSE 'approved' END AS status, p_partkey % 10 = 0 AS moved FROM part)"


@query("src7_registry", f"WITH {REG} SELECT path, bank_code, layout_id, version, status FROM (SELECT *, row_number() OVER (PARTITION BY bank_code, layout_id, version ORDER BY path) AS k FROM f WHERE NOT moved) WHERE k = 1 AND status = 'approved'")
def src7_registry(spark, d):
    return Y.registry(_files(spark, d))


@query("src7_load_errors", f"WITH {REG}, g AS (SELECT path FROM f WHERE NOT moved QUALIFY row_number() OVER (PARTITION BY bank_code, layout_id, version ORDER BY path) = 1) SELECT path, CASE WHEN moved THEN 'path_mismatch' ELSE 'duplicate' END AS error FROM f WHERE path NOT IN (SELECT path FROM g)")
def src7_load_errors(spark, d):
    return Y.load_errors(_files(spark, d))


@query("src8_template_problems", """SELECT 't' || p_partkey AS template_id, unnest(list_concat(CASE WHEN p_partkey % 4 = 0 THEN ['bad_version'] ELSE [] END, CASE WHEN p_partkey % 5 = 0 THEN ['unknown_status'] ELSE [] END, CASE WHEN p_partkey % 3 = 0 THEN ['unknown_role'] ELSE [] END,
CASE WHEN p_size % 2 = 0 THEN ['empty_column'] ELSE [] END, CASE WHEN p_partkey % 6 = 1 THEN ['no_date_column'] ELSE [] END, CASE WHEN p_partkey % 11 = 0 THEN ['rule_without_target'] ELSE [] END,
CASE WHEN p_partkey % 13 = 0 THEN ['unknown_mode'] ELSE [] END, CASE WHEN p_partkey % 17 = 0 THEN ['unknown_strategy'] ELSE [] END, CASE WHEN p_partkey % 19 = 0 THEN ['no_date_formats'] ELSE [] END)) AS problem FROM part""")
def src8_template_problems(spark, d):
    k = F.col("p_partkey")
    column = lambda role, a, b: F.struct(role.alias("role"), a.alias("x0"), b.alias("x1"), F.lit(None).cast("string").alias("label"))
    first = F.when(k % 6 == 1, "ignore").otherwise("txn_date")
    columns = F.array(column(first, F.lit(1.0), F.lit(2.0)), column(F.when(k % 3 == 0, "nonsense").otherwise("debit"), F.lit(5.0), F.when(F.col("p_size") % 2 == 0, 5.0).otherwise(6.0)))
    rules = F.array(F.struct(F.lit("regex").alias("kind"), F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("header.ifsc"))).alias("targets"), F.array(F.lit(1)).alias("pages"), F.lit("x").alias("pattern")))
    status = F.array(*map(F.lit, ("lost", "approved", "candidate", "rejected", None)))
    mode = F.when(k % 13 == 0, "sideways").when(k % 13 != 1, "signed")
    strategy = F.when(k % 17 == 0, "pictures").when(k % 17 != 1, "word_columns")
    formats = F.when(k % 19 != 0, F.array(F.lit("%d/%m/%Y")))
    rows = table(spark, d, "part").select(
        F.concat(F.lit("t"), k.cast("string")).alias("template_id"), (k % 4).cast("int").alias("version"), F.element_at(status, (k % 5 + 1).cast("int")).alias("status"), strategy.alias("strategy"),
        F.struct(columns.alias("columns"), mode.alias("amount_mode"), formats.alias("date_formats")).alias("table"), rules.alias("header_rules"),
    )
    return Y.template_problems(rows)


def _template_files(spark, d):
    """A file per part: whole templates, and some with one mistake or another by part number."""
    rows = _files(spark, d).select("path", "bank_code", "layout_id", "version", "status", F.regexp_extract("path", r"^r0*(\d+)/", 1).cast("int").alias("k"))
    k = F.col("k")
    column = F.struct(F.lit("txn_date").alias("role"), F.lit(1.0).alias("x0"), F.when(k % 11 == 1, 1.0).otherwise(9.0).alias("x1"))
    table_of = F.struct(F.array(column).alias("columns"), F.array(F.lit("%d/%m/%Y")).alias("date_formats"), F.when(k % 2 == 0, 4.5).alias("line_tolerance"), F.when(k % 3 == 0, F.array(F.lit("nil"))).alias("empty_tokens"))
    rule = F.struct(F.lit("regex").alias("kind"), F.array(F.when(k % 13 == 1, "header.nonsense").otherwise("header.extra.x")).alias("targets"), F.lit("x").alias("pattern"))
    text = F.to_json(F.struct(F.when(k % 17 == 1, 2).otherwise(1).alias("format"), "bank_code", F.when(k % 19 != 1, "Bank").alias("bank_name"), "layout_id", "version", "status", F.array(F.lit("m")).alias("markers"), table_of.alias("table"), F.array(rule).alias("header_rules")))
    return rows.select("path", F.when(k % 23 == 1, F.lit("[]")).otherwise(text).alias("json"))


_CHECKED = REG + """, b AS (
  SELECT path, unnest(CASE WHEN k % 23 = 1 THEN ['not_an_object'] ELSE list_concat(CASE WHEN k % 17 = 1 THEN ['unsupported_format'] ELSE [] END, CASE WHEN k % 19 = 1 THEN ['missing_bank_name'] ELSE [] END, CASE WHEN k % 13 = 1 THEN ['unknown_target'] ELSE [] END,
    CASE WHEN k % 11 = 1 THEN ['empty_column'] ELSE [] END) END) AS error FROM (SELECT path, substr(path, 2, 9)::INT AS k FROM f)),
good AS (SELECT * FROM f WHERE path NOT IN (SELECT path FROM b)),
firsts AS (SELECT * FROM good WHERE NOT moved QUALIFY row_number() OVER (PARTITION BY bank_code, layout_id, version ORDER BY path) = 1)"""


@query("src7_checked_registry", f"WITH {_CHECKED} SELECT path, bank_code, layout_id, version, CASE WHEN substr(path, 2, 9)::INT % 2 = 0 THEN 4.5 END::DOUBLE AS line_tolerance, substr(path, 2, 9)::INT % 3 = 0 AS own_empties, ['balance_chain'] AS required_checks, [1] AS pages FROM firsts WHERE status = 'approved'")
def src7_checked_registry(spark, d):
    """Template files read as they stand: only those without a problem load."""
    rows = Y.loaded(stored(Y.parse_templates(_template_files(spark, d)), "templates"))
    return rows.select("path", "bank_code", "layout_id", "version", F.col("table.line_tolerance").alias("line_tolerance"), F.col("table.empty_tokens").isNotNull().alias("own_empties"), "required_checks", F.col("header_rules")[0]["pages"].alias("pages"))


@query("src7_refused_files", f"WITH {_CHECKED} SELECT path, error FROM b UNION ALL SELECT path, CASE WHEN moved THEN 'path_mismatch' ELSE 'duplicate' END FROM good WHERE path NOT IN (SELECT path FROM firsts)")
def src7_refused_files(spark, d):
    return Y.refused(stored(Y.parse_templates(_template_files(spark, d)), "templates"))


def _statements(spark, d):
    rows = ledger(spark, d).withColumn("description", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))
    money = {c: F.col(c).cast("decimal(18,0)") / 100 for c in ("debit", "credit", "balance")}
    heads = rows.select("doc").distinct().withColumn("header", F.create_map(F.lit("bank_name"), F.concat(F.lit("bank "), (F.col("doc") % 9).cast("string"))))
    return T.to_json(heads, rows.withColumns(money))


@query("src9_statement_codec", f"WITH {LEDGER_SQL} SELECT doc, i AS row_index, txn_date, 'order ' || o_orderkey AS description, debit, credit, balance FROM ledger")
def src9_statement_codec(spark, d):
    rows = T.transactions_of(T.from_json(_statements(spark, d)))
    return rows.select("doc", "row_index", "txn_date", "description", *[F.round(F.col(c) * 100).cast("long").alias(c) for c in ("debit", "credit", "balance")])


@query("src9_version_1", "SELECT c_custkey AS doc, c_name AS bank_name, c_custkey % 4 = 0 AS bad_money FROM customer")
def src9_version_1(spark, d):
    k = F.col("c_custkey")
    amount = F.when(k % 4 == 0, "12.345").otherwise("12.34")
    text = F.concat(F.lit('{"schema_version":"1","header":{"bank":"'), "c_name", F.lit('"},"transactions":[{"row_index":0,"txn_date":"2024-01-02","description":"x","debit":"'), amount, F.lit('"}]}'))
    return T.from_json(table(spark, d, "customer").select(k.alias("doc"), text.alias("json"))).select("doc", F.col("header")["bank_name"].alias("bank_name"), "bad_money")


@query("src11_first_password", "SELECT c_custkey AS doc, 'p' || c_custkey AS password, 2 AS n_candidates FROM customer")
def src11_first_password(spark, d):
    text = F.concat(F.lit("\n  \np"), F.col("c_custkey").cast("string"), F.lit("\n\nsecond\n"))
    return Y.first_password(table(spark, d, "customer").select(F.col("c_custkey").alias("doc"), text.alias("content")))


@query("snk8_export_csv", f"WITH {LEDGER_SQL} SELECT i AS row_index, CAST(txn_date AS VARCHAR) AS txn_date, debit::VARCHAR AS debit, credit::VARCHAR AS credit, o_orderkey::VARCHAR AS reference, 12 AS n_columns FROM ledger")
def snk8_export_csv(spark, d):
    from tallyspark.sources.tables import scratch

    path = scratch(spark, "export")
    rows = ledger(spark, d).select(F.col("i").alias("row_index"), "txn_date", "debit", "credit", F.col("o_orderkey").alias("reference"))
    T.export_csv(rows, path)
    back = spark.read.csv(path, header=True)
    return back.select(F.col("row_index").cast("int").alias("row_index"), "txn_date", "debit", "credit", "reference", F.lit(len(back.columns)).alias("n_columns"))


@query("snk8_header_rows", "SELECT c_custkey AS doc, 'c_name' AS field, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer")
def snk8_header_rows(spark, d):
    return T.header_rows(table(spark, d, "customer").withColumnRenamed("c_custkey", "doc"), ["c_name", "c_mktsegment"])


@query("snk8_by_prefix", "SELECT document_id FROM (SELECT DISTINCT sha256(text) AS document_id FROM documents) WHERE starts_with(document_id, '0a')")
def snk8_by_prefix(spark, d):
    docs = table(spark, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("document_id")).distinct()
    return T.documents_by_prefix(docs, "0a")


@query("snk7_new_template_version", "SELECT p_brand AS bank, 'layout-' || (p_size % 3) AS layout, max(p_partkey % 4 + 1) + 1 AS version FROM part GROUP BY ALL")
def snk7_new_template_version(spark, d):
    return _files(spark, d).groupBy(F.col("bank_code").alias("bank"), F.col("layout_id").alias("layout")).agg((F.max("version") + 1).cast("long").alias("version"))


@query("flt1_approved", f"WITH {REG} SELECT path FROM f WHERE status = 'approved'")
def flt1_approved(spark, d):
    return _files(spark, d).filter("status = 'approved'").select("path")


@query("pip4_regression_corpus", f"WITH {LEDGER_SQL} SELECT DISTINCT doc FROM ledger WHERE doc % 3 = 1 UNION SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0")
def pip4_regression_corpus(spark, d):
    """Verified documents and those of a manifest."""
    verified = ledger(spark, d).filter("doc % 3 = 1").select("doc")
    manifest = table(spark, d, "customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("doc"))
    return verified.unionByName(manifest).distinct()


