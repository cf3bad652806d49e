"""Queries over positioned words: lines, columns, pages, rows read from printed statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import money
from tallyspark.operators import lines as L
from tallyspark.operators import rows as R
from tallyspark.plans.bindings import LEDGER_SQL, ledger, spread, table
from tallyspark.plans.registry import query

TENTHS = 30
#: Tasks for each part of a scan whose texts are taken apart: a task that holds what becomes of a whole part would spill it.
FINER = 16


def words(spark, d, dealt: bool = False) -> DataFrame:
    """All words of all documents, set on pages in whole tenths of a point.

    ``dealt``: documents are dealt by their key while they are texts, so that what
    is made of them, many times as much, is grouped by document or page where it is.
    """
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    docs = docs.repartition(max(FINER * docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism), "doc") if dealt else spread(docs)
    each = docs.select("doc", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("p", "text"))
    p = F.col("p")
    x0 = (p % 8) * 600
    top = F.floor(p / 8) * 40 + (p * 7 % 5) * 6
    return each.select(
        "doc", (F.floor(p / 80) + 1).cast("int").alias("page"), p.alias("seq"), "text", x0.cast("int").alias("x0"),
        (x0 + F.least(F.length("text") * 60, F.lit(900))).cast("int").alias("x1"), top.cast("int").alias("top"), (top + 35).cast("int").alias("bottom"),
    )


WORDS_SQL = r"""
tokens AS (SELECT doc_id AS doc, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
placed AS (SELECT doc, unnest(ws) AS text, unnest(range(0, len(ws))) AS p FROM tokens),
words AS (
  SELECT doc, (p // 80 + 1)::INT AS page, p::INT AS seq, text, ((p % 8) * 600)::INT AS x0, ((p % 8) * 600 + least(length(text) * 60, 900))::INT AS x1,
         ((p // 8) * 40 + (p * 7 % 5) * 6)::INT AS top, ((p // 8) * 40 + (p * 7 % 5) * 6 + 35)::INT AS bottom FROM placed),
sorted AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY top, x0, seq) AS k FROM words),
walk AS (
  SELECT doc, page, k, top AS anchor, 0 AS line_no FROM sorted WHERE k = 1
  UNION ALL
  SELECT s.doc, s.page, s.k, CASE WHEN abs(s.top - w.anchor) > 30 THEN s.top ELSE w.anchor END, w.line_no + (abs(s.top - w.anchor) > 30)::INT
  FROM walk w JOIN sorted s ON s.doc = w.doc AND s.page = w.page AND s.k = w.k + 1),
lined AS (SELECT s.*, line_no, row_number() OVER (PARTITION BY s.doc, s.page, line_no ORDER BY x0, s.k) - 1 AS place FROM sorted s JOIN walk w USING (doc, page, k))"""


def _lines(spark, d) -> DataFrame:
    return L.group_lines(words(spark, d), TENTHS, F.col("top").cast("double"))


@query("lay1_lines", f"WITH RECURSIVE {WORDS_SQL} SELECT doc, page, seq, line_no::INT AS line_no, place::INT AS place FROM lined")
def lay1_lines(spark, d):
    return _lines(spark, d).select("doc", "page", "line_no", F.posexplode("ws").alias("place", "w")).select("doc", "page", F.col("w.seq").alias("seq"), "line_no", "place")


@query("lay2_page_text", f"WITH RECURSIVE {WORDS_SQL}, texts AS (SELECT doc, page, line_no, string_agg(text, ' ' ORDER BY place) AS t FROM lined GROUP BY ALL) SELECT doc, page, md5(string_agg(t, chr(10) ORDER BY line_no)) AS digest FROM texts GROUP BY doc, page")
def lay2_page_text(spark, d):
    return L.page_text(_lines(spark, d)).select("doc", "page", F.md5(F.col("text").cast("binary")).alias("digest"))


GRID = [("date", 0, 700), ("text", 700, 2500), ("debit", 2500, 3700), ("balance", 3700, 5000)]


@query("lay3_columns", f"""WITH RECURSIVE {WORDS_SQL}, cells AS (
  SELECT *, CASE WHEN (x0 + x1) / 2.0 < 700 THEN 0 WHEN (x0 + x1) / 2.0 < 2500 THEN 1 WHEN (x0 + x1) / 2.0 < 3700 THEN 2 WHEN (x0 + x1) / 2.0 < 5000 THEN 3 END AS c FROM lined),
judged AS (SELECT *, c IS NOT NULL AND x1 <= 5020 AND x0 >= [0, 700, 2500, 3700][c + 1] - 60 AND x1 <= [700, 2500, 3700, 5000][c + 1] + 60 AS good FROM cells)
SELECT doc, page, line_no::INT AS line_no, bool_and(coalesce(good, false)) AS fits, CASE WHEN bool_and(coalesce(good, false)) THEN coalesce(string_agg(text, ' ' ORDER BY place) FILTER (WHERE c = 1), '') END AS words FROM judged GROUP BY doc, page, line_no""")
def lay3_columns(spark, d):
    rows = L.assign_columns(_lines(spark, d), GRID, 20)
    text = F.filter("cells", lambda c: c["role"] == "text")
    return rows.select("doc", "page", "line_no", "fits", F.when(F.col("fits"), F.coalesce(F.array_join(F.try_element_at(text, F.lit(1))["words"], " "), F.lit(""))).alias("words"))


TOKENS = ["the", "of", "and", "to", "in", "is", "la", "de", "der", "die", "que", "The", "La", "De"]


@query("lay4_header_lines", f"""WITH RECURSIVE {WORDS_SQL} SELECT doc, page, line_no::INT AS line_no, count(*) >= 2 AND bool_and(text IN ({', '.join(repr(t) for t in TOKENS)})) AS header FROM lined GROUP BY ALL""")
def lay4_header_lines(spark, d):
    return _lines(spark, d).select("doc", "page", "line_no", L.is_header_line(F.col("ws"), TOKENS, 2).alias("header"))


@query("lay5_row_starts", f"""WITH RECURSIVE {WORDS_SQL}, dated AS (SELECT doc, page, line_no, string_agg(text, ' ' ORDER BY place) FILTER (WHERE (x0 + x1) / 2.0 >= -20 AND (x0 + x1) / 2.0 < 1320) AS t FROM lined GROUP BY ALL)
SELECT doc, page, line_no::INT AS line_no, coalesce(regexp_matches(t, '(?i)^[0-9]{{1,2}}($|[\\s/.-])|^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\\.?\\s+[0-9]{{1,2}}\\b'), false) AS starts FROM dated""")
def lay5_row_starts(spark, d):
    return _lines(spark, d).select("doc", "page", "line_no", L.starts_row(F.col("ws"), 0, 1300, 20).alias("starts"))


@query("src10_classify", rf"""WITH tokens AS (SELECT doc_id AS doc, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
pages AS (SELECT doc, unnest(range(1, len(ws) // 80 + 2)) AS page, ws FROM tokens),
chars AS (SELECT doc, page, coalesce(list_sum(list_transform(ws[(page - 1) * 80 + 1:page * 80], lambda w: length(w))), 0) AS n FROM pages)
SELECT doc, CASE WHEN count(*) FILTER (WHERE n < 20) = 0 THEN 'TEXT' WHEN count(*) FILTER (WHERE n < 20) = count(*) THEN 'SCANNED' ELSE 'MIXED' END AS kind, count(*) AS n_pages, coalesce(list(page::INT ORDER BY page) FILTER (WHERE n < 20), []) AS scanned FROM chars GROUP BY doc""")
def src10_classify(spark, d):
    """Every document has one page more than its full ones, so some last pages have little or no text."""
    n = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.sequence(F.lit(1), (F.floor(n / 80) + 1).cast("int"))).alias("page"))
    return L.classify_pages(pages, words(spark, d))


@query("det1_detection_text", f"""WITH RECURSIVE {WORDS_SQL}, texts AS (SELECT doc, page, line_no, string_agg(text, ' ' ORDER BY place) AS t FROM lined GROUP BY ALL),
pages AS (SELECT doc, page, string_agg(t, chr(10) ORDER BY line_no) AS t, max(page) OVER (PARTITION BY doc) AS last FROM texts GROUP BY doc, page)
SELECT doc, md5(string_agg(t, chr(10) ORDER BY page)) AS digest FROM pages WHERE page IN (1, 2) OR page = last GROUP BY doc""")
def det1_detection_text(spark, d):
    """Pages 1, 2 and the last: chosen before lines are built, so the others are never grouped."""
    ws = words(spark, d)
    last = ws.groupBy("doc").agg(F.max("page").alias("last"))
    kept = ws.join(last, "doc").filter("page in (1, 2) or page = last").drop("last")
    pages = L.page_text(L.group_lines(kept, TENTHS, F.col("top").cast("double")))
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("doc").agg(F.md5(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").cast("binary")).alias("digest"))


@query("fn21_midpoints", f"WITH RECURSIVE {WORDS_SQL} SELECT doc, page, sum(x0 + x1)::BIGINT AS doubled_mid, bool_or(trim(text) <> '') AS has_text FROM words GROUP BY doc, page")
def fn21_midpoints(spark, d):
    return words(spark, d).groupBy("doc", "page").agg(F.sum(F.col("x0") + F.col("x1")).alias("doubled_mid"), F.bool_or(F.trim("text") != "").alias("has_text"))


# Statements printed from the ledger view and read back: the oracle is the ledger itself.
SPEC = R.TableSpec(
    columns=(("txn_date", 30.0, 95.0), ("description", 95.0, 305.0), ("debit", 305.0, 385.0), ("credit", 385.0, 465.0), ("balance", 465.0, 560.0)),
    date_formats=("%d/%m/%Y",), header_tokens=("Date", "Details", "Debit", "Credit", "Balance"),
)
PER_PAGE = 25


def statement_words(spark, d) -> DataFrame:
    """The ledger on pages: a heading, two lines to a row, a footer."""
    rows = ledger(spark, d)
    amount = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.format_number(F.col(c).cast("decimal(18,0)") / 100, 2))
    page, y = (F.floor(F.col("i") / PER_PAGE) + 1).cast("int"), 80.0 + (F.col("i") % PER_PAGE) * 24.0

    def word(text, x0: float, x1: float, top) -> F.Column:
        return F.struct(F.lit(text).alias("text") if isinstance(text, str) else text.alias("text"), F.lit(x0).alias("x0"), F.lit(x1).alias("x1"), (F.lit(top) if isinstance(top, float) else top).alias("top"))

    body = [
        word(F.date_format("txn_date", "dd/MM/yyyy"), 32.0, 80.0, y), word("ORDER", 100.0, 130.0, y + 0.4), word(F.col("o_orderkey").cast("string"), 135.0, 180.0, y),
        word(amount("debit"), 310.0, 380.0, y + 0.8), word(amount("credit"), 390.0, 460.0, y), word(amount("balance"), 470.0, 555.0, y),
        word("second", 100.0, 140.0, y + 11.0), word("line", 145.0, 165.0, y + 11.0),
    ]
    head = [word(t, x, x + 40.0, 50.0) for t, x in (("Date", 32.0), ("Details", 100.0), ("Debit", 330.0), ("Credit", 410.0), ("Balance", 490.0))]
    foot = [word("Page", 4.0, 24.0, 760.0), word("of", 26.0, 34.0, 760.0)]
    first = F.when(F.col("i") % PER_PAGE == 0, F.array(*head, *foot)).otherwise(F.array().cast("array<struct<text:string,x0:double,x1:double,top:double>>"))
    each = rows.select("doc", page.alias("page"), "i", F.posexplode(F.concat(F.array(*body), first)).alias("k", "w"))
    return each.select("doc", "page", (F.col("i") * 100 + F.col("k")).alias("seq"), "w.text", "w.x0", "w.x1", "w.top", (F.col("w.top") + 9.0).alias("bottom"))


@query("lay6_statement_rows", f"WITH {LEDGER_SQL} SELECT doc, i::BIGINT AS row, (i // 25 + 1)::INT AS page, strftime(txn_date, '%d/%m/%Y') AS date_text, 'ORDER ' || o_orderkey || ' second line' AS details FROM ledger")
def lay6_statement_rows(spark, d):
    rows = R.assemble_rows(L.group_lines(statement_words(spark, d)), SPEC)
    return rows.select("doc", "row", "page", F.col("cells")["txn_date"].alias("date_text"), F.col("cells")["description"].alias("details"))


@query("lay9_transactions", f"WITH {LEDGER_SQL} SELECT doc, i AS row_index, txn_date, 'ORDER ' || o_orderkey || ' second line' AS description, debit, credit, balance FROM ledger")
def lay9_transactions(spark, d):
    t = R.transactions(R.assemble_rows(L.group_lines(statement_words(spark, d)), SPEC), SPEC)
    return t.select("doc", "row_index", "txn_date", "description", *[money.to_cents(F.col(c)).alias(c) for c in ("debit", "credit", "balance")])


@query("lay9_problems", f"WITH {LEDGER_SQL} SELECT doc, i::BIGINT AS row, 'unparseable_date' AS code FROM ledger WHERE i % 10 = 3")
def lay9_problems(spark, d):
    rows = R.assemble_rows(L.group_lines(statement_words(spark, d)), SPEC)
    spoiled = rows.withColumn("cells", F.when(F.col("row") % 10 == 3, F.map_zip_with("cells", F.create_map(F.lit("txn_date"), F.lit("31/02/2024")), lambda k, a, b: F.coalesce(b, a))).otherwise(F.col("cells")))
    return R.problems(spoiled, SPEC).select("doc", "row", "code")


@query("lay6_skipped_text", f"WITH {LEDGER_SQL}, n AS (SELECT doc, count(*) AS n FROM ledger GROUP BY doc) SELECT doc, 1 AS page, 'early_end' AS reason, (least(n, 25) - 1)::BIGINT AS rows_after, 0::BIGINT AS near_row FROM n WHERE n > 1")
def lay6_skipped_text(spark, d):
    """Statements whose first page has a stray line after its first row, where the table seems to end."""
    ws = statement_words(spark, d)
    stray = ws.filter("page = 1").groupBy("doc").agg(F.lit(1).alias("page"), F.lit(50).cast("int").alias("seq"), F.lit("stray").alias("text"), F.lit(2.0).alias("x0"), F.lit(20.0).alias("x1"), F.lit(97.5).alias("top"), F.lit(99.0).alias("bottom"))
    lines = L.group_lines(ws.unionByName(stray.select(*ws.columns)), 1.5)
    return R.skipped_text(lines, SPEC).filter("reason = 'early_end'").select("doc", "page", "reason", "rows_after", F.coalesce("near_row", F.lit(-1).cast("long")).alias("near_row"))


@query("win6_forward_frame", f"""WITH RECURSIVE {WORDS_SQL}, marked AS (SELECT doc, page, line_no, bool_or(regexp_matches(text, '[,.]$')) AS hit FROM lined GROUP BY ALL)
SELECT doc, page, line_no::INT AS line_no, hit, count(*) FILTER (WHERE hit) OVER (PARTITION BY doc, page ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) >= 2 AS dense FROM marked""")
def win6_forward_frame(spark, d):
    rows = _lines(spark, d).select("doc", "page", "line_no", F.exists("ws", lambda w: w["text"].rlike("[,.]$")).alias("hit"))
    ahead = Window.partitionBy("doc", "page").orderBy("line_no").rowsBetween(0, 14)
    return rows.withColumn("dense", F.count_if("hit").over(ahead) >= 2)
