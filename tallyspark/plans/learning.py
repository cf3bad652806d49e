"""Queries of learning, markers, header rules and text checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import normalise_heading
from tallyspark.operators import learning as N
from tallyspark.operators.headers import RegexRule, apply_regex_rules, block_values, region_text
from tallyspark.operators.lines import group_lines, page_text
from tallyspark.plans.bindings import LEDGER_SQL, ledger, table
from tallyspark.plans.registry import query
from tallyspark.plans.words import WORDS_SQL, _lines, statement_words


def headings(spark, d) -> DataFrame:
    """Each part's name and type as a heading; small parts take their brand as its role, others their type."""
    role = F.when(F.col("p_type") == "SMALL", F.col("p_brand")).otherwise(F.col("p_type"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc"), normalise_heading(F.concat("p_name", F.lit(" "), "p_type")).alias("heading"), role.alias("role"))


HEAD_SQL = r"""heads AS (SELECT p_partkey AS doc, CASE WHEN p_type = 'SMALL' THEN p_brand ELSE p_type END AS role, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9/.]+', ' ', 'g')) AS raw FROM part),
toks AS (SELECT doc, role, list_filter(list_transform(string_split(raw, ' '), lambda w: trim(w, '.')), lambda w: w <> '') AS ws FROM heads),
named AS (SELECT doc, role, CASE WHEN regexp_matches(array_to_string(ws, ' '), '[0-9]') OR len(list_distinct(ws)) > 5 THEN '' ELSE array_to_string(list_filter(ws, lambda w, i: list_position(ws, w) = i), ' ') END AS heading FROM toks)"""


@query("agg10_vocabulary", f"WITH {HEAD_SQL} SELECT heading, min(role) AS role FROM named WHERE heading <> '' GROUP BY heading HAVING count(DISTINCT role) = 1")
def agg10_vocabulary(spark, d):
    return N.vocabulary(headings(spark, d))


@query("lrn7_vocabulary_roles", "SELECT p_partkey AS doc, unnest([0, 1, 2, 3]) AS c, unnest(['txn_date', 'description', 'balance', 'debit']) AS role FROM part WHERE p_partkey % 3 = 0")
def lrn7_vocabulary_roles(spark, d):
    heads = F.array(*[F.struct(F.lit(k).alias("c"), F.lit(h).alias("heading"), F.lit(w).alias("word_role")) for k, (h, w) in enumerate((("date", "txn_date"), ("particulars", "description"), ("balance", "balance"), ("paid out", None)))])
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.inline(heads))
    rows = rows.withColumn("heading", F.when((F.col("doc") % 3 == 1) & (F.col("c") == 3), "other").when((F.col("doc") % 3 == 2) & (F.col("c") == 1), "paid out").otherwise(F.col("heading")))
    vocab = spark.createDataFrame([("paid out", "debit")], "heading string, role string")
    return N.vocabulary_roles(rows, vocab)


@query("top1_nearest", r"""WITH b AS (SELECT item_id, list_distinct(string_split(text, ' ')) AS ws FROM benchmark), q AS (SELECT * FROM b WHERE item_id % 2 = 0), x AS (SELECT * FROM b WHERE item_id % 2 = 1),
s AS (SELECT q.item_id AS doc, x.item_id AS example, len(list_intersect(q.ws, x.ws)) AS n, len(q.ws) + len(x.ws) AS t FROM q, x)
SELECT doc, example, n::DOUBLE / (t - n) AS score, row_number() OVER (PARTITION BY doc ORDER BY n::DOUBLE / (t - n) DESC, example) AS nth FROM s WHERE n > 0 QUALIFY nth <= 3""")
def top1_nearest(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.split("text", " ").alias("words"))
    return N.nearest(rows.filter("item_id % 2 = 0").withColumnRenamed("item_id", "doc"), rows.filter("item_id % 2 = 1").withColumnRenamed("item_id", "example"))


@query("lrn8_few_shot", "SELECT p_partkey AS doc, '\"' || p_name || '\" -> a; \"' || p_type || '\" -> b' AS line FROM part")
def lrn8_few_shot(spark, d):
    each = F.array(F.struct(F.lit(0).alias("c"), F.col("p_name").alias("heading"), F.lit("a").alias("role")), F.struct(F.lit(1).alias("c"), F.lit("").alias("heading"), F.lit("x").alias("role")), F.struct(F.lit(2).alias("c"), F.col("p_type").alias("heading"), F.lit("b").alias("role")))
    return N.few_shot(table(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.inline(each)))


@query("jn7_roles_by_overlap", """WITH f AS (SELECT p_partkey AS doc, unnest([0, 1, 2]) AS c, unnest([p_size * 3, p_size * 3 + 60, 400]) AS x0, unnest([p_size * 3 + 50, p_size * 3 + 110, 450]) AS x1 FROM part),
k(role, k0, k1) AS (VALUES ('txn_date', 0, 80), ('description', 80, 150), ('balance', 150, 300), ('debit', 150, 300)), j AS (SELECT doc, c, role, least(x1, k1) - greatest(x0, k0) AS o FROM f, k)
SELECT doc, c, CASE WHEN o > 0 THEN role ELSE 'ignore' END AS role FROM j QUALIFY row_number() OVER (PARTITION BY doc, c ORDER BY o DESC, role DESC) = 1""")
def jn7_roles_by_overlap(spark, d):
    x = F.col("p_size") * 3
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("doc"), "p_size")
    spans = F.array(*[F.struct(F.lit(c).alias("c"), a.alias("x0"), b.alias("x1")) for c, (a, b) in enumerate(((x, x + 50), (x + 60, x + 110), (F.lit(400), F.lit(450))))])
    known = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(a).alias("x0"), F.lit(b).alias("x1")) for r, a, b in (("txn_date", 0, 80), ("description", 80, 150), ("balance", 150, 300), ("debit", 150, 300))])
    return N.roles_by_overlap(parts.select("doc", F.inline(spans)), parts.select("doc", F.inline(known)))


def _label_pages(spark, d) -> DataFrame:
    """Pages that print a customer's fields with labels."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    k = F.col("c_custkey")
    text = F.concat(
        F.lit("Welcome Account Number : "), k.cast("string"), F.lit(" Branch Code: "), (k % 17).cast("string"), F.lit("\nName: "), "c_name", F.when(k % 2 == 0, F.lit("\nClosing Balance : ")).otherwise(F.lit("\nSecret Plan: ")), F.col("c_acctbal").cast("string"),
        F.lit("\nDate Value Date Amount (INR)\nsee: Page"), F.when(k % 5 == 0, F.lit("\nStatement of account\nName: again")).otherwise(F.lit("")),
    )
    return c.select(k.alias("doc"), "c_name", text.alias("text"))


@query("lrn10_candidate_labels", "SELECT c_custkey AS doc, list_concat(['Account Number', 'Branch Code', 'Name'], CASE WHEN c_custkey % 2 = 0 THEN ['Closing Balance'] ELSE [] END) AS labels FROM customer")
def lrn10_candidate_labels(spark, d):
    return _label_pages(spark, d).select("doc", N.candidate_labels(F.col("text")).alias("labels"))


@query("lrn10_heading_runs", "SELECT c_custkey AS doc, ['Date Value Date Amount (INR)'] AS runs FROM customer")
def lrn10_heading_runs(spark, d):
    return _label_pages(spark, d).select("doc", N.heading_runs(F.col("text"), ["Date", "Value", "Amount", "(INR)"]).alias("runs"))


@query("top2_markers", "SELECT c_custkey AS doc, list_concat(['Account Number', 'Branch Code'], CASE WHEN c_custkey % 2 = 0 THEN ['Closing Balance', 'Name'] ELSE ['Name'] END) AS markers FROM customer")
def top2_markers(spark, d):
    pages = _label_pages(spark, d)
    return pages.select("doc", N.choose_markers(N.candidate_labels(F.col("text")), F.array("c_name"), F.array(F.lit("Value Date"))).alias("markers"))


@query("lrn2_accept", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'extraction_problems' WHEN o_orderkey % 13 = 0 THEN 'no_rows' WHEN o_orderstatus = 'F' THEN 'rows_unverified' WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'rows_unverified' WHEN o_orderkey % 5 = 0 THEN 'markers_weak' END WHEN o_orderkey % 3 = 1 THEN 'rows_unverified' WHEN o_orderkey % 5 = 0 THEN 'markers_weak' END AS code FROM orders")
def lrn2_accept(spark, d):
    k = F.col("o_orderkey")
    check = lambda status, only: F.array(F.struct(F.lit("balance_chain").alias("name"), F.lit(status).alias("status"), F.lit(4).alias("rows_checked"), only.alias("only_no_opening")))
    none = F.array().cast("array<struct<name:string,status:string,rows_checked:int,only_no_opening:boolean>>")
    rows = table(spark, d, "orders").select(k, (k % 11 == 0).cast("int").alias("n_problems"), (k % 13).alias("n_rows"), F.when(F.col("o_orderstatus") == "F", "FAIL").otherwise("WARN").alias("status"), F.when(k % 3 == 0, check("WARN", k % 2 == 1)).when(k % 3 == 1, none).otherwise(check("PASS", F.lit(False))).alias("required"), F.when(k % 5 == 0, 1).otherwise(3).alias("n_markers"))
    return rows.select("o_orderkey", N.acceptance().alias("code"))


@query("jn8_ambiguous_markers", r"SELECT doc_id AS doc, lang AS layout FROM documents WHERE lang <> 'en' AND regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])de([^\p{L}\p{N}_]|$)') AND regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])la([^\p{L}\p{N}_]|$)')")
def jn8_ambiguous_markers(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("lang").alias("layout"), "text")
    return N.ambiguous_markers(texts, ["de", "la"], "en")


@query("pip6_registry_layout", """WITH r AS (SELECT p_brand AS bank, 'layout-' || (p_size % 5) AS layout, p_partkey AS version, p_size % 5 AS m FROM part), t AS (SELECT bank, layout, max(version) AS top, any_value(m) AS m FROM r GROUP BY ALL)
SELECT s_suppkey AS candidate, b.bank, t.layout, coalesce(t.top, 0) + 1 AS version FROM (SELECT s_suppkey, 'Brand#' || (s_suppkey % 30) AS bank, s_suppkey % 7 AS m FROM supplier) b LEFT JOIN t ON t.bank = b.bank AND t.m = b.m""")
def pip6_registry_layout(spark, d):
    marks = lambda n, flip: F.when(flip, F.array(F.concat(F.lit("m"), n.cast("string")), F.lit("z"))).otherwise(F.array(F.lit("z"), F.concat(F.lit("m"), n.cast("string")), F.lit("z")))
    known = table(spark, d, "part").select(F.col("p_brand").alias("bank"), F.concat(F.lit("layout-"), (F.col("p_size") % 5).cast("string")).alias("layout"), F.col("p_partkey").alias("version"), marks(F.col("p_size") % 5, F.lit(True)).alias("markers"))
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("candidate"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 30).cast("string")).alias("bank"), marks(F.col("s_suppkey") % 7, F.lit(False)).alias("markers"))
    return N.same_markers(new, known)


def _descriptions(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 19 == 0, "  ").when(k % 23 == 0, F.concat("p_name", F.lit(" WDL TFR"))).when(k % 7 == 0, F.concat("p_name", F.lit(" paid to"))).otherwise(F.concat(F.lit("paid to "), "p_name"))
    return table(spark, d, "part").select(F.col("p_brand").alias("doc"), k.alias("i"), text.alias("description"))


DESC_SQL = """descr AS (SELECT p_brand AS doc, p_partkey AS i, upper(CASE WHEN p_partkey % 19 = 0 THEN '' WHEN p_partkey % 23 = 0 THEN p_name || ' WDL TFR' WHEN p_partkey % 7 = 0 THEN p_name || ' paid to' ELSE 'paid to ' || p_name END) AS t FROM part),
dn AS (SELECT doc, count(*) AS n FROM descr WHERE t <> '' GROUP BY doc),
starts AS (SELECT doc, h, count(*) AS c FROM (SELECT doc, split_part(t, ' ', 1) AS h FROM descr WHERE len(string_split(t, ' ')) > 1 AND t <> '' UNION ALL SELECT doc, split_part(t, ' ', 1) || ' ' || split_part(t, ' ', 2) FROM descr WHERE len(string_split(t, ' ')) > 2) GROUP BY doc, h)"""


@query("val7_text_issues", f"""WITH {DESC_SQL} SELECT doc, i AS row_index, 'empty_description' AS code FROM descr WHERE t = ''
UNION ALL SELECT doc, i, 'description_start_at_end' FROM descr d WHERE EXISTS (SELECT 1 FROM starts s JOIN dn USING (doc) WHERE s.doc = d.doc AND n >= 5 AND c >= 0.3 * n AND ends_with(d.t, ' ' || h)) OR ends_with(t, ' WDL TFR')""")
def val7_text_issues(spark, d):
    return N.text_issues(_descriptions(spark, d))


@query("agg4_common_starts", f"WITH {DESC_SQL} SELECT doc, h AS head, c FROM starts JOIN dn USING (doc) WHERE c >= 0.3 * n AND NOT contains(h, ' ')")
def agg4_common_starts(spark, d):
    return N.common_starts(_descriptions(spark, d))


@query("set6_label_words", "SELECT c_custkey, list_sort(list_concat(['customer'], CASE WHEN c_custkey % 2 = 0 THEN ['branch'] ELSE [] END, CASE WHEN c_custkey % 3 = 0 THEN ['address'] ELSE [] END)) AS hits FROM customer")
def set6_label_words(spark, d):
    k = F.col("c_custkey")
    value = F.concat("c_name", F.when(k % 2 == 0, F.lit(", Branch BRANCH")).otherwise(F.lit(", branches")), F.when(k % 3 == 0, F.lit(" (address:)")).otherwise(F.lit("")))
    return table(spark, d, "customer").select("c_custkey", N.label_words_in(value).alias("hits"))


@query("val8_text_status", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN 'WARN' ELSE 'PASS' END WHEN 1 THEN 'FAIL' ELSE 'WARN' END AS status FROM events")
def val8_text_status(spark, d):
    e = F.col("event_id")
    status = F.when(e % 3 == 0, "PASS").when(e % 3 == 1, "FAIL").otherwise("WARN")
    return table(spark, d, "events").select("event_id", N.with_text_status(status, F.when(e % 2 == 0, "WARN").otherwise("PASS")).alias("status"))


RULES = [
    RegexRule(("header.a", "header.b"), (1,), r"(?i)\bof\s+(\w+)\s+(\w+)"),
    RegexRule(("header.a",), (-1, 1), r"(?i)\bthe\s+(\w+)"),
    RegexRule(("header.c",), (2, 1), r"(?i)\band\s+(\w+)"),
]


@query("hdr1_regex_rules", rf"""WITH RECURSIVE {WORDS_SQL}, texts AS (SELECT doc, page, line_no, string_agg(text, ' ' ORDER BY place) AS t FROM lined GROUP BY ALL),
pages AS (SELECT doc, page, string_agg(t, chr(10) ORDER BY line_no) AS t, max(page) OVER (PARTITION BY doc) AS n FROM texts GROUP BY doc, page),
m AS (
  SELECT doc, 0 AS rule, 0 AS k, page, regexp_extract(t, '(?i)(?:^|[^\p{{L}}\p{{N}}_])of\s+([\p{{L}}\p{{N}}_]+)\s+([\p{{L}}\p{{N}}_]+)', 1) AS v1, regexp_extract(t, '(?i)(?:^|[^\p{{L}}\p{{N}}_])of\s+([\p{{L}}\p{{N}}_]+)\s+([\p{{L}}\p{{N}}_]+)', 2) AS v2 FROM pages WHERE page = 1
  UNION ALL SELECT doc, 1, CASE WHEN page = n THEN 0 ELSE 1 END, page, regexp_extract(t, '(?i)(?:^|[^\p{{L}}\p{{N}}_])the\s+([\p{{L}}\p{{N}}_]+)', 1), NULL FROM pages WHERE page IN (1, n)
  UNION ALL SELECT doc, 2, CASE WHEN page = 2 THEN 0 ELSE 1 END, page, regexp_extract(t, '(?i)(?:^|[^\p{{L}}\p{{N}}_])and\s+([\p{{L}}\p{{N}}_]+)', 1), NULL FROM pages WHERE page IN (1, 2)),
f AS (SELECT * FROM m WHERE v1 <> '' QUALIFY row_number() OVER (PARTITION BY doc, rule ORDER BY k) = 1),
v AS (SELECT doc, 'header.a' AS target, v1 AS value, rule, page FROM f WHERE rule < 2 UNION ALL SELECT doc, 'header.b', v2, rule, page FROM f WHERE rule = 0 UNION ALL SELECT doc, 'header.c', v1, rule, page FROM f WHERE rule = 2)
SELECT doc, target, value, rule, page FROM v QUALIFY row_number() OVER (PARTITION BY doc, target ORDER BY rule) = 1""")
def hdr1_regex_rules(spark, d):
    return apply_regex_rules(page_text(_lines(spark, d)), RULES)


@query("hdr2_region_text", f"WITH {LEDGER_SQL} SELECT doc, (i // 25 + 1)::INT AS page, string_agg('ORDER ' || o_orderkey, '/' ORDER BY i) AS text FROM ledger WHERE i % 25 = 0 GROUP BY ALL")
def hdr2_region_text(spark, d):
    """Between the heading and the first wrapped line, in the description's column."""
    return region_text(group_lines(statement_words(spark, d)), after="^Date Details", before="^second", x_min=95.0, x_max=305.0, join="/")


@query("hdr3_block_values", "SELECT c_custkey AS doc, 1 AS page, 'House ' || c_custkey || ' ' || c_name || CASE WHEN c_custkey % 2 = 0 THEN ' ' || c_mktsegment ELSE '' END AS value FROM customer WHERE c_custkey % 5 <> 0")
def hdr3_block_values(spark, d):
    """Addresses that go on under their label, in its column; every second one's last line is too far away, every fifth has no label."""
    k = F.col("c_custkey")
    word = lambda text, x0, x1, top: F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(x0).alias("x0"), F.lit(x1).alias("x1"), (F.lit(top) if isinstance(top, float) else top).alias("top"))
    label = F.when(k % 5 == 0, "note").otherwise("address:")
    far = F.when(k % 2 == 0, 122.0).otherwise(200.0)
    ws = F.array(word("Customer", 30.0, 70.0, 100.0), word(label, 74.0, 110.0, 100.0), word("House", 130.0, 160.0, 100.0), word(k.cast("string"), 165.0, 195.0, 100.0), word("aside", 400.0, 430.0, 100.0), word(F.col("c_name"), 130.0, 220.0, 111.0), word(F.col("c_mktsegment"), 130.0, 190.0, far))
    rows = table(spark, d, "customer").select(k.alias("doc"), F.lit(1).alias("page"), F.posexplode(ws).alias("seq", "w")).select("doc", "page", "seq", "w.text", "w.x0", "w.x1", "w.top", (F.col("w.top") + 9.0).alias("bottom"))
    return block_values(group_lines(rows), r"\b(?:Account\s+holder|Customer)\s+address\s*:")
