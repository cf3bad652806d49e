"""Queries of the scalar functions.

Dates and amounts are printed from typed columns and read back, so the oracle
is the typed column and shares nothing with the parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import dates, money, text
from tallyspark.plans.bindings import cents, spread, table
from tallyspark.plans.registry import query

PRINTED_DATES = ("dd/MM/yyyy", "dd-MM-yyyy", "d.M.yyyy", "dd MMM yyyy", "dd-MMM-yy", "dd MMMM yyyy", "yyyy-MM-dd")


def _pick(n: Column, options: list[Column]) -> Column:
    return F.element_at(F.array(*options), (F.pmod(n, F.lit(len(options))) + 1).cast("int"))


def printed_cells(spark, d) -> DataFrame:
    """lineitem as printed: a date in the format of its line number, an amount in the style of its order."""
    rows = spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice"))
    day = F.col("l_shipdate").cast("date")
    amount = cents(F.col("l_extendedprice"))
    plain = F.concat((amount / 100).cast("long").cast("string"), F.lit("."), F.lpad((amount % 100).cast("string"), 2, "0"))
    grouped = F.format_number(amount.cast("decimal(18,0)") / 100, 2)
    styles = [plain, grouped, F.concat(grouped, F.lit("CR")), F.concat(grouped, F.lit(" Dr.")), F.concat(F.lit("("), plain, F.lit(")")), F.concat(plain, F.lit("-")), F.concat(F.lit("Rs. "), grouped), F.concat(F.lit("  -$ "), plain, F.lit(" "))]
    shown = F.when(F.col("l_orderkey") % 17 == 0, "-").otherwise(_pick(F.col("l_orderkey"), styles))
    return rows.select("l_orderkey", "l_linenumber", _pick(F.col("l_linenumber") - 1, [F.date_format(day, p) for p in PRINTED_DATES]).alias("date_text"), shown.alias("amount_text"))


@query("fn2_parse_date", "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS on_date FROM lineitem")
def fn2_parse_date(spark, d):
    return printed_cells(spark, d).select("l_orderkey", "l_linenumber", dates.parse_date(F.col("date_text")).alias("on_date"))


@query("fn2_parse_date_month_first", "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS on_date FROM lineitem")
def fn2_parse_date_month_first(spark, d):
    day = F.col("l_shipdate").cast("date")
    shown = _pick(F.col("l_linenumber"), [F.date_format(day, p) for p in ("MM/dd/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MM/dd/yy", "MM-dd-yyyy")])
    order = dates.header_formats(["%m/%d/%Y"])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", dates.parse_date(shown, order).alias("on_date"))


@query("lay10_resolve_years", "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS on_date FROM lineitem")
def lay10_resolve_years(spark, d):
    """Dates printed without a year, and the period that ends up to 300 days later."""
    day = F.col("l_shipdate").cast("date")
    shown = F.date_format(day, "MMM d")
    end = F.date_add(day, F.col("l_linenumber") * 40)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", dates.resolve_year(dates.parse_date(shown), F.lit(None).cast("date"), end).alias("on_date"))


@query("fn3_complete_date", "SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS complete FROM lineitem")
def fn3_complete_date(spark, d):
    whole = F.date_format("l_shipdate", "dd MMM yyyy")
    shown = F.when(F.col("l_linenumber") % 2 == 0, whole).otherwise(F.regexp_replace(whole, r" \d{4}$", ""))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", dates.is_date(shown, ["%d %b %Y"]).alias("complete"))


@query("fn4_looks_like_date", "SELECT doc_id, coalesce(regexp_matches(trim(regexp_replace(text, '\\s+', ' ', 'g')), '(?i)^[0-9]{1,2}($|[\\s/.-])|^[0-9]{4}-[0-9]{2}-[0-9]{2}|^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\\.?\\s+[0-9]{1,2}\\b'), false) AS starts FROM documents")
def fn4_looks_like_date(spark, d):
    return table(spark, d, "documents").select("doc_id", dates.looks_like_date(F.col("text")).alias("starts"))


_AMOUNT_TRUTH = """SELECT l_orderkey, l_linenumber, true AS ok, CASE WHEN l_orderkey % 17 = 0 THEN NULL WHEN l_orderkey % 8 IN (4, 5, 7) THEN -CAST(round(l_extendedprice * 100) AS BIGINT) ELSE CAST(round(l_extendedprice * 100) AS BIGINT) END AS amount,
CASE WHEN l_orderkey % 17 = 0 THEN NULL WHEN l_orderkey % 8 = 2 THEN 'CR' WHEN l_orderkey % 8 = 3 THEN 'DR' END AS suffix FROM lineitem"""


@query("fn5_parse_amount", _AMOUNT_TRUTH)
def fn5_parse_amount(spark, d):
    found = printed_cells(spark, d).withColumn("a", money.parse_amount(F.col("amount_text")))
    return found.select("l_orderkey", "l_linenumber", F.col("a.ok").alias("ok"), money.to_cents(F.col("a.value")).alias("amount"), F.col("a.suffix").alias("suffix"))


@query("fn6_is_amount", "SELECT l_orderkey, l_linenumber, l_orderkey % 17 <> 0 AS amount, false AS date_is_amount FROM lineitem WHERE l_linenumber <> 3")
def fn6_is_amount(spark, d):
    return printed_cells(spark, d).filter("l_linenumber <> 3").select("l_orderkey", "l_linenumber", money.is_amount(F.col("amount_text")).alias("amount"), money.is_amount(F.col("date_text")).alias("date_is_amount"))


@query("fn9_any_date", "SELECT l_orderkey, l_linenumber, true AS a_date, l_orderkey % 17 = 0 AND false AS amount_is_date FROM lineitem WHERE l_orderkey % 8 <> 5")
def fn9_any_date(spark, d):
    return printed_cells(spark, d).filter("l_orderkey % 8 <> 5").select("l_orderkey", "l_linenumber", dates.is_date(F.col("date_text")).alias("a_date"), dates.is_date(F.col("amount_text")).alias("amount_is_date"))


@query("fn7_header_formats", """SELECT * FROM (SELECT 'day' AS locale, unnest(['%d-%m-%Y','%d/%m/%Y','%d.%m.%Y','%d/%m/%y','%d-%m-%y','%d %b %Y','%d-%b-%Y','%d %b %y','%d-%b-%y','%d %B %Y','%Y-%m-%d','%m/%d/%Y','%m/%d/%y','%m-%d-%Y','%b %d, %Y','%B %d, %Y','%b %d %Y','%b. %d, %Y','%m/%d','%b %d']) AS format, unnest(range(0, 20)) AS place
UNION ALL SELECT 'month', unnest(['%m/%d/%y','%m/%d/%Y','%m-%d-%Y','%b %d, %Y','%B %d, %Y','%b %d %Y','%b. %d, %Y','%m/%d','%b %d','%d/%m/%Y','%d-%m-%Y','%d.%m.%Y','%d/%m/%y','%d-%m-%y','%d %b %Y','%d-%b-%Y','%d %b %y','%d-%b-%y','%d %B %Y','%Y-%m-%d']), unnest(range(0, 20)))""")
def fn7_header_formats(spark, d):
    rows = [(locale, f, k) for locale, own in (("day", ["%d-%m-%Y"]), ("month", ["%m/%d/%y"])) for k, f in enumerate(dates.header_formats(own))]
    return spark.createDataFrame(rows, "locale string, format string, place long")


_EACH = " UNION ALL ".join(f"SELECT grp, {k} AS k, '{n}' AS f, n, try_strptime(t, '{n}')::DATE AS d FROM samples" for k, (n, _) in enumerate(dates.DAY_FIRST + dates.MONTH_FIRST))


@query(
    "fn8_choose_format",
    f"""WITH samples AS (
  SELECT l_orderkey AS grp, l_linenumber AS n, CASE l_orderkey % 3 WHEN 0 THEN strftime(l_shipdate, '%d/%m/%Y') WHEN 1 THEN strftime(l_shipdate, '%m/%d/%Y') ELSE strftime(l_shipdate, '%d %b %Y') END AS t
  FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS l_linenumber, l_shipdate FROM lineitem)),
read AS ({_EACH}),
seen AS (SELECT *, lag(d) OVER (PARTITION BY grp, k ORDER BY n) AS b FROM read),
judged AS (
  SELECT grp, k, f, bool_and(d IS NOT NULL) AS whole, coalesce(bool_and(b <= d), true) OR coalesce(bool_and(b >= d), true) AS ordered FROM seen GROUP BY grp, k, f)
SELECT grp, arg_min(f, CASE WHEN ordered THEN k ELSE k + 100 END) AS format FROM judged WHERE whole GROUP BY grp""",
)
def fn8_choose_format(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    shown = _pick(F.col("l_orderkey"), [F.date_format("l_shipdate", p) for p in ("dd/MM/yyyy", "MM/dd/yyyy", "dd MMM yyyy")])
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber"))
    return dates.choose_format(rows.select(F.col("l_orderkey").alias("grp"), n.alias("n"), shown.alias("text")))


@query("fn1_normalize_space", "SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: w <> ''), ' ')) AS digest FROM documents")
def fn1_normalize_space(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize_space(F.col("text")).cast("binary")).alias("digest"))


@query("fn12_identify_bank", """SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'sbi' WHEN 1 THEN 'boi' WHEN 2 THEN 'unknown' WHEN 3 THEN 'bob' ELSE 'kotak' END AS code,
CASE n_nationkey % 5 WHEN 0 THEN 'State Bank of India' WHEN 1 THEN 'Bank of India' WHEN 2 THEN NULL WHEN 3 THEN 'Bank of Baroda' ELSE 'Kotak Mahindra Bank' END AS name FROM nation""")
def fn12_identify_bank(spark, d):
    n = F.col("n_nationkey")
    ifsc = _pick(n, [F.lit("SBIN0001234"), F.lit(None), F.lit("ZZZZ0000001"), F.lit(None), F.lit("KKBK0000007")])
    page = _pick(n, [F.lit("Yes Bank"), F.concat(F.lit("issued by BANK OF INDIA for "), "n_name"), F.lit("Bank of Indiana"), F.lit("see Bank of Baroda, formerly Dena"), F.lit("HDFC Bank")])
    found = table(spark, d, "nation").select("n_nationkey", text.identify_bank(ifsc, page).alias("b"))
    return found.select("n_nationkey", F.col("b.code").alias("code"), F.col("b.name").alias("name"))


@query("fn13_marker_phrase", "SELECT doc_id, regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])of[\\s]+the([^\\p{L}\\p{N}_]|$)') AS found FROM documents")
def fn13_marker_phrase(spark, d):
    return table(spark, d, "documents").select("doc_id", text.has_phrase(F.col("text"), "of the").alias("found"))


@query("fn14_shape", "SELECT c_custkey, coalesce(regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g'), 'null') AS shape FROM customer")
def fn14_shape(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.shape(F.col("c_name")).alias("shape"))


@query("fn15_normalise_heading", """WITH h AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name || ' ' || p_brand WHEN p_partkey % 5 = 0 THEN p_name || ' / ' || p_type || ' per unit of sale' ELSE p_type || '. ' || p_name || ' (' || p_type || ')' END AS raw FROM part),
w AS (SELECT p_partkey, list_filter(list_transform(string_split(regexp_replace(lower(raw), '[^a-z0-9/.]+', ' ', 'g'), ' '), lambda x: trim(x, '.')), lambda x: x <> '') AS ws FROM h),
u AS (SELECT p_partkey, list_filter(ws, lambda x, i: list_position(ws, x) = i) AS ws FROM w)
SELECT p_partkey, CASE WHEN len(ws) > 5 OR regexp_matches(array_to_string(ws, ' '), '[0-9]') THEN '' ELSE array_to_string(ws, ' ') END AS heading FROM u""")
def fn15_normalise_heading(spark, d):
    branded = F.concat("p_name", F.lit(" "), "p_brand")
    long = F.concat("p_name", F.lit(" / "), "p_type", F.lit(" per unit of sale"))
    twice = F.concat("p_type", F.lit(". "), "p_name", F.lit(" ("), "p_type", F.lit(")"))
    raw = F.when(F.col("p_partkey") % 4 == 0, branded).when(F.col("p_partkey") % 5 == 0, long).otherwise(twice)
    return table(spark, d, "part").select("p_partkey", text.normalise_heading(raw).alias("heading"))


@query("fn16_safe_label", "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'column_' || (p_partkey % 9)::VARCHAR ELSE substr(trim(regexp_replace(lower(p_type || ' / ' || p_name || '!'), '[^a-z0-9]+', '_', 'g'), '_'), 1, 40) END AS label FROM part")
def fn16_safe_label(spark, d):
    raw = F.when(F.col("p_partkey") % 9 == 0, "--").otherwise(F.concat("p_type", F.lit(" / "), "p_name", F.lit("!")))
    return table(spark, d, "part").select("p_partkey", text.safe_label(raw, F.col("p_partkey") % 9).alias("label"))


@query("fn17_item_kind", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'txn:*:' || event_type WHEN 1 THEN 'field:' || event_type ELSE event_type || ':*:*' END AS kind FROM events")
def fn17_item_kind(spark, d):
    e = F.col("event_id").cast("string")
    raw = _pick(F.col("event_id"), [F.concat(F.lit("txn:"), e, F.lit(":"), "event_type"), F.concat(F.lit("field:"), "event_type"), F.concat("event_type", F.lit(":"), e, F.lit(":7"))])
    return table(spark, d, "events").select("event_id", text.item_kind(raw).alias("kind"))


@query("fn18_layout_of", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'plain/' || (user_id % 12)::VARCHAR ELSE event_type || '/layout-' || (user_id % 12)::VARCHAR END AS layout FROM events")
def fn18_layout_of(spark, d):
    layout = (F.col("user_id") % 12).cast("string")
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("plain/"), layout)).otherwise(F.concat("event_type", F.lit("/layout-"), layout, F.lit("/v"), F.col("event_id").cast("string")))
    return table(spark, d, "events").select("event_id", text.layout_of(raw).alias("layout"))


@query("fn19_fingerprint", "SELECT p_partkey, substr(sha256(p_brand || '|' || least(p_name, p_type) || '|' || greatest(p_name, p_type) || '|txn_date:' || (p_size * 2)::VARCHAR || '-' || (p_size * 2 + 2)::VARCHAR), 1, 8) AS fingerprint FROM part")
def fn19_fingerprint(spark, d):
    x = F.col("p_size").cast("double") * 2
    columns = F.array(F.struct(F.lit("txn_date").alias("role"), (x + 0.5).alias("x0"), (x + 1.5).alias("x1")))
    return table(spark, d, "part").select("p_partkey", text.layout_fingerprint(F.col("p_brand"), F.array("p_name", "p_type"), columns).alias("fingerprint"))


@query("fn22_convert", """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 17 = 0 THEN NULL WHEN l_orderkey % 8 IN (3, 4, 5, 7) THEN -CAST(round(l_extendedprice * 100) AS BIGINT) ELSE CAST(round(l_extendedprice * 100) AS BIGINT) END AS balance,
l_linenumber::BIGINT AS count, CAST(l_shipdate AS DATE) AS period, CASE l_linenumber % 3 WHEN 0 THEN 'INR' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency FROM lineitem""")
def fn22_convert(spark, d):
    from tallyspark.operators.headers import convert

    symbol = _pick(F.col("l_linenumber"), [F.lit("₹"), F.lit(" $"), F.lit("EUR")])
    rows = printed_cells(spark, d).withColumns({"balance": convert("header.closing_balance", F.col("amount_text"), ["%d/%m/%Y"]), "count": convert("summary.debit_count", F.concat(F.lit(" "), F.col("l_linenumber").cast("string")), []), "period": convert("header.period_end", F.col("date_text"), ["%d/%m/%Y"]), "currency": convert("header.currency", symbol, [])})
    return rows.select("l_orderkey", "l_linenumber", money.to_cents(F.col("balance.value").cast(money.EXACT)).alias("balance"), F.col("count.value").cast("long").alias("count"), F.col("period.value").cast("date").alias("period"), F.col("currency.value").alias("currency"))


@query("fn23_resolve_pages", """SELECT c_custkey, list_filter([1, CASE WHEN c_custkey % 6 >= 2 THEN 2 END, CASE WHEN c_custkey % 6 >= 3 THEN (c_custkey % 6) END], lambda p: p IS NOT NULL AND p <= c_custkey % 6)::INT[] AS pages FROM customer""")
def fn23_resolve_pages(spark, d):
    count = (F.col("c_custkey") % 6).cast("int")
    asked = F.array(F.lit(1), F.lit(2), F.lit(-1), F.lit(1), F.lit(9), F.lit(-9))
    return table(spark, d, "customer").select("c_custkey", text.resolve_pages(asked, count).alias("pages"))


@query("fn24_field_name", "SELECT p_partkey, replace(p_name, ' ', ' ') || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '.x' END AS field FROM part")
def fn24_field_name(spark, d):
    key = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("header."), F.replace("p_name", F.lit(" "), F.lit("_")))).otherwise(F.concat(F.lit("a."), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".x")))
    return table(spark, d, "part").select("p_partkey", text.field_name(key).alias("field"))
