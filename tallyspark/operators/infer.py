"""Inferring a table's layout: column profiles, roles, gaps, samples and the choice among candidates.

Profiles, roles and choices are grouped expressions over many documents at once.
Column boundaries within a page are folds and sweeps over that page's own words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import dates, money
from tallyspark.functions.text import bound, phrase_pattern

# fixed values: the words of a heading that name a column's role, in this order
ROLE_WORDS = (
    ("value_date", r"\bvalue\b"),
    ("txn_date", r"\b(date|dt)\b"),
    ("balance", r"\bbalance\b"),
    ("dr_cr", r"\b(dr\s*/\s*cr|cr\s*/\s*dr)\b"),
    ("debit", r"\b(withdrawal|withdrawals|debit|debits|dr|subtractions)\b"),
    ("credit", r"\b(deposit|deposits|credit|credits|cr|additions)\b"),
    ("amount", r"\bamount\b"),
    ("reference", r"\b(ref|chq|cheque|instrument|utr)\b"),
    ("description", r"\b(narration|description|particulars|details|remarks|transaction)\b"),
)
PLACEHOLDERS = ("-", "--", "0.00", "NA", "N/A")
PRINTED_MONEY = r"^\(?-?[\d,]*\d\.\d{2}\)?-?(?:\s*(?:CR|DR|Cr|Dr))?$"
SURE = 0.9
SAMPLES, SAMPLE_CHARS = 3, 24


def role_of(label: Column) -> Column:
    out = None
    for role, words in ROLE_WORDS:
        when = label.rlike(f"(?i){words}")
        out = F.when(when, role) if out is None else out.when(when, role)
    return out


def label_roles(labels: DataFrame) -> DataFrame:
    """(doc, c, label) with role: the first that fits; a second date is the value date, a role is used once."""
    rows = labels.withColumn("r", role_of(F.col("label")))
    by = Window.partitionBy("doc", "r").orderBy("c")
    rows = rows.withColumn("r", F.when((F.col("r") == "txn_date") & (F.row_number().over(by) > 1), "value_date").otherwise(F.col("r")))
    return rows.withColumn("role", F.when(F.row_number().over(by) == 1, F.col("r"))).drop("r")


def column_stats(cells: DataFrame) -> DataFrame:
    """(doc, row, c, text) to a profile of each column: fill, date and amount shares, mean length, count."""
    filled = F.coalesce((F.col("text") != "") & (F.col("text") != "-"), F.lit(False))
    rows = cells.withColumn("f", filled).withColumns({"is_date": F.col("f") & dates.is_date(F.col("text")), "is_money": F.col("f") & money.is_amount(F.col("text"))})
    n = F.greatest(F.count_if("f"), F.lit(1))
    return rows.groupBy("doc", "c").agg(
        (F.count_if("f") / F.count(F.lit(1))).alias("fill"), (F.count_if("is_date") / n).alias("date"), (F.count_if("is_money") / n).alias("amount"),
        (F.sum(F.when(F.col("f"), F.length("text")).otherwise(0)) / n).alias("avg_len"), F.count_if("f").alias("count"),
    )


def roles_usable(stats: DataFrame) -> DataFrame:
    """(doc, usable) for profiles with a role: all needed roles, and none at odds with its content."""
    empty = F.col("count") == 0
    wrong = (F.col("role").isin("debit", "credit", "balance") & ~empty & (F.col("amount") < SURE)) | ((F.col("role") == "txn_date") & (F.col("date") < SURE))
    per = stats.groupBy("doc").agg(F.collect_set("role").alias("roles"), F.bool_or(F.coalesce(wrong, F.lit(False))).alias("wrong"))
    need = F.array(*[F.lit(r) for r in ("txn_date", "debit", "credit")])
    return per.select("doc", ((F.size(F.array_except(need, F.col("roles"))) == 0) & ~F.col("wrong")).alias("usable"))


def content_roles(stats: DataFrame) -> DataFrame:
    """``stats`` with role from content alone. Columns of each kind are numbered from the left."""
    doc = Window.partitionBy("doc")
    used = F.col("count") > 0
    s = stats.withColumn("k_date", used & (F.col("date") >= SURE))
    nth = lambda flag: F.sum(F.col(flag).cast("int")).over(doc.orderBy("c"))
    s = s.withColumn("role", F.when(F.col("k_date"), F.when(nth("k_date") == 1, "txn_date").when(nth("k_date") == 2, "value_date")))
    s = s.withColumn("k_money", F.col("role").isNull() & used & (F.col("amount") >= SURE))
    dense = F.max(F.when(F.col("k_money") & (F.col("fill") >= SURE), F.col("c"))).over(doc)
    s = s.withColumn("bal", F.coalesce(dense, F.max(F.when(F.col("k_money"), F.col("c"))).over(doc)))
    s = s.withColumn("k_rest", F.col("k_money") & (F.col("c") != F.col("bal")))
    s = s.withColumn("n_rest", F.sum(F.col("k_rest").cast("int")).over(doc)).withColumn("nth_rest", nth("k_rest"))
    pair = F.when((F.col("n_rest") >= 2) & F.col("k_rest"), F.when(F.col("nth_rest") == 1, "debit").when(F.col("nth_rest") == 2, "credit"))
    s = s.withColumn("role", F.coalesce(F.col("role"), F.when(F.col("k_money") & (F.col("c") == F.col("bal")), "balance"), pair))
    s = s.withColumn("k_text", F.col("role").isNull() & used)
    longest = F.max(F.when(F.col("k_text"), F.struct(F.col("avg_len"), (-F.col("c")).alias("c")))).over(doc)
    s = s.withColumn("desc", -longest["c"]).withColumn("k_other", F.col("k_text") & (F.col("c") != F.col("desc")))
    s = s.withColumn("role", F.coalesce(F.col("role"), F.when(F.col("k_text") & (F.col("c") == F.col("desc")), "description"), F.when(F.col("k_other") & (nth("k_other") == 1), "reference")))
    none = F.max((F.coalesce(F.col("role"), F.lit("")) == "txn_date").cast("int")).over(doc) == 0
    first = F.col("c") == F.min("c").over(doc)
    return s.withColumn("role", F.when(none & first & F.col("role").isNull(), "txn_date").otherwise(F.col("role"))).select(*stats.columns, "role")


def debit_credit_orders(roles: DataFrame) -> DataFrame:
    """Both ways of telling debit from credit, as variants 0 and 1; one where there is no pair."""
    both = F.size(F.array_intersect(F.collect_set("role").over(Window.partitionBy("doc")), F.array(F.lit("debit"), F.lit("credit")))) == 2
    rows = roles.withColumn("__both", both)
    other = F.when(F.col("role") == "debit", "credit").when(F.col("role") == "credit", "debit").otherwise(F.col("role"))
    swapped = rows.filter("__both").withColumn("role", other).withColumn("variant", F.lit(1))
    return rows.withColumn("variant", F.lit(0)).unionByName(swapped).drop("__both")


def best_candidate(candidates: DataFrame) -> DataFrame:
    """(doc, variant, n_fail, n_problems) to the lowest sum for each document, the first of equals."""
    score = F.col("n_fail") + F.col("n_problems")
    return candidates.groupBy("doc").agg(F.min(F.struct(score.alias("score"), F.col("variant"))).alias("b")).select("doc", "b.variant", "b.score")


def first_not_failed(candidates: DataFrame) -> DataFrame:
    """(doc, rank, template, status): the best-ranked candidate whose report is not FAIL."""
    return candidates.filter("status <> 'FAIL'").groupBy("doc").agg(F.min_by(F.struct("template", "status"), "rank").alias("b")).select("doc", "b.*")


def detect(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc, template, rank): templates all of whose markers stand in a text, most markers first.

    A marker is looked for only in texts that have its longest word: markers
    and the words of texts meet by a join, and what they share is then matched
    as a whole phrase. So a registry can be of any size, and a text is read
    once for each marker it may have. A marker without any word is looked for
    in every text.
    """
    marker = templates.select("template", F.size("markers").alias("n"), F.explode(F.array_distinct("markers")).alias("marker"))
    runs = F.regexp_extract_all(F.lower("marker"), F.lit(r"((?U)\w+)"), F.lit(1))
    key = F.array_max(F.transform(runs, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    marker = marker.select("template", "n", "marker", phrase_pattern(F.col("marker")).alias("pattern"), F.coalesce(key, F.lit("")).alias("key"))
    distinct = marker.select("marker", "pattern", "key").distinct()
    words = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(F.lower("text"), F.lit(r"((?U)\w+)"), F.lit(1))))
    near = pages.filter("text is not null").select("doc", F.explode(words).alias("key")).join(distinct, "key").select("doc", "marker", "pattern")
    found = near.join(pages.select("doc", "text"), "doc").filter("text rlike pattern").select("doc", "marker")
    hits = found.join(marker.select("template", "n", "marker"), "marker").groupBy("doc", "template").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
    wanted = marker.groupBy("template").agg(F.count(F.lit(1)).alias("wanted"))
    known = templates.select("template", "bank", "layout", "version").join(wanted, "template")
    hits = hits.join(known, "template").filter("m = wanted")
    order = Window.partitionBy("doc").orderBy(F.col("n").desc(), "bank", "layout", F.col("version").desc(), "template")
    return hits.select("doc", "template", (F.row_number().over(order) - 1).alias("rank"))


def merged_spans(words: DataFrame, reach: Column) -> DataFrame:
    """(doc, page, span, x0, x1, text): words joined while the next begins within ``reach`` of the span's end.

    Sorted by x0 the end of the current span is the running maximum, so spans
    are islands between gaps.
    """
    by = Window.partitionBy("doc", "page").orderBy("x0", "seq")
    rows = words.withColumn("end", F.max("x1").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("new", (F.col("end").isNull() | (F.col("x0") - F.col("end") > reach)).cast("int"))
    rows = rows.withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    texts = F.array_sort(F.collect_list(F.struct("x0", "seq", "text")))
    return rows.groupBy("doc", "page", "span").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.array_join(F.transform(texts, lambda t: t["text"]), " ").alias("text"))


def word_heights(words: DataFrame) -> DataFrame:
    return words.groupBy("doc", "page").agg(F.median(F.col("bottom") - F.col("top")).alias("height"))


def best_gap(ws: Column, left: Column, right: Column) -> Column:
    """The middle of the run between two edges that the fewest words cross, the widest of equals."""
    inside = lambda v: (v > left) & (v < right)
    near = F.filter(ws, lambda w: inside(w["x0"]) | inside(w["x1"]) | ((w["x0"] < right) & (w["x1"] > left)))

    def judged(a: Column, b: Column, ws: Column) -> Column:
        mid = (a + b) / 2
        return F.struct(F.size(F.filter(ws, lambda w: (w["x0"] < mid) & (w["x1"] > mid))).alias("n"), (a - b).alias("narrow"), mid.alias("mid"))

    def best(ws: Column) -> Column:
        inner = F.filter(F.flatten(F.transform(ws, lambda w: F.array(w["x0"], w["x1"]))), inside)
        edges = F.array_sort(F.array_distinct(F.concat(F.array(left, right), inner)))
        # words and edges are asked for every run, so each is made once
        return bound(edges, lambda e: F.array_min(F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda k: judged(F.element_at(e, k), F.element_at(e, k + 1), ws)))["mid"])

    return F.when(right > left, bound(near, best))


def _any_date(texts: Column, most: Column) -> Column:
    """One to three words in a row that are a date, beginning within the first ``most`` words."""
    starts = F.sequence(F.lit(1), F.least(most, F.size(texts)))
    grams = F.flatten(F.transform(starts, lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.array_join(F.slice(texts, i, k), " "))))
    return (F.size(texts) > 0) & F.exists(F.filter(grams, lambda g: g.rlike(r"\d")), lambda g: F.coalesce(dates.is_date(g), F.lit(False)))


def _money(texts: Column) -> Column:
    return F.exists(texts, lambda t: t.rlike(PRINTED_MONEY))


def is_transaction(ws: Column) -> Column:
    """A date within the first three words and a printed amount anywhere."""
    texts = F.transform(ws, lambda w: w["text"])
    return _money(texts) & _any_date(texts, F.lit(3))


def has_value(ws: Column) -> Column:
    """A printed amount, or one to three words in a row that are a date."""
    texts = F.transform(ws, lambda w: w["text"])
    return _money(texts) | _any_date(texts, F.size(texts))


def table_starts(lines: DataFrame) -> DataFrame:
    """(doc, page, first): the first transaction line that has another within the fourteen after it."""
    rows = lines if "hit" in lines.columns else lines.withColumn("hit", is_transaction(F.col("ws")))
    ahead = Window.partitionBy("doc", "page").orderBy("line_no").rowsBetween(0, 14)
    rows = rows.withColumn("near", F.count_if("hit").over(ahead))
    return rows.filter("hit and near >= 2").groupBy("doc", "page").agg(F.min("line_no").alias("first"))


def heading_lines(lines: DataFrame, starts: DataFrame, most: int = 3) -> DataFrame:
    """(doc, page, line_no): up to ``most`` lines over the table's first, packed and free of values.

    Lines just over the first one that touch it are part of its row and are
    passed over. The walk is over at most a few lines, read from the page's own
    array from the bottom up.
    """
    page = lines.join(starts, ["doc", "page"]).filter(F.col("line_no") <= F.col("first"))
    row = F.struct((-F.col("line_no")).alias("back"), "line_no", "top", "bottom", (F.col("value") if "value" in lines.columns else has_value(F.col("ws"))).alias("value"))
    page = page.groupBy("doc", "page").agg(F.array_sort(F.collect_list(row)).alias("up"))
    start = F.struct(F.lit(None).cast("double").alias("below"), F.lit(0).alias("state"), F.array().cast("array<int>").alias("kept"))

    def step(s: Column, r: Column) -> Column:
        top, bottom = r["top"].cast("double"), r["bottom"].cast("double")
        first = s["below"].isNull()
        skip = (s["state"] == 0) & ~first & (bottom > s["below"] - 0.5) & ~r["value"]
        stop = ~first & ~skip & (r["value"] | (s["below"] - bottom > 2.0 * F.greatest(bottom - top, F.lit(1.0))) | (F.size(s["kept"]) >= most) | (s["state"] == 2))
        return F.struct(
            F.when(stop, s["below"]).otherwise(top).alias("below"),
            F.when(first | skip, F.lit(0)).when(stop, F.lit(2)).otherwise(F.lit(1)).alias("state"),
            F.when(first | skip | stop, s["kept"]).otherwise(F.array_append(s["kept"], r["line_no"])).alias("kept"),
        )

    return page.select("doc", "page", F.explode(F.aggregate("up", start, step, lambda s: s["kept"])).alias("line_no"))


def samples(cells: DataFrame) -> DataFrame:
    """(doc, c, nth, text): the first values of each column, placeholders passed over, cut short."""
    rows = cells.filter(F.coalesce(F.col("text") != "", F.lit(False)) & ~F.col("text").isin(*PLACEHOLDERS))
    nth = F.row_number().over(Window.partitionBy("doc", "c").orderBy("row", "text"))
    return rows.withColumn("nth", nth.cast("long")).filter(F.col("nth") <= SAMPLES).select("doc", "c", "nth", F.substring("text", 1, SAMPLE_CHARS).alias("text"))


def amount_mode(roles: Column) -> Column:
    return F.when(F.array_contains(roles, "amount"), F.when(F.array_contains(roles, "dr_cr"), "dr_cr").otherwise("signed")).otherwise("columns")


def word_roles_usable(roles: Column) -> Column:
    """Familiar words describe a table: a date, a balance, a description, and one way to print amounts."""
    has = lambda r: F.array_contains(roles, r)
    columns = has("debit") & has("credit") & ~has("amount")
    signed = has("amount") & ~has("debit") & ~has("credit")
    return has("txn_date") & has("balance") & has("description") & (columns | signed)


def role_problem(roles: Column, mode: Column) -> Column:
    """The first rule that a set of roles breaks, null if none."""
    has = lambda r: F.array_contains(roles, r)
    named = F.filter(roles, lambda r: r != "ignore")
    known = F.array(*[F.lit(r) for r in ("txn_date", "value_date", "description", "reference", "debit", "credit", "amount", "dr_cr", "balance", "ignore")])
    return (
        F.when(F.size(F.array_except(roles, known)) > 0, "unknown_role")
        .when(F.size(named) != F.size(F.array_distinct(named)), "role_twice")
        .when(~has("txn_date"), "no_date")
        .when(~has("description"), "no_description")
        .when((mode == "columns") & ~(has("debit") & has("credit")), "no_debit_credit")
        .when(mode.isin("signed", "dr_cr") & ~has("amount"), "no_amount")
        .when((mode == "dr_cr") & ~has("dr_cr"), "no_marker")
        .when(has("amount") & (has("debit") | has("credit")), "amount_beside_pair")
        .when(~mode.isin("columns", "signed", "dr_cr"), "unknown_mode")
    )


def content_problem(labelled: DataFrame) -> DataFrame:
    """(doc, c, role, samples) that do not read as their role."""
    values = F.col("samples")
    empty = F.size(values) == 0
    bad_date = F.exists(values, lambda v: ~F.coalesce(dates.is_date(v), F.lit(False)))
    bad_money = F.exists(values, lambda v: ~F.trim(F.replace(v, F.lit("₹"), F.lit(""))).rlike(PRINTED_MONEY))
    problem = (
        F.when((F.col("role") == "balance") & empty, "balance_empty")
        .when(F.col("role").isin("txn_date", "value_date") & bad_date, "not_dates")
        .when(F.col("role").isin("debit", "credit", "amount", "balance") & bad_money, "not_amounts")
    )
    return labelled.withColumn("problem", problem).filter("problem is not null").select("doc", "c", "role", "problem")


def description_is_longest(cells: DataFrame) -> DataFrame:
    """(doc, good): the description has the longest mean text of the text columns (doc, row, role, text)."""
    per = cells.groupBy("doc", "role").agg(F.avg(F.length(F.coalesce("text", F.lit("")))).alias("mean"), F.min("c").alias("c"))
    top = per.groupBy("doc").agg(F.max_by("role", F.struct(F.col("mean"), (-F.col("c")).alias("c"))).alias("longest"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("role") == "description").alias("has"))
    return top.select("doc", (~F.col("has") | (F.col("n") < 2) | (F.col("longest") == "description")).alias("good"))
