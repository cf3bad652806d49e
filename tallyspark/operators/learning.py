"""Learning layouts from approvals: headings, markers, overlaps, acceptance; and checks of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: words of statement labels; a marker is made of these only
LABEL_WORDS = """
a/c account accounts acct address amount as at available balance bank branch brought cheque chq cif city
clear closing code count credit credits currency customer cust date debit debits deposit description details
drawing email forward from home id ifs ifsc interest jointholders joint holders kyc limit micr mobile mod
name narration no nomination nominee number od of on open opening outstanding p.a. period phone power
product rate ref registered relationship segment state statement status summary to total transaction
transactions type value withdrawal withdrawals deposits remarks particulars inr usd sr
""".split()
LABEL_LENGTH, MOST_MARKERS, LEAST_MARKERS = 4, 6, 2
# fixed values: words that do not belong in an account's values, and words that begin a transaction's text
VALUE_LABELS = ("account", "address", "branch", "ifsc", "customer", "statement", "period", "mobile", "email", "phone", "micr", "nominee", "balance")
TXN_WORDS = ("WDL", "DEP", "TFR", "UPI", "NEFT", "IMPS", "RTGS", "ATM", "POS", "ACH", "ECS", "NACH", "CHQ", "MMT", "INB", "CLG", "DR", "CR")
PATTERN_ROWS, PATTERN_SHARE = 5, 0.3


def vocabulary(examples: DataFrame) -> DataFrame:
    """(heading, role) to the headings that always had one role."""
    per = examples.filter("heading <> ''").groupBy("heading").agg(F.count_distinct("role").alias("n"), F.min("role").alias("role"))
    return per.filter("n = 1").select("heading", "role")


def nearest(views: DataFrame, examples: DataFrame, k: int = 3) -> DataFrame:
    """(doc, words) and (example, words): each view's k examples of the largest Jaccard share, oldest first of equals.

    Views and examples meet on shared words (an inverted index), so pairs
    without a common word are never made.
    """
    left = views.select("doc", F.explode(F.array_distinct("words")).alias("w"))
    right = examples.select("example", F.explode(F.array_distinct("words")).alias("w"))
    both = left.join(right, "w").groupBy("doc", "example").agg(F.count(F.lit(1)).alias("shared"))
    sizes = lambda df, key, name: df.select(key, F.size(F.array_distinct("words")).alias(name))
    rows = both.join(sizes(views, "doc", "m"), "doc").join(sizes(examples, "example", "n"), "example")
    rows = rows.withColumn("score", F.col("shared") / (F.col("m") + F.col("n") - F.col("shared")))
    nth = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("score"), "example"))
    return rows.withColumn("nth", nth.cast("long")).filter(F.col("nth") <= k).select("doc", "example", "score", "nth")


def few_shot(examples: DataFrame) -> DataFrame:
    """(doc, line): approved headings and roles as a line of a prompt, never a value."""
    pairs = F.array_sort(F.collect_list(F.when(F.col("heading") != "", F.struct("c", F.concat(F.lit('"'), "heading", F.lit('" -> '), "role").alias("t")))))
    return examples.groupBy("doc").agg(F.array_join(F.transform(pairs, lambda p: p["t"]), "; ").alias("line"))


def roles_by_overlap(found: DataFrame, known: DataFrame) -> DataFrame:
    """(doc, c, x0, x1) with role: that of the known column (doc, role, x0, x1) that overlaps most.

    Both sides have rows for every document, so neither is sent to the driver,
    however small the files are that they come from.
    """
    k = known.select("doc", "role", F.col("x0").alias("k0"), F.col("x1").alias("k1")).hint("merge")
    rows = found.join(k, "doc").withColumn("overlap", F.least("x1", "k1") - F.greatest("x0", "k0"))
    best = F.max(F.struct("overlap", "role")).alias("b")
    return rows.groupBy("doc", "c").agg(best).select("doc", "c", F.when(F.col("b.overlap") > 0, F.col("b.role")).otherwise("ignore").alias("role"))


def vocabulary_roles(columns: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc, c, heading, word_role) with role: the learned one, else that of familiar words, where learning helps."""
    rows = columns.join(vocab.withColumnRenamed("role", "learned"), "heading", "left")
    rows = rows.withColumns({"word": F.coalesce("word_role", F.lit("ignore"))}).withColumn("role", F.coalesce("learned", "word"))
    doc = Window.partitionBy("doc")
    named = F.when(F.col("role") != "ignore", F.col("role"))
    good = (
        F.max(F.col("role") != F.col("word")).over(doc)
        & (F.count(named).over(doc) == F.size(F.collect_set(named).over(doc)))
        & (F.size(F.array_intersect(F.collect_set("role").over(doc), F.array(*[F.lit(r) for r in ("txn_date", "description", "balance")]))) == 3)
    )
    return rows.withColumn("helps", good).filter("helps").select("doc", "c", "role")


def label_before(segment: Column) -> Column:
    """The last words before a colon, up to four, as long as they are label words."""
    known = F.array(*[F.lit(w) for w in LABEL_WORDS])
    words = F.reverse(F.regexp_extract_all(segment, F.lit(r"[^\s]+"), F.lit(0)))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("going"))

    def step(s: Column, w: Column) -> Column:
        good = s["going"] & (F.size(s["kept"]) < LABEL_LENGTH) & w.rlike(r"\A[A-Za-z][A-Za-z./()%]*\z") & F.array_contains(known, F.lower(F.regexp_replace(w, r"^[()]+|[()]+$", "")))
        return F.struct(F.when(good, F.array_prepend(s["kept"], w)).otherwise(s["kept"]).alias("kept"), good.alias("going"))

    return F.aggregate(words, start, step, lambda s: F.array_join(s["kept"], " "))


def candidate_labels(text: Column) -> Column:
    """The distinct labels before the colons of a text, in order."""
    lines = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    parts = F.flatten(F.transform(lines, lambda line: F.slice(F.split(line, r"\s*:\s*"), F.lit(1), F.size(F.split(line, r"\s*:\s*")) - 1)))
    return F.array_distinct(F.filter(F.transform(parts, label_before), lambda x: x != ""))


def heading_runs(text: Column, tokens) -> Column:
    """Runs of two or more label words on lines that hold heading words only (a list, or an array column)."""
    known = F.array(*[F.lit(w) for w in LABEL_WORDS])
    heads = tokens if isinstance(tokens, Column) else F.array(*[F.lit(t) for t in tokens])
    words_of = lambda line: F.regexp_extract_all(line, F.lit(r"[^\s]+"), F.lit(0))
    lines = F.filter(F.transform(F.split(text, "\n"), words_of), lambda ws: (F.size(ws) > 0) & F.forall(ws, lambda w: F.array_contains(heads, w)))

    def marked(ws: Column) -> Column:
        flagged = F.transform(ws, lambda w: F.when(F.array_contains(known, F.lower(F.regexp_replace(w, r"^[().:]+|[().:]+$", ""))), w).otherwise(F.lit("\n")))
        return F.filter(F.transform(F.split(F.array_join(flagged, " "), "\n"), F.trim), lambda r: F.size(F.split(r, " ")) >= 2)

    return F.flatten(F.transform(lines, marked))


def choose_markers(labels: Column, forbidden: Column, headings: Column) -> Column:
    """Up to six labels, those of several words first; headings only where labels are too few."""
    known = F.array(*[F.lit(w) for w in LABEL_WORDS])
    words = lambda x: F.split(x, " ")
    names_value = lambda x: F.exists(words(x), lambda w: (F.length(w) > 3) & ~F.array_contains(known, F.lower(w)) & F.exists(forbidden, lambda v: F.contains(F.lower(v), F.lower(w))))
    kept = F.filter(labels, lambda x: ~names_value(x))
    ordered = F.concat(F.filter(kept, lambda x: F.size(words(x)) >= 2), F.filter(kept, lambda x: F.size(words(x)) == 1))
    first = F.slice(ordered, 1, MOST_MARKERS)
    plain = lambda x: F.forall(words(x), lambda w: F.array_contains(known, F.lower(F.regexp_replace(w, r"^[().:]+|[().:]+$", ""))))
    more = F.array_except(F.array_distinct(F.filter(headings, lambda x: plain(x) & (F.size(words(x)) >= 2))), first)
    return F.when(F.size(first) < LEAST_MARKERS, F.slice(F.concat(first, more), 1, MOST_MARKERS)).otherwise(first)


def acceptance() -> Column:
    """The first rule that a candidate layout breaks on its own document, null if none.

    Columns: n_problems, n_rows, status, required (checks: status, rows_checked,
    only_no_opening, name), n_markers.
    """
    first_row_only = lambda c: (c["name"] == "balance_chain") & (c["status"] == "WARN") & (c["rows_checked"] >= 2) & c["only_no_opening"]
    return (
        F.when(F.col("n_problems") > 0, "extraction_problems")
        .when(F.col("n_rows") == 0, "no_rows")
        .when(F.col("status") == "FAIL", "rows_unverified")
        .when(F.exists("required", lambda c: (c["status"] != "PASS") & ~first_row_only(c)), "rows_unverified")
        .when(F.size("required") == 0, "rows_unverified")
        .when(F.col("n_markers") < LEAST_MARKERS, "markers_weak")
    )


def ambiguous_markers(texts: DataFrame, markers: list[str], layout: str) -> DataFrame:
    """(doc, layout, text) of other layouts in which all the markers stand."""
    from tallyspark.functions.text import all_markers

    return texts.filter((F.col("layout") != layout) & all_markers(F.col("text"), markers)).select("doc", "layout")


def same_markers(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """Candidates with the layout and next version to save under: the same set of markers is the same layout."""
    key = lambda c: F.array_sort(F.array_distinct(c))
    known = registry.groupBy("bank", "layout").agg(F.max("version").alias("top"), F.max_by("markers", "version").alias("markers")).withColumn("key", key(F.col("markers")))
    known = known.groupBy("bank", "key").agg(F.min(F.struct("layout", "top")).alias("k"))
    rows = candidates.withColumn("key", key(F.col("markers"))).join(known, ["bank", "key"], "left")
    return rows.select("candidate", "bank", F.col("k.layout").alias("layout"), (F.coalesce("k.top", F.lit(0)) + 1).alias("version"))


def text_issues(rows: DataFrame) -> DataFrame:
    """(doc, i, description) to (doc, row_index, code): no description, or one that ends as others begin.

    A document's common beginnings are grouped counts, joined back to its rows;
    a row's own last one or two words are looked up among them.
    """
    clean = F.trim(F.coalesce("description", F.lit("")))
    words = F.filter(F.split(F.upper(clean), r"\s+"), lambda w: w != "")
    t = rows.select("doc", "i", words.alias("ws"))
    n = t.filter(F.size("ws") > 0).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    heads = t.select("doc", F.explode(F.array(*[F.when(F.size("ws") > k, F.array_join(F.slice("ws", 1, k), " ")) for k in (1, 2)])).alias("head")).filter("head is not null")
    common = heads.groupBy("doc", "head").agg(F.count(F.lit(1)).alias("c")).join(n, "doc")
    common = common.filter((F.col("n") >= PATTERN_ROWS) & (F.col("c") >= PATTERN_SHARE * F.col("n")) & F.col("head").rlike("[A-Za-z]")).select("doc", "head")
    tails = t.select("doc", "i", F.explode(F.array(*[F.when(F.size("ws") > k, F.array_join(F.slice("ws", F.size("ws") - k + 1, k), " ")) for k in (1, 2)])).alias("head")).filter("head is not null")
    moved = tails.join(common, ["doc", "head"]).select("doc", "i")
    last = F.slice("ws", F.greatest(F.size("ws") - 1, F.lit(1)), 2)
    known = F.array(*[F.lit(w) for w in TXN_WORDS])
    typed = t.filter((F.size("ws") > 2) & F.forall(last, lambda w: F.array_contains(known, w))).select("doc", "i")
    end = moved.unionByName(typed).distinct().select("doc", F.col("i").alias("row_index"), F.lit("description_start_at_end").alias("code"))
    return t.filter(F.size("ws") == 0).select("doc", F.col("i").alias("row_index"), F.lit("empty_description").alias("code")).unionByName(end)


def common_starts(rows: DataFrame) -> DataFrame:
    """(doc, head, c): first words that at least three tenths of a document's descriptions share."""
    words = F.split(F.upper(F.trim("description")), r"\s+")
    t = rows.filter("description is not null and trim(description) <> ''").select("doc", words.alias("ws"))
    n = t.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    heads = t.filter(F.size("ws") > 1).groupBy("doc", F.col("ws")[0].alias("head")).agg(F.count(F.lit(1)).alias("c"))
    return heads.join(n, "doc").filter(F.col("c") >= PATTERN_SHARE * F.col("n")).select("doc", "head", "c")


def label_words_in(value: Column) -> Column:
    """Label words that stand in a value, sorted."""
    words = F.transform(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)), F.lower)
    return F.array_sort(F.array_intersect(F.array_distinct(words), F.array(*[F.lit(w) for w in VALUE_LABELS])))


def with_text_status(status: Column, text_status: Column) -> Column:
    """A passed report becomes a warning where the text check warns."""
    return F.when((status == "PASS") & (text_status == "WARN"), "WARN").otherwise(status)


def recorded_examples(approvals: DataFrame, extractions: DataFrame) -> DataFrame:
    """Training examples from approvals: (example_key, kind, document_id, template_id, extraction_id, occurred_at).

    Each approval (document_id, approved_at, source) takes the document's latest
    extraction (id, document_id, template_id, created_at) that is not younger, by
    one window over both in the order of time; approvals without one record
    nothing. The key is a hash of what the example says, so recording again adds
    nothing, and equal approvals are one example.
    """
    none = lambda kind: F.lit(None).cast(kind)
    made = extractions.select("document_id", F.col("created_at").alias("at"), F.lit(0).alias("side"), F.col("id").cast("long").alias("id"), "template_id", none("string").alias("source"))
    asked = approvals.select("document_id", F.col("approved_at").alias("at"), F.lit(1).alias("side"), none("long").alias("id"), none("string").alias("template_id"), "source")
    before = Window.partitionBy("document_id").orderBy("at", "side", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.last(F.when(F.col("side") == 0, F.struct("id", "template_id")), ignorenulls=True).over(before)
    rows = made.unionByName(asked).withColumn("latest", latest).filter("side = 1 and latest is not null")
    said = F.to_json(F.struct(F.lit("approval").alias("kind"), "document_id", F.col("latest.template_id").alias("template_id"), F.col("latest.id").alias("extraction_id"), "source"))
    rows = rows.select(F.sha2(said.cast("binary"), 256).alias("example_key"), F.lit("approval").alias("kind"), "document_id", F.col("latest.template_id").alias("template_id"), F.col("latest.id").alias("extraction_id"), F.col("at").alias("occurred_at"))
    return rows.groupBy("example_key", "kind", "document_id", "template_id", "extraction_id").agg(F.min("occurred_at").alias("occurred_at"))


def new_examples(found: DataFrame, known: DataFrame) -> DataFrame:
    """Examples whose key is not known yet."""
    return found.join(known.select("example_key"), "example_key", "left_anti")
