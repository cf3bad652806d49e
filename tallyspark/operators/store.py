"""The extraction store and what is derived from it: append-only tables, last-state views.

Tables are append-only; "current" is always a view. Every pick names its full
order, so that a rerun picks the same row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import layout_of

CORRECTED, MATCHED, UNREVIEWED = "corrected", "matched", "unreviewed"


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; partial aggregation, so only one row per key and task is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, "__row.*").select(*df.columns)


def insert_new(stored: DataFrame, arriving: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``arriving`` whose key is not stored; of several the first in the order of all columns."""
    first = arriving.groupBy(*key).agg(F.min(F.struct(*[c for c in arriving.columns if c not in key])).alias("__row")).select(*key, "__row.*").select(*arriving.columns)
    return first.join(stored.select(*key), key, "left_anti")


def merged_reviews(reviews: DataFrame) -> DataFrame:
    """Last review of each (document, extraction); feedback stays until a later one replaces it."""
    by = Window.partitionBy("document_id", "extraction_id").orderBy("updated_at", "review_id")
    rows = reviews.withColumns({
        "nth": F.row_number().over(Window.partitionBy("document_id", "extraction_id").orderBy(F.desc("updated_at"), F.desc("review_id"))),
        "feedback": F.last("feedback", ignorenulls=True).over(by),
        "flags": F.array_sort(F.array_distinct("flags")), "missing": F.array_sort(F.array_distinct("missing")),
    })
    return rows.filter("nth = 1").drop("nth")


def next_versions(existing: DataFrame, arriving: DataFrame, key: str) -> DataFrame:
    """``arriving`` with version: after the largest stored one, in order of id."""
    top = existing.groupBy(key).agg(F.max("version").alias("__top"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("id"))
    return arriving.join(top, key, "left").withColumn("version", (F.coalesce("__top", F.lit(0)) + nth).cast("long")).drop("__top")


def content_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)


def add_examples(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """Stored and arriving examples by content; a repeated one only fills a time that was not known."""
    each = stored.withColumn("__new", F.lit(0)).unionByName(arriving.withColumn("__new", F.lit(1)))
    each = each.withColumn("key", content_key(*[F.col(c) for c in ("kind", "document_id", "template_id", "source", "payload")]))
    first = F.min_by(F.struct("kind", "document_id", "template_id", "source", "payload"), F.struct("__new", "created_at")).alias("row")
    return each.groupBy("key").agg(first, F.min_by("occurred_at", F.when(F.col("occurred_at").isNotNull(), F.struct("__new", "created_at"))).alias("occurred_at"), F.min("created_at").alias("created_at")).select("key", "row.*", "occurred_at", "created_at")


def statements(extractions: DataFrame, reviews: DataFrame, goldens: DataFrame) -> DataFrame:
    """(layout, document_id, first_id, outcome) of every document read by a template.

    Corrected if any review of any extraction marks something; else matched if
    the latest extraction's review is clean or the owner approved the document.
    """
    rows = extractions.filter("template_id is not null").withColumn("layout", layout_of(F.col("template_id")))
    marks = reviews.select(F.col("extraction_id").alias("id"), (F.size("flags") + F.size("missing") > 0).alias("marked"))
    owner = goldens.filter("status = 'active' and coalesce(approved_by, 'owner') = 'owner'").select("document_id").distinct().withColumn("golden", F.lit(True))
    per = rows.join(marks, "id", "left").groupBy("layout", "document_id").agg(
        F.min("id").alias("first_id"), F.bool_or(F.coalesce("marked", F.lit(False))).alias("any_marked"), F.max_by("marked", "id").alias("last_marked")
    )
    per = per.join(owner, "document_id", "left")
    outcome = F.when(F.col("any_marked"), CORRECTED).when((F.col("last_marked") == F.lit(False)) | F.col("golden"), MATCHED).otherwise(UNREVIEWED)
    return per.select("layout", "document_id", "first_id", outcome.alias("outcome"))


def track_record(found: DataFrame, threshold: int) -> DataFrame:
    """Per layout: counts, and how many matched since the last corrected one (the run)."""
    last = F.max(F.when(F.col("outcome") == CORRECTED, F.struct("first_id", "document_id"))).over(Window.partitionBy("layout"))
    rows = found.withColumn("__since", last)
    after = F.col("__since").isNull() | (F.struct("first_id", "document_id") > F.col("__since"))
    out = rows.groupBy("layout").agg(
        F.count(F.lit(1)).alias("statements"), *[F.count_if(F.col("outcome") == o).alias(o) for o in (MATCHED, CORRECTED, UNREVIEWED)],
        F.count_if((F.col("outcome") == MATCHED) & after).alias("run"),
    )
    return out.withColumn("earned", F.col("run") >= threshold)


def routed(extractions: DataFrame, records: DataFrame, threshold: int) -> DataFrame:
    """``extractions`` (with confidence, verified) with reason and required: who checks each statement."""
    rows = extractions.withColumn("layout", layout_of(F.col("template_id"))).join(records.select("layout", "run", "earned"), "layout", "left")
    earned = F.coalesce("earned", F.lit(threshold <= 0))
    reason = (
        F.when(~F.col("verified"), "not_verified")
        .when(~F.col("confidence").eqNullSafe("high"), F.concat(F.lit("confidence_"), F.coalesce("confidence", F.lit("unknown"))))
        .when(F.col("template_id").isNull(), "no_layout")
        .when(~earned, "layout_not_earned")
        .otherwise("earned_and_high")
    )
    return rows.withColumn("reason", reason).withColumn("required", F.col("reason") != "earned_and_high")


def monday_week(at: Column) -> Column:
    """Year and week of Monday weeks, with week 00 before the first Monday."""
    week = F.floor((F.dayofyear(at) + 6 - F.weekday(at)) / 7)
    return F.concat(F.year(at).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def interventions(reviews: DataFrame, weeks: int = 8) -> DataFrame:
    """The last weeks that had corrections: how many, and how many reviews."""
    marked = F.size("flags") + F.size("missing") > 0
    per = reviews.groupBy(monday_week(F.col("updated_at")).alias("week")).agg(F.count_if(marked).alias("corrected"), F.count(F.lit(1)).alias("reviews"))
    return per.filter("corrected > 0").orderBy(F.desc("week")).limit(weeks)


def dashboard(extractions: DataFrame, goldens: DataFrame, records: DataFrame, versions: DataFrame) -> DataFrame:
    """One row per layout that any of the four knows: versions, approvals, verified, record."""
    active = latest(goldens.filter("status = 'active'"), ["document_id"], ["version", "id"])
    approvals = active.groupBy(F.coalesce(layout_of(F.col("template_id")), F.lit("(no layout)")).alias("layout")).agg(
        F.count_if(F.coalesce("approved_by", F.lit("owner")) == "owner").alias("golden_by_owner"), F.count_if(F.col("approved_by") == "agent").alias("golden_by_agent")
    )
    now = latest(extractions.select("document_id", "id", "template_id", "verified"), ["document_id"], ["id"])
    passing = now.groupBy(F.coalesce(layout_of(F.col("template_id")), F.lit("(not learned)")).alias("layout")).agg(F.count_if("verified").alias("verified"), F.count(F.lit(1)).alias("statements_now"))
    known = versions.groupBy("layout").agg(F.countDistinct("version").alias("versions"))
    out = records
    for other in (known, approvals, passing):
        out = out.join(other, "layout", "full_outer")
    counts = ["versions", "golden_by_owner", "golden_by_agent", "verified", "statements_now", "statements", MATCHED, CORRECTED, UNREVIEWED, "run"]
    return out.select("layout", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("earned", F.lit(False)).alias("earned"))


def waiting(extractions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Latest extractions that the owner must look at and has not."""
    now = latest(extractions.select("document_id", "id", "template_id", "routing_required", "routing_reason"), ["document_id"], ["id"])
    left = now.filter("coalesce(routing_required, true)").join(reviews.select(F.col("extraction_id").alias("id")), "id", "left_anti")
    return left.select("document_id", F.coalesce(layout_of(F.col("template_id")), F.lit("(not learned)")).alias("layout"), F.coalesce("routing_reason", F.lit("before_routing")).alias("reason"))


def example_history(examples: DataFrame) -> DataFrame:
    """Feedback that still holds: corrections after their layout's last approval, and every verdict."""
    at = F.struct(F.coalesce("occurred_at", "created_at").alias("t"), F.col("id"))
    rows = examples.withColumns({"layout": layout_of(F.col("template_id")), "at": at})
    approved = rows.filter("kind = 'approval'").groupBy("layout").agg(F.max("at").alias("approved_at"))
    rows = rows.filter("kind in ('field_correction', 'verdict')").join(approved, "layout", "left")
    return rows.filter((F.col("kind") == "verdict") | F.col("approved_at").isNull() | (F.col("at") > F.col("approved_at"))).select("id", "layout", "kind", "item", "verdict")


def drift(documents: DataFrame, templates: DataFrame) -> DataFrame:
    """(document_id, bank_code, layout, reason) of documents that no template could read.

    ``documents``: document_id, bank_code, markers found; ``templates``: bank_code,
    layout, version, markers. A layout whose markers all match has changed inside;
    else a bank with templates prints a new layout. Markers found and markers
    wanted meet by a join and are counted, so a registry can be of any size.
    """
    known = templates.select(F.col("bank_code").alias("t_bank"), "layout", "version", F.size("markers").alias("n"), F.array_distinct("markers").alias("ms")).withColumn("wanted", F.size("ms"))
    wanted = known.select("t_bank", "layout", "version", "n", "wanted", F.explode("ms").alias("marker"))
    hits = documents.select("document_id", F.explode(F.array_distinct("found")).alias("marker")).join(wanted, "marker")
    whole = hits.groupBy("document_id", "t_bank", "layout", "version", "n", "wanted").agg(F.count(F.lit(1)).alias("m")).filter("m = wanted")
    best = whole.groupBy("document_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "t_bank", "layout", (-F.col("version")).alias("v"))).alias("best"))
    banks = known.select(F.col("t_bank").alias("bank_code")).distinct().withColumn("known", F.lit(True))
    per = documents.select("document_id", "bank_code").distinct().join(best, "document_id", "left").join(banks, "bank_code", "left")
    reason = F.when(F.col("best").isNotNull(), "template_failed").when(F.col("known") & (F.col("bank_code") != "unknown"), "new_layout_for_known_bank")
    return per.select("document_id", F.when(F.col("best").isNotNull(), F.col("best.t_bank")).otherwise(F.col("bank_code")).alias("bank_code"), F.col("best.layout").alias("layout"), reason.alias("reason")).filter("reason is not null")


def recovered(documents: DataFrame) -> DataFrame:
    """State at a restart: work that was under way is marked as such."""
    status = F.when(F.col("status") == "PROCESSING", "FAILED").when(F.col("status") == "LEARNING", "NEEDS_REVIEW").otherwise(F.col("status"))
    return documents.withColumn("status", status)
