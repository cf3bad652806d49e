"""Queries over the extraction store, bound to the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import store as S
from tallyspark.plans.bindings import table
from tallyspark.plans.registry import query

THRESHOLD = 5


def _events(spark, d) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    template = F.when(e % 23 != 0, F.concat(F.lit("bank"), (u % 4).cast("string"), F.lit("/layout-"), (u % 12).cast("string"), F.lit("/v"), (e % 3 + 1).cast("string")))
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return rows.withColumns({"document_id": u * 100 + F.dayofmonth("ts"), "template_id": template})


def extractions(spark, d) -> DataFrame:
    e = F.col("event_id")
    return _events(spark, d).select(
        e.alias("id"), "document_id", "template_id", F.col("ts").alias("created_at"), (e % 7 > 1).alias("verified"),
        F.when(e % 10 != 0, e % 3 != 0).alias("routing_required"), F.when(e % 10 != 0, F.when(e % 3 == 0, "earned_and_high").otherwise("not_verified")).alias("routing_reason"),
        F.when(e % 4 == 0, "medium").when(e % 9 != 0, "high").alias("confidence"),
    )


def reviews(spark, d) -> DataFrame:
    e = F.col("event_id")
    rows = _events(spark, d).filter("event_type in ('purchase', 'error')")
    flags = F.when((F.col("event_type") == "error") & (e % 6 == 0), F.array(F.concat(F.lit("txn."), (e % 5).cast("string")), F.lit("header.branch"))).otherwise(F.array().cast("array<string>"))
    missing = F.when((F.col("event_type") == "error") & (e % 12 == 0), F.array(F.lit("header.ifsc"))).otherwise(F.array().cast("array<string>"))
    return rows.select(e.alias("review_id"), e.alias("extraction_id"), "document_id", F.col("ts").alias("updated_at"), flags.alias("flags"), missing.alias("missing"))


def goldens(spark, d) -> DataFrame:
    e = F.col("event_id")
    rows = _events(spark, d).filter("event_type = 'signup' and event_id % 4 = 0")
    by = F.when(e % 24 == 0, F.lit(None)).when(e % 8 == 0, "owner").otherwise("agent")
    return rows.select(e.alias("id"), "document_id", "template_id", by.alias("approved_by"), F.when(e % 20 == 0, "superseded").otherwise("active").alias("status"), (e % 6 + 1).alias("version"))


def examples(spark, d) -> DataFrame:
    e = F.col("event_id")
    kind = F.when(e % 50 == 0, "approval").when(e % 2 == 0, "field_correction").otherwise("verdict")
    rows = _events(spark, d).filter("event_type = 'click' and template_id is not null")
    return rows.select(e.alias("id"), "template_id", kind.alias("kind"), F.col("ts").alias("created_at"), F.when(e % 5 != 0, F.expr("ts - make_interval(0, 0, 0, 0, cast(event_id % 48 as int))")).alias("occurred_at"), F.concat(F.lit("row:"), (e % 9).cast("string"), F.lit(":money")).alias("item"), F.when(e % 3 == 0, "disagree").otherwise("agree").alias("verdict"))


CTE = """
ev AS (SELECT event_id AS e, user_id AS u, ts, event_type, user_id * 100 + day(ts) AS document_id,
  CASE WHEN event_id % 23 <> 0 THEN 'bank' || (user_id % 4) || '/layout-' || (user_id % 12) || '/v' || (event_id % 3 + 1) END AS template_id,
  CASE WHEN event_id % 23 <> 0 THEN 'bank' || (user_id % 4) || '/layout-' || (user_id % 12) END AS layout FROM events),
rv AS (SELECT *, event_type = 'error' AND e % 6 = 0 AS marked FROM ev WHERE event_type IN ('purchase', 'error')),
gd AS (SELECT *, CASE WHEN e % 24 = 0 THEN NULL WHEN e % 8 = 0 THEN 'owner' ELSE 'agent' END AS approved_by, CASE WHEN e % 20 = 0 THEN 'superseded' ELSE 'active' END AS status, e % 6 + 1 AS version FROM ev WHERE event_type = 'signup' AND e % 4 = 0),
st AS (
  SELECT layout, document_id, min(e) AS first_id,
    CASE WHEN bool_or(e IN (SELECT e FROM rv WHERE marked)) THEN 'corrected'
         WHEN arg_max(CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END, e) = 1 OR document_id IN (SELECT document_id FROM gd WHERE status = 'active' AND coalesce(approved_by, 'owner') = 'owner') THEN 'matched' ELSE 'unreviewed' END AS outcome
  FROM ev WHERE layout IS NOT NULL GROUP BY layout, document_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY layout ORDER BY first_id DESC, document_id DESC) AS back FROM st),
broken AS (SELECT layout, min(back) AS at_row FROM ranked WHERE outcome = 'corrected' GROUP BY layout),
rec AS (SELECT layout, count(*) AS statements, count(*) FILTER (WHERE outcome = 'matched') AS matched, count(*) FILTER (WHERE outcome = 'corrected') AS corrected, count(*) FILTER (WHERE outcome = 'unreviewed') AS unreviewed,
  count(*) FILTER (WHERE outcome = 'matched' AND back < coalesce(at_row, 1000000000)) AS run FROM ranked LEFT JOIN broken USING (layout) GROUP BY layout)"""


@query("aut1_statements", f"WITH {CTE} SELECT layout, document_id, first_id, outcome FROM st")
def aut1_statements(spark, d):
    return S.statements(extractions(spark, d), reviews(spark, d), goldens(spark, d))


def _records(spark, d):
    return S.track_record(aut1_statements(spark, d), THRESHOLD)


@query("aut2_track_record", f"WITH {CTE} SELECT *, run >= 5 AS earned FROM rec")
def aut2_track_record(spark, d):
    return _records(spark, d)


@query("aut3_route", f"""WITH {CTE}, judged AS (SELECT e AS id, CASE WHEN e % 7 <= 1 THEN 'not_verified' WHEN e % 4 = 0 THEN 'confidence_medium' WHEN e % 9 = 0 THEN 'confidence_unknown' WHEN layout IS NULL THEN 'no_layout' WHEN NOT coalesce(run >= 5, false) THEN 'layout_not_earned' ELSE 'earned_and_high' END AS reason FROM ev LEFT JOIN rec USING (layout))
SELECT id, reason, reason <> 'earned_and_high' AS required FROM judged""")
def aut3_route(spark, d):
    return S.routed(extractions(spark, d), _records(spark, d), THRESHOLD).select("id", "reason", "required")


@query("aut4_drift", """WITH docs AS (SELECT doc_id AS document_id, CASE WHEN doc_id % 6 = 5 THEN 'unknown' ELSE 'bank' || (doc_id % 6) END AS bank_code, doc_id FROM documents),
t(bank_code, layout, version, least) AS (VALUES ('bank0', 'bank0/a', 1, 2), ('bank0', 'bank0/a', 2, 2), ('bank1', 'bank1/b', 1, 3), ('bank2', 'bank2/c', 1, 7))
SELECT document_id, CASE WHEN doc_id % 6 = 0 OR doc_id % 5 = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'bank1' ELSE 'bank0' END ELSE bank_code END AS bank_code,
  CASE WHEN doc_id % 5 = 0 THEN 'bank1/b' WHEN doc_id % 6 = 0 THEN 'bank0/a' END AS layout, CASE WHEN doc_id % 6 = 0 OR doc_id % 5 = 0 THEN 'template_failed' ELSE 'new_layout_for_known_bank' END AS reason
FROM docs WHERE doc_id % 6 = 0 OR doc_id % 5 = 0 OR bank_code IN ('bank1', 'bank2')""")
def aut4_drift(spark, d):
    i = F.col("doc_id")
    found = F.when(i % 5 == 0, F.array(F.lit("m1"), F.lit("m2"), F.lit("m3"))).when(i % 6 == 0, F.array(F.lit("m1"), F.lit("m2"))).otherwise(F.array(F.lit("m3")))
    docs = table(spark, d, "documents").select(i.alias("document_id"), F.when(i % 6 == 5, "unknown").otherwise(F.concat(F.lit("bank"), (i % 6).cast("string"))).alias("bank_code"), found.alias("found"))
    known = [("bank0", "bank0/a", 1, ["m1", "m2"]), ("bank0", "bank0/a", 2, ["m1", "m2"]), ("bank1", "bank1/b", 1, ["m1", "m2", "m3"]), ("bank2", "bank2/c", 1, ["m7"])]
    return S.drift(docs, spark.createDataFrame(known, "bank_code string, layout string, version int, markers array<string>"))


@query("aut5_dashboard", f"""WITH {CTE},
ver AS (SELECT layout, count(DISTINCT template_id) AS versions FROM ev WHERE layout IS NOT NULL AND e % 2 = 0 GROUP BY layout),
act AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY version DESC, e DESC) AS k FROM gd WHERE status = 'active') WHERE k = 1),
app AS (SELECT coalesce(layout, '(no layout)') AS layout, count(*) FILTER (WHERE coalesce(approved_by, 'owner') = 'owner') AS o, count(*) FILTER (WHERE approved_by = 'agent') AS a FROM act GROUP BY 1),
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY e DESC) AS k FROM ev) WHERE k = 1),
pas AS (SELECT coalesce(layout, '(not learned)') AS layout, count(*) FILTER (WHERE e % 7 > 1) AS v, count(*) AS n FROM cur GROUP BY 1),
keys AS (SELECT layout FROM rec UNION SELECT layout FROM ver UNION SELECT layout FROM app UNION SELECT layout FROM pas)
SELECT layout, coalesce(versions, 0) AS versions, coalesce(o, 0) AS golden_by_owner, coalesce(a, 0) AS golden_by_agent, coalesce(v, 0) AS verified, coalesce(n, 0) AS statements_now, coalesce(statements, 0) AS statements,
  coalesce(matched, 0) AS matched, coalesce(corrected, 0) AS corrected, coalesce(unreviewed, 0) AS unreviewed, coalesce(run, 0) AS run, coalesce(run >= 5, false) AS earned
FROM keys LEFT JOIN rec USING (layout) LEFT JOIN ver USING (layout) LEFT JOIN app USING (layout) LEFT JOIN pas USING (layout)""")
def aut5_dashboard(spark, d):
    from tallyspark.functions.text import layout_of

    known = extractions(spark, d).filter("id % 2 = 0 and template_id is not null").select(layout_of(F.col("template_id")).alias("layout"), F.col("template_id").alias("version"))
    return S.dashboard(extractions(spark, d), goldens(spark, d), _records(spark, d), known)


@query("agg6_interventions", f"WITH {CTE} SELECT strftime(ts, '%Y-W%W') AS week, count(*) FILTER (WHERE marked) AS corrected, count(*) AS reviews FROM rv GROUP BY 1 HAVING count(*) FILTER (WHERE marked) > 0 ORDER BY 1 DESC LIMIT 8")
def agg6_interventions(spark, d):
    return S.interventions(reviews(spark, d))


@query("aut5_waiting", f"WITH {CTE}, cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY e DESC) AS k FROM ev) WHERE k = 1) SELECT document_id, coalesce(layout, '(not learned)') AS layout, CASE WHEN e % 10 = 0 THEN 'before_routing' ELSE 'not_verified' END AS reason FROM cur WHERE (e % 10 = 0 OR e % 3 <> 0) AND event_type NOT IN ('purchase', 'error')")
def aut5_waiting(spark, d):
    return S.waiting(extractions(spark, d), reviews(spark, d))


@query("aut6_example_history", f"""WITH {CTE}, ex AS (SELECT e AS id, layout, CASE WHEN e % 50 = 0 THEN 'approval' WHEN e % 2 = 0 THEN 'field_correction' ELSE 'verdict' END AS kind, CASE WHEN e % 5 <> 0 THEN ts - to_hours(e % 48) ELSE ts END AS at_time FROM ev WHERE event_type = 'click' AND layout IS NOT NULL)
SELECT id, layout, kind, 'row:' || (id % 9) || ':money' AS item, CASE WHEN id % 3 = 0 THEN 'disagree' ELSE 'agree' END AS verdict FROM ex x WHERE kind = 'verdict' OR (kind = 'field_correction' AND NOT EXISTS (SELECT 1 FROM ex y WHERE y.layout = x.layout AND y.kind = 'approval' AND (y.at_time > x.at_time OR (y.at_time = x.at_time AND y.id >= x.id))))""")
def aut6_example_history(spark, d):
    return S.example_history(examples(spark, d))


@query("aut7_review_counts", f"WITH {CTE} SELECT document_id, arg_max(CASE WHEN marked THEN CASE WHEN e % 12 = 0 THEN 3 ELSE 2 END ELSE 0 END, e)::BIGINT AS marks FROM rv GROUP BY document_id")
def aut7_review_counts(spark, d):
    marks = (F.size("flags") + F.size("missing")).cast("long")
    return reviews(spark, d).groupBy("document_id").agg(F.max_by(marks, F.struct("updated_at", "review_id")).alias("marks"))


@query("aut8_mark_interrupted", "SELECT event_id, CASE event_type WHEN 'view' THEN 'FAILED' WHEN 'click' THEN 'NEEDS_REVIEW' ELSE event_type END AS status FROM events")
def aut8_mark_interrupted(spark, d):
    status = F.when(F.col("event_type") == "view", "PROCESSING").when(F.col("event_type") == "click", "LEARNING").otherwise(F.col("event_type"))
    return S.recovered(table(spark, d, "events").select("event_id", status.alias("status")))


@query("aut9_drift_events", f"WITH {CTE} SELECT e AS id, document_id, ts FROM ev WHERE event_type = 'view' AND e % 9 = 0 ORDER BY ts DESC, e DESC LIMIT 100")
def aut9_drift_events(spark, d):
    return _events(spark, d).filter("event_type = 'view' and event_id % 9 = 0").select(F.col("event_id").alias("id"), "document_id", "ts").orderBy(F.desc("ts"), F.desc("id")).limit(100)


@query("jn2_verified_documents", f"WITH {CTE} SELECT document_id, arg_max(template_id, e) AS template_id FROM ev WHERE e % 7 > 1 AND template_id IS NOT NULL GROUP BY document_id")
def jn2_verified_documents(spark, d):
    rows = extractions(spark, d).filter("verified and template_id is not null")
    return rows.groupBy("document_id").agg(F.max_by("template_id", "id").alias("template_id"))


@query("jn3_document_list", f"WITH {CTE} SELECT c_custkey AS document_id, coalesce(string_agg(e, ', ' ORDER BY e), '') AS extractions FROM customer LEFT JOIN ev ON document_id = c_custkey GROUP BY c_custkey")
def jn3_document_list(spark, d):
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"))
    per = extractions(spark, d).groupBy("document_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return docs.join(per, "document_id", "left").select("document_id", F.coalesce(F.array_join(F.transform("ids", lambda i: i.cast("string")), ", "), F.lit("")).alias("extractions"))


@query("jn4_sources", f"""WITH {CTE}, docs AS (SELECT DISTINCT document_id FROM ev), marks AS (SELECT document_id, count(*) AS n FROM rv GROUP BY 1), ver AS (SELECT document_id, max(version) AS version FROM gd GROUP BY 1),
src AS (SELECT p_partkey AS document_id FROM part)
SELECT document_id, true AS local, document_id IN (SELECT document_id FROM docs) AS stored, coalesce(n, 0) AS reviews, version FROM src LEFT JOIN marks USING (document_id) LEFT JOIN ver USING (document_id)
UNION ALL SELECT document_id, false, true, coalesce(n, 0), version FROM docs LEFT JOIN marks USING (document_id) LEFT JOIN ver USING (document_id) WHERE document_id NOT IN (SELECT document_id FROM src)""")
def jn4_sources(spark, d):
    """Local sources with what the store knows of them, then stored documents that have no source."""
    local = table(spark, d, "part").select(F.col("p_partkey").alias("document_id"))
    stored = extractions(spark, d).select("document_id").distinct()
    marks = reviews(spark, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("reviews"))
    versions = goldens(spark, d).groupBy("document_id").agg(F.max("version").alias("version"))
    first = local.join(stored.withColumn("stored", F.lit(True)), "document_id", "left").select("document_id", F.lit(True).alias("local"), F.coalesce("stored", F.lit(False)).alias("stored"))
    rest = stored.join(local, "document_id", "left_anti").select("document_id", F.lit(False).alias("local"), F.lit(True).alias("stored"))
    both = first.unionByName(rest).join(marks, "document_id", "left").join(versions, "document_id", "left")
    return both.select("document_id", "local", "stored", F.coalesce("reviews", F.lit(0)).alias("reviews"), "version")


@query("jn5_extraction_marks", f"WITH {CTE} SELECT e AS id, e IN (SELECT e FROM rv) AS reviewed, document_id IN (SELECT document_id FROM gd) AS golden FROM ev WHERE template_id IS NOT NULL")
def jn5_extraction_marks(spark, d):
    seen = reviews(spark, d).select(F.col("extraction_id").alias("id"), F.lit(True).alias("reviewed"))
    gold = goldens(spark, d).select("document_id").distinct().withColumn("golden", F.lit(True))
    rows = extractions(spark, d).filter("template_id is not null").join(seen, "id", "left").join(gold, "document_id", "left")
    return rows.select("id", F.coalesce("reviewed", F.lit(False)).alias("reviewed"), F.coalesce("golden", F.lit(False)).alias("golden"))


@query("agg5_kinds", f"WITH {CTE} SELECT CASE WHEN e % 50 = 0 THEN 'approval' WHEN e % 2 = 0 THEN 'field_correction' ELSE 'verdict' END AS kind, count(*) AS n FROM ev WHERE event_type = 'click' AND layout IS NOT NULL GROUP BY 1")
def agg5_kinds(spark, d):
    return examples(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("agg9_votes", f"WITH {CTE} SELECT layout, 'row:*:money' AS item, count(*) FILTER (WHERE e % 3 <> 0) AS agree, count(*) FILTER (WHERE e % 3 = 0) AS disagree FROM ev WHERE event_type = 'click' AND layout IS NOT NULL AND e % 2 = 1 GROUP BY layout")
def agg9_votes(spark, d):
    from tallyspark.functions.text import item_kind

    rows = S.example_history(examples(spark, d)).filter("kind = 'verdict'")
    return rows.groupBy("layout", item_kind(F.col("item")).alias("item")).agg(F.count_if(F.col("verdict") == "agree").alias("agree"), F.count_if(F.col("verdict") == "disagree").alias("disagree"))


@query("agg12_next_version", f"WITH {CTE} SELECT document_id, max(version) + 1 AS next_version, max(e) AS last_id FROM gd GROUP BY document_id")
def agg12_next_version(spark, d):
    return goldens(spark, d).groupBy("document_id").agg((F.max("version") + 1).alias("next_version"), F.max("id").alias("last_id"))


@query("win3_latest_extraction", f"WITH {CTE} SELECT document_id, e AS id, template_id FROM ev QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY e DESC) = 1")
def win3_latest_extraction(spark, d):
    return S.latest(extractions(spark, d).select("document_id", "id", "template_id"), ["document_id"], ["id"])


@query("win4_runs", f"WITH {CTE} SELECT layout, run FROM rec")
def win4_runs(spark, d):
    return _records(spark, d).select("layout", "run")


@query("snk1_extractions", "SELECT event_id AS id, user_id * 100 + day(ts) AS document_id FROM events")
def snk1_extractions(spark, d):
    """Appended to a table and read again."""
    from tallyspark.sources.tables import append, scratch

    path = scratch(spark, "extractions")
    append(extractions(spark, d).select("id", "document_id"), path)
    return spark.read.schema("id long, document_id long").parquet(path)


@query("snk2_insert_new", "SELECT o_custkey AS document_id, min(o_orderkey) AS first_seen FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1")
def snk2_insert_new(spark, d):
    stored = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("document_id"))
    return S.insert_new(stored, table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("first_seen")), ["document_id"])


@query("snk3_reviews", f"""WITH {CTE}, r AS (SELECT e, document_id, e % 3 AS extraction_id, CASE WHEN e % 4 = 0 THEN event_type END AS feedback FROM rv)
SELECT document_id, extraction_id, max(e) AS review_id, arg_max(feedback, e) FILTER (WHERE feedback IS NOT NULL) AS feedback FROM r GROUP BY ALL""")
def snk3_reviews(spark, d):
    rows = reviews(spark, d).join(table(spark, d, "events").select(F.col("event_id").alias("review_id"), "event_type"), "review_id")
    rows = rows.withColumns({"extraction_id": F.col("review_id") % 3, "updated_at": F.col("review_id"), "feedback": F.when(F.col("review_id") % 4 == 0, F.col("event_type"))}).drop("event_type")
    return S.merged_reviews(rows).select("document_id", "extraction_id", "review_id", "feedback")


@query("snk4_golden_versions", f"WITH {CTE} SELECT e AS id, document_id, coalesce((SELECT max(version) FROM gd g WHERE g.document_id = ev.document_id), 0) + row_number() OVER (PARTITION BY document_id ORDER BY e) AS version FROM ev WHERE event_type = 'purchase'")
def snk4_golden_versions(spark, d):
    new = _events(spark, d).filter("event_type = 'purchase'").select(F.col("event_id").alias("id"), "document_id")
    return S.next_versions(goldens(spark, d), new, "document_id").select("id", "document_id", "version")


@query("snk5_examples", f"""WITH {CTE}, x AS (SELECT u % 7 AS document_id, event_type AS kind, 'src' || (e % 3) AS source, e, CASE WHEN e % 4 = 0 THEN e END AS occurred FROM ev WHERE e % 2 = 0 OR e % 3 = 0)
SELECT sha256(kind || '|' || document_id || '||' || source || '|p') AS key, kind, document_id, source, min(occurred) AS occurred_at FROM x GROUP BY kind, document_id, source""")
def snk5_examples(spark, d):
    e = F.col("event_id")
    rows = table(spark, d, "events").select((F.col("user_id") % 7).alias("document_id"), F.col("event_type").alias("kind"), F.concat(F.lit("src"), (e % 3).cast("string")).alias("source"), F.lit(None).cast("string").alias("template_id"), F.lit("p").alias("payload"), F.when(e % 4 == 0, e).alias("occurred_at"), e.alias("created_at"))
    stored, new = rows.filter("created_at % 2 = 0 and created_at < 0"), rows.filter("created_at % 2 = 0 or created_at % 3 = 0")
    return S.add_examples(stored, new).select("key", "kind", "document_id", "source", "occurred_at")


@query("snk6_last_job_state", "SELECT user_id AS job_id, arg_max(event_type, event_id) AS status, count(*) AS updates FROM events GROUP BY 1")
def snk6_last_job_state(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.max_by("event_type", "event_id").alias("status"), F.count(F.lit(1)).alias("updates"))


@query("srt1_templates", "SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_type, p_size DESC, p_partkey) AS place FROM part WHERE p_retailprice > 900.5")
def srt1_templates(spark, d):
    """Approved templates in their fixed order: a registry listing, small by nature."""
    from tallyspark.operators.ranking import global_rank

    rows = table(spark, d, "part").filter("p_retailprice > 900.5").select("p_partkey", "p_brand", "p_type", "p_size")
    return global_rank(rows, [F.col("p_brand"), F.col("p_type"), F.desc("p_size"), F.col("p_partkey")], "place").select("p_partkey", "place")


@query("srt3_latest_documents", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def srt3_latest_documents(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100)


@query("set2_layout_keys", f"WITH {CTE} SELECT layout FROM ev WHERE layout IS NOT NULL AND e % 2 = 0 UNION SELECT layout FROM gd WHERE layout IS NOT NULL")
def set2_layout_keys(spark, d):
    from tallyspark.functions.text import layout_of

    keys = lambda df: df.filter("template_id is not null").select(layout_of(F.col("template_id")).alias("layout"))
    return keys(extractions(spark, d).filter("id % 2 = 0")).unionByName(keys(goldens(spark, d))).distinct()


@query("set3_not_local", f"WITH {CTE} SELECT DISTINCT document_id FROM ev WHERE document_id NOT IN (SELECT p_partkey FROM part)")
def set3_not_local(spark, d):
    local = table(spark, d, "part").select(F.col("p_partkey").alias("document_id"))
    return extractions(spark, d).select("document_id").distinct().join(local, "document_id", "left_anti")


@query("top3_changes_per_layout", f"WITH {CTE} SELECT layout, e AS id, row_number() OVER (PARTITION BY layout ORDER BY e) AS nth FROM ev WHERE layout IS NOT NULL QUALIFY nth <= 20")
def top3_changes_per_layout(spark, d):
    from pyspark.sql import Window

    from tallyspark.functions.text import layout_of

    rows = extractions(spark, d).filter("template_id is not null").select(layout_of(F.col("template_id")).alias("layout"), "id")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("layout").orderBy("id")).cast("long")).filter("nth <= 20")
