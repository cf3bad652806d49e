"""Queries of what runs leave behind: committed tables, saved templates, jobs in time, recorded examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import learning as N
from tallyspark.operators import validate as V
from tallyspark.plans import store as P
from tallyspark.plans.bindings import headers, ledger, table
from tallyspark.plans.checks import REPORT_SQL
from tallyspark.plans.registry import query
from tallyspark.sources import runs as U
from tallyspark.sources.tables import scratch, stored
from tallyspark.streaming import jobs as J


@query("pip2_persisted_run", f"""{REPORT_SQL} SELECT doc, status, verified, CASE WHEN status = 'PASS' THEN 'earned' ELSE 'review' END AS route, doc % 2 AS run FROM report""")
def pip2_persisted_run(spark, d):
    """Two runs over all ledgers, one begun twice; what readers then see of their tables."""
    base = scratch(spark, "store")
    report = stored(V.reports(V.check_results(ledger(spark, d), headers(spark, d))), "reports").select("doc", "status", "verified")
    routes = report.select("doc", F.when(F.col("status") == "PASS", "earned").otherwise("review").alias("route"))
    part = lambda rows, k: rows.filter(F.col("doc") % 2 == k)
    # what a run that died leaves: one table, and a reader sees none of it
    part(report, 0).withColumn("status", F.lit("HALF")).write.parquet(f"{base}/extractions/run=0")
    for k in (0, 1, 1):
        U.persist(spark, base, str(k), {"extractions": part(report, k), "routing": part(routes, k)})
    return U.visible(spark, base, "extractions", "doc").join(U.visible(spark, base, "routing", "doc").drop("run"), "doc").select("doc", "status", "verified", "route", F.col("run").cast("long").alias("run"))


@query("snk7_saved_versions", """WITH t AS (SELECT p_brand AS bank_code, 'layout-' || (p_size % 3) AS layout_id, max(p_partkey % 4 + 1)::INT AS version FROM part GROUP BY ALL)
SELECT bank_code, layout_id, version, true AS saved, 'first' AS content FROM t UNION ALL SELECT bank_code, layout_id, version, false, 'first' FROM t WHERE layout_id = 'layout-1' UNION ALL SELECT bank_code, layout_id, version + 1, true, 'second' FROM t WHERE layout_id <> 'layout-1'""")
def snk7_saved_versions(spark, d):
    """Templates saved by two writers that meet at some versions; what is then in the files."""
    base = scratch(spark, "registry")
    own = table(spark, d, "part").groupBy(F.col("p_brand").alias("bank_code"), F.concat(F.lit("layout-"), (F.col("p_size") % 3).cast("string")).alias("layout_id")).agg(F.max(F.col("p_partkey") % 4 + 1).cast("int").alias("version"))
    own = stored(own, "versions")
    first = U.save_versions(spark, base, own.withColumn("json", F.lit('{"by":"first"}')))
    later = own.withColumn("version", F.when(F.col("layout_id") == "layout-1", F.col("version")).otherwise(F.col("version") + 1))
    second = U.save_versions(spark, base, later.withColumn("json", F.lit('{"by":"second"}')))
    files = U.read_versions(spark, base).select(F.regexp_extract(F.url_decode("path"), r"/([^/]+/[^/]+/v\d+)\.json$", 1).alias("id"), F.get_json_object("json", "$.by").alias("content"))
    saved = first.unionByName(second).withColumn("id", F.concat_ws("/", "bank_code", "layout_id", F.concat(F.lit("v"), F.col("version").cast("string"))))
    return saved.join(files, "id", "left").drop("id")


#: What the events of the test table mean to a job.
KINDS = {"signup": "started", "purchase": "finished", "error": "failed"}


@query("pip3_job_states", """WITH mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS w FROM events),
e AS (SELECT user_id, event_id, ts, event_type FROM events, mark WHERE event_type IN ('signup', 'purchase', 'error') AND ts <= w),
n AS (SELECT *, lead(ts) OVER o AS next_at, lead(event_type) OVER o AS next_type FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id AS document_id, ts AS started_at, CASE WHEN next_at <= ts + INTERVAL 6 HOUR THEN CASE next_type WHEN 'purchase' THEN 'finished' WHEN 'error' THEN 'failed' ELSE 'interrupted' END ELSE 'timed_out' END AS status,
  CASE WHEN next_at <= ts + INTERVAL 6 HOUR THEN next_at ELSE ts + INTERVAL 6 HOUR END AS ended_at
FROM n, mark WHERE event_type = 'signup' AND (next_at <= ts + INTERVAL 6 HOUR OR ts + INTERVAL 6 HOUR <= w)""")
def pip3_job_states(spark, d):
    """The events as a stream of files, each event twice; jobs that ended by the time the watermark reached."""
    source, base = scratch(spark, "events"), scratch(spark, "jobs")
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    rows = table(spark, d, "events").select(F.col("user_id").alias("document_id"), "event_id", F.col("ts").cast("timestamp").alias("at"), F.coalesce(F.try_element_at(kind, F.col("event_type")), F.lit("other")).alias("kind"))
    rows.unionByName(rows).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    J.job_states(stream).writeStream.format("parquet").option("path", base).option("checkpointLocation", f"{base}-mark").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    plain = table(spark, d, "events").schema["ts"].dataType
    return spark.read.schema(J.JOBS).parquet(base).select("document_id", *[F.col(c).cast(plain).alias(c) for c in ("started_at", "ended_at")], "status")


@query("lrn9_recorded_examples", f"""WITH {P.CTE}, x AS (SELECT e AS id, document_id, template_id, ts FROM ev WHERE event_type <> 'signup'), a AS (SELECT document_id, ts, CASE WHEN e % 8 = 0 THEN 'owner' ELSE 'agent' END AS source FROM ev WHERE event_type = 'signup' AND e % 4 = 0),
j AS (SELECT a.document_id, a.ts, a.source, (SELECT max(struct_pack(ts := x.ts, id := x.id)).id FROM x WHERE x.document_id = a.document_id AND x.ts <= a.ts) AS extraction_id FROM a)
SELECT j.document_id, x.template_id, j.extraction_id, min(j.ts) AS occurred_at, 'approval' AS kind, 1 AS added FROM j JOIN x ON x.id = j.extraction_id GROUP BY j.document_id, x.template_id, j.extraction_id, j.source""")
def lrn9_recorded_examples(spark, d):
    """Examples of all approvals, recorded twice; the second time adds none."""
    rows = P._events(spark, d)
    made = rows.filter("event_type <> 'signup'").select(F.col("event_id").alias("id"), "document_id", "template_id", F.col("ts").alias("created_at"))
    asked = rows.filter("event_type = 'signup' and event_id % 4 = 0").select("document_id", F.col("ts").alias("approved_at"), F.when(F.col("event_id") % 8 == 0, "owner").otherwise("agent").alias("source"))
    first = stored(N.recorded_examples(asked, made), "examples")
    again = N.new_examples(N.recorded_examples(asked, made), first)
    added = first.withColumn("added", F.lit(1)).unionByName(again.withColumn("added", F.lit(2)))
    return added.select("document_id", "template_id", "extraction_id", "occurred_at", "kind", "added")
