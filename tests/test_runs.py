"""Commits that are seen whole, files that one writer creates, jobs followed through late and repeated events."""

import datetime as dt
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import learning as N
from tallyspark.sources import runs as U
from tallyspark.streaming import jobs as J
from tallyspark.streaming.ingest import counts_by_window


def test_a_run_that_dies_leaves_nothing_and_is_done_again(spark, tmp_path):
    base = str(tmp_path / "store")
    one, other = spark.createDataFrame([(1, "a"), (2, "b")], "doc int, x string"), spark.createDataFrame([(1, 0.5)], "doc int, y double")
    bad = one.select("doc", F.raise_error(F.lit("lost")).cast("string").alias("x"))
    with pytest.raises(Exception, match="lost"):
        U.persist(spark, base, "r1", {"one": one, "other": bad})
    assert U.runs(spark, base) == []
    assert U.persist(spark, base, "r1", {"one": one, "other": other}) is True
    assert U.persist(spark, base, "r1", {"one": one.withColumn("x", F.lit("again")), "other": other}) is False
    assert U.persist(spark, base, "r2", {"one": one.filter("doc = 2").withColumn("x", F.lit("newer"))}) is True
    assert U.runs(spark, base) == ["r1", "r2"]
    assert sorted((r.doc, r.x, r.run) for r in U.visible(spark, base, "one", "doc").collect()) == [(1, "a", "r1"), (2, "newer", "r2")]
    assert U.visible(spark, base, "one").count() == 3


def test_of_two_writers_of_a_version_one_wins(spark, tmp_path):
    rows = [spark.createDataFrame([("b", "l", 1, json.dumps({"by": n})), ("b", "l", 2 + n, json.dumps({"by": n}))], "bank_code string, layout_id string, version int, json string") for n in (0, 1)]
    out = {}
    threads = [threading.Thread(target=lambda n=n: out.__setitem__(n, {(r.version, r.saved) for r in U.save_versions(spark, str(tmp_path), rows[n]).collect()})) for n in (0, 1)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [n for n in (0, 1) if (1, True) in out[n]]
    assert len(won) == 1 and (1, False) in out[1 - won[0]] and (2, True) in out[0] and (3, True) in out[1]
    files = {r.path.rsplit("/", 1)[1]: json.loads(r.json)["by"] for r in U.read_versions(spark, str(tmp_path)).collect()}
    assert files == {"v1.json": won[0], "v2.json": 0, "v3.json": 1}
    assert sorted(p.name for p in (tmp_path / "b" / "l").iterdir() if not p.name.startswith(".")) == ["v1.json", "v2.json", "v3.json"]


def slow_jobs(events, now, limit):
    """Ended jobs of one document, from all its events at once."""
    seen = sorted(set(e for e in events if e[0] <= now))
    out = []
    for n, (t, _, kind) in enumerate(seen):
        if kind != "started":
            continue
        later = next(((u, k) for u, _, k in seen[n + 1 :] if k in J.ENDS), None)
        if later and later[0] <= t + limit:
            out.append((t, J.ENDS[later[1]], later[0]))
        elif t + limit <= now:
            out.append((t, "timed_out", t + limit))
    return sorted(out)


def test_jobs_equal_a_reading_of_all_events_at_once():
    rng = random.Random(4)
    for _ in range(300):
        events = [(rng.randrange(1, 400) * 1000, i, rng.choice(["started", "started", "finished", "failed", "other"])) for i in range(rng.randrange(1, 12))]
        events += rng.sample(events, rng.randrange(len(events) + 1))
        # batches in the order of arrival, out of order by less than the watermark's delay
        arrival = sorted(events, key=lambda e: e[0] + rng.randrange(0, 50_000))
        held, ended, mark, top = {"open": None, "waiting": []}, [], 0, 0
        for s in range(0, len(arrival), 3):
            batch = arrival[s : s + 3]
            ended += J.follow(held, batch, mark, 60)
            held = json.loads(json.dumps(held))
            top = max([top, *[t for t, _, _ in batch]])
            mark = max(mark, (top - 50_000) // 1000)
        ended += J.follow(held, [], mark, 60)
        ended += J.follow(held, [], 1000, 60)
        assert sorted(ended) == slow_jobs(events, 1_000_000, 60_000)


def test_a_stream_of_jobs_goes_on_after_a_restart(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    schema = "document_id long, event_id long, at timestamp, kind string"
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def arrive(*events):
        spark.createDataFrame([(d, i, at(m), k) for d, i, m, k in events], schema).coalesce(1).write.mode("append").parquet(source)
        stream = J.job_states(spark.readStream.schema(schema).parquet(source), timeout_ms=60 * 60_000)
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.document_id, r.status, r.ended_at) for r in spark.read.schema(J.JOBS).parquet(target).collect())

    assert arrive((1, 1, 0, "started"), (2, 2, 1, "started"), (9, 3, 2, "other")) == []
    # late but within the delay, and once more
    got = arrive((1, 5, 10, "finished"), (1, 4, 5, "failed"), (1, 4, 5, "failed"), (9, 6, 40, "other"))
    assert got == [(1, "failed", at(5))]
    # too late to count; the clock goes on
    got = arrive((2, 7, 3, "finished"), (9, 8, 90, "other"))
    assert got == [(1, "failed", at(5)), (2, "timed_out", at(61))]


def test_windowed_counts_of_a_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h, m), k) for h, m, k in ((0, 5, "a"), (0, 50, "a"), (1, 10, "b"), (9, 0, "a"))]
    spark.createDataFrame(rows, "ts timestamp, event_type string").write.parquet(str(tmp_path / "in"))
    stream = counts_by_window(spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "mark")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.start.hour, r.event_type, r.n) for r in spark.table("counted").collect()) == [(0, "a", 2), (1, "b", 1)]


def test_approvals_take_the_latest_extraction_before_them(spark):
    t = lambda n: dt.datetime(2024, 1, 1, n)
    made = spark.createDataFrame([(1, 10, "a/l/v1", t(1)), (2, 10, "a/l/v2", t(3)), (3, 11, None, t(2)), (4, 10, "a/l/v3", t(9))], "id long, document_id long, template_id string, created_at timestamp")
    asked = spark.createDataFrame([(10, t(0), "owner"), (10, t(3), "owner"), (10, t(5), "owner"), (11, t(2), "agent"), (12, t(5), "owner")], "document_id long, approved_at timestamp, source string")
    first = N.recorded_examples(asked, made)
    assert sorted((r.document_id, r.extraction_id, r.template_id, r.occurred_at) for r in first.collect()) == [(10, 2, "a/l/v2", t(3)), (11, 3, None, t(2))]
    assert N.new_examples(first, first).count() == 0
