import json

from pyspark.sql import functions as F

from tallyspark.streaming.ingest import ingest


def layout(text):
    return json.dumps({"format": 1, "layout": "x", "pages": [{"number": 1, "width": 100, "height": 100, "words": [[text, 1.25, 9, 5, 9], ["b", 10, 12.5, 5, 9]]}]})


def test_content_arrives_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    for name, text in (("a", "one"), ("b", "two"), ("c", "one")):
        (tmp_path / "in" / f"{name}.json").write_text(layout(text))
    ingest(spark, source, target, mark).awaitTermination()
    (tmp_path / "in" / "d.json").write_text(layout("three"))
    ingest(spark, source, target, mark).awaitTermination()
    rows = spark.read.parquet(target)
    assert sorted(r.text for r in rows.filter("seq = 0").collect()) == ["one", "three", "two"]
    assert rows.count() == 6 and rows.agg(F.max("x1")).first()[0] == 12.5
