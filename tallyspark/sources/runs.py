"""Runs that are seen whole or not at all, and files that only one writer creates.

A run writes its tables under its own id; one manifest file, created only if it
is not there yet, makes all of them visible at once. A run that dies between
tables leaves nothing that a reader sees, and running it again under the same id
replaces what it left; a run that is already visible is left alone. Work goes on
in Spark; the driver only creates small files in the shared folder, through the
Hadoop file system.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files that one call of ``save_versions`` creates at most: what was learned in a run, not a corpus.
MOST_FILES = 10_000


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text; false if there is one already, which is then as it was.

    The text is written beside its place and renamed without overwriting, so a
    reader never sees a part of it and of two writers one wins.
    """
    jvm = spark._jvm
    target, fs = _fs(spark, path)
    fs.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{target.getName()}.{uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), none)
        return True
    except Exception as failed:
        fs.delete(draft, False)
        if fs.exists(target):
            return False
        raise failed


def _manifest(base: str, run: str) -> str:
    return f"{base.rstrip('/')}/manifests/{run}.json"


def persist(spark: SparkSession, base: str, run: str, tables: dict[str, DataFrame]) -> bool:
    """Write a run's tables and make them visible together; false if the run is visible already."""
    manifest, fs = _fs(spark, _manifest(base, run))
    if fs.exists(manifest):
        return False
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{base.rstrip('/')}/{name}/run={run}")
    return put_if_absent(spark, _manifest(base, run), json.dumps({"run": run, "tables": sorted(tables)}))


def runs(spark: SparkSession, base: str) -> list[str]:
    """The runs that are visible, by name."""
    folder, fs = _fs(spark, f"{base.rstrip('/')}/manifests")
    if not fs.exists(folder):
        return []
    names = (f.getPath().getName() for f in fs.listStatus(folder))
    return sorted(n.removesuffix(".json") for n in names if n.endswith(".json") and not n.startswith("_"))


def visible(spark: SparkSession, base: str, table: str, key: str | None = None) -> DataFrame:
    """All visible runs' rows of a table, with ``run``; of rows with equal ``key`` those of the last run by name."""
    paths = [f"{base.rstrip('/')}/{table}/run={r}" for r in runs(spark, base)]
    rows = spark.read.option("basePath", f"{base.rstrip('/')}/{table}").parquet(*paths).withColumn("run", F.col("run").cast("string"))
    if key is None:
        return rows
    last = rows.groupBy(key).agg(F.max("run").alias("run"))
    return rows.join(last, [key, "run"], "left_semi")


def save_versions(spark: SparkSession, base: str, templates: DataFrame) -> DataFrame:
    """Template rows (bank_code, layout_id, version, json) to files; (bank_code, layout_id, version, saved): false where another writer was first."""
    rows = templates.select("bank_code", "layout_id", "version", "json").limit(MOST_FILES + 1).collect()
    if len(rows) > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} templates to save at once")
    done = [(r["bank_code"], r["layout_id"], r["version"], put_if_absent(spark, f"{base.rstrip('/')}/{r['bank_code']}/{r['layout_id']}/v{r['version']}.json", r["json"])) for r in rows]
    return spark.createDataFrame(done, "bank_code string, layout_id string, version int, saved boolean")


def read_versions(spark: SparkSession, base: str) -> DataFrame:
    """(path, json) of the template files under a registry's folder; drafts are no templates."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "v*.json").text(base)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("json"))
