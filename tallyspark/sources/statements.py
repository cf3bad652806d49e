"""Statements as JSON, CSV exports, and documents named by their content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = "2"
# fixed values: the columns of an export
EXPORT = ("row_index", "txn_date", "value_date", "description", "reference", "debit", "credit", "balance", "direction", "amount", "page", "extra")
STATEMENT = "schema_version string, header map<string,string>, transactions array<struct<row_index:int,txn_date:string,description:string,debit:string,credit:string,balance:string>>"
MONEY = r"^-?\d+(\.\d{1,2})?$"


def to_json(headers: DataFrame, txns: DataFrame) -> DataFrame:
    """(doc, json): one strict statement per document; money is text with two decimals."""
    text = lambda c: F.col(c).cast("decimal(18,2)").cast("string").alias(c)
    row = F.struct(F.col("i").cast("int").alias("row_index"), F.date_format("txn_date", "yyyy-MM-dd").alias("txn_date"), F.col("description"), text("debit"), text("credit"), text("balance"))
    rows = txns.groupBy("doc").agg(F.array_sort(F.collect_list(row)).alias("transactions"))
    whole = headers.select("doc", "header").join(rows, "doc", "left")
    return whole.select("doc", F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), "header", F.coalesce("transactions", F.array().cast("array<struct<row_index:int,txn_date:string,description:string,debit:string,credit:string,balance:string>>")).alias("transactions"))).alias("json"))


def from_json(texts: DataFrame) -> DataFrame:
    """(doc, header, transactions, bad_money): parsed statements; version 1 names the bank's name ``bank``."""
    s = texts.select("doc", F.from_json("json", STATEMENT).alias("s"))
    old = F.col("s.schema_version") == "1"
    renamed = F.transform_keys("s.header", lambda k, v: F.when(old & (k == "bank"), F.lit("bank_name")).otherwise(k))
    money = lambda t: F.exists(F.array(t["debit"], t["credit"], t["balance"]), lambda m: F.coalesce(~m.rlike(MONEY), F.lit(False)))
    return s.select("doc", renamed.alias("header"), F.col("s.transactions").alias("transactions"), F.exists("s.transactions", money).alias("bad_money"))


def transactions_of(statements: DataFrame) -> DataFrame:
    t = statements.select("doc", F.inline("transactions"))
    return t.select("doc", "row_index", F.to_date("txn_date").alias("txn_date"), "description", *[F.col(c).try_cast("decimal(18,2)").alias(c) for c in ("debit", "credit", "balance")])


def export_csv(txns: DataFrame, path: str) -> None:
    """Transactions of a document as CSV with the fixed columns in order."""
    have = set(txns.columns)
    txns.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in EXPORT]).write.csv(path, header=True)


def header_rows(headers: DataFrame, fields: list[str]) -> DataFrame:
    """(doc, field, value): a header as key and value rows."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return headers.select("doc", F.inline(each))


def documents_by_prefix(docs: DataFrame, prefix: str) -> DataFrame:
    """Documents whose id begins so; a lookup is good only if there is one."""
    return docs.filter(F.col("document_id").startswith(prefix))


def stored_documents(arriving: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """(name, content) to one row per content: document_id (SHA-256), size, the first name; larger ones are left out."""
    rows = arriving.select("name", F.octet_length("content").cast("long").alias("size"), F.sha2(F.col("content").cast("binary"), 256).alias("document_id"))
    if max_bytes is not None:
        rows = rows.filter(F.col("size") <= max_bytes)
    return rows.groupBy("document_id").agg(F.min("name").alias("name"), F.first("size").alias("size"), F.count(F.lit(1)).alias("copies"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of all files under a path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), "content")


def latest_name(docs: DataFrame) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("received_at"), "name"))
    return docs.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")
