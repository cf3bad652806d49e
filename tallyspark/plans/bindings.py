"""Views of the driver's tables in the engine's own terms, and the same views in SQL.

Money is whole cents in a BIGINT. Every view is a narrow projection or one
keyed shuffle of a base table, and names only the columns it needs, so that
pruning reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer parts than there are cores, dealt over all of them; larger scans stay where they are.

    A small table is one row group, so all that is computed over it would be one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cents(value: Column) -> Column:
    return F.round(value * 100).cast("long")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bank transactions of their customer.

    doc, i (printed place), o_orderkey, txn_date, debit, credit, balance, opening.
    Every third document is printed newest first. Faults by o_orderkey: balance
    off by one (% 53), missing (% 11), no amount (% 71), negative amount (% 97).
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    accounts = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    by = Window.partitionBy("doc").orderBy("txn_date", "o_orderkey")
    rows = orders.join(accounts, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("doc"), "o_orderkey", F.col("o_orderdate").cast("date").alias("txn_date"),
        (F.col("o_orderstatus") == "F").alias("is_debit"), cents(F.col("o_totalprice")).alias("amount"), cents(F.col("c_acctbal")).alias("start"),
    )
    rows = rows.withColumns({
        "nth": F.row_number().over(by) - 1,
        "n": F.count(F.lit(1)).over(Window.partitionBy("doc")),
        "true": F.col("start") + F.sum(F.when(F.col("is_debit"), -F.col("amount")).otherwise(F.col("amount"))).over(by),
    })
    key = F.col("o_orderkey")
    shown = F.when(key % 71 == 0, F.lit(None)).when(key % 97 == 0, -F.col("amount")).otherwise(F.col("amount"))
    return rows.select(
        "doc",
        F.when(F.col("doc") % 3 == 0, F.col("n") - 1 - F.col("nth")).otherwise(F.col("nth")).cast("int").alias("i"),
        "o_orderkey", "txn_date",
        F.when(F.col("is_debit"), shown).alias("debit"),
        F.when(~F.col("is_debit"), shown).alias("credit"),
        F.when(key % 11 == 0, F.lit(None)).when(key % 53 == 0, F.col("true") + 1).otherwise(F.col("true")).alias("balance"),
        F.when(F.col("doc") % 5 != 0, F.col("start")).alias("opening"),
    )


LEDGER_SQL = """
ledger_raw AS (
  SELECT o_custkey AS doc, o_orderkey, CAST(o_orderdate AS DATE) AS txn_date, o_orderstatus = 'F' AS is_debit,
         CAST(round(o_totalprice * 100) AS BIGINT) AS amount, CAST(round(c_acctbal * 100) AS BIGINT) AS start
  FROM orders JOIN customer ON o_custkey = c_custkey),
ledger_run AS (
  SELECT *, row_number() OVER w - 1 AS nth, count(*) OVER (PARTITION BY doc) AS n,
         start + sum(CASE WHEN is_debit THEN -amount ELSE amount END) OVER w AS truth
  FROM ledger_raw WINDOW w AS (PARTITION BY doc ORDER BY txn_date, o_orderkey ROWS UNBOUNDED PRECEDING)),
ledger AS (
  SELECT doc, CAST(CASE WHEN doc % 3 = 0 THEN n - 1 - nth ELSE nth END AS INTEGER) AS i, o_orderkey, txn_date,
         CASE WHEN is_debit AND o_orderkey % 71 <> 0 THEN CASE WHEN o_orderkey % 97 = 0 THEN -amount ELSE amount END END AS debit,
         CASE WHEN NOT is_debit AND o_orderkey % 71 <> 0 THEN CASE WHEN o_orderkey % 97 = 0 THEN -amount ELSE amount END END AS credit,
         CAST(CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 53 = 0 THEN truth + 1 ELSE truth END AS BIGINT) AS balance,
         CASE WHEN doc % 5 <> 0 THEN start END AS opening
  FROM ledger_run)"""


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: what the statement prints about itself (null where it does not)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name", "c_nationkey")
    key = F.col("c_custkey")
    totals = ledger(spark, sf_dir).groupBy("doc").agg(
        F.sum("debit").alias("debits"), F.sum("credit").alias("credits"), F.count("debit").alias("n_debit"), F.count("credit").alias("n_credit"),
        F.min("txn_date").alias("first"), F.max("txn_date").alias("last"), F.max_by("balance", F.struct("txn_date", "o_orderkey")).alias("latest"),
    )
    off = F.when(key % 13 == 0, 1).otherwise(0)
    printed = key % 7 != 0
    start = F.date_add("first", F.when(key % 17 == 0, 2).otherwise(0))
    return c.join(totals, key == F.col("doc")).select(
        "doc",
        F.when(key % 5 != 0, cents(F.col("c_acctbal"))).alias("opening"),
        F.when(key % 3 != 1, F.col("latest") + off).alias("closing"),
        F.when(printed, F.coalesce("debits", F.lit(0)) + off).cast("long").alias("total_debits"),
        F.when(printed, F.coalesce("credits", F.lit(0))).cast("long").alias("total_credits"),
        F.when(printed, F.col("n_debit")).cast("long").alias("debit_count"),
        F.when(printed, F.col("n_credit") + off).cast("long").alias("credit_count"),
        F.when(key % 19 == 0, F.lit(None)).when(key % 23 == 0, F.col("last")).otherwise(start).alias("period_start"),
        F.when(key % 23 == 0, F.col("first")).otherwise(F.col("last")).alias("period_end"),
        F.when(key % 29 != 0, F.concat(F.lit("ABCD"), F.when(key % 31 == 0, "1").otherwise("0"), F.lpad(key.cast("string"), 6, "0"))).alias("ifsc"),
        F.when(key % 37 != 0, F.when(key % 41 == 0, F.lit("12-34")).otherwise(F.lpad(key.cast("string"), 10, "X"))).alias("account_number"),
        F.when(key % 2 == 0, F.lpad((key * 1003).cast("string"), 9, "0")).alias("routing_number"),
        F.when(key % 43 != 0, F.col("c_name")).alias("account_holder_name"),
    )


HEADERS_SQL = """
header_totals AS (
  SELECT doc, sum(debit) AS debits, sum(credit) AS credits, count(debit) AS n_debit, count(credit) AS n_credit, min(txn_date) AS first_on, max(txn_date) AS last_on,
         (SELECT balance FROM ledger l WHERE l.doc = t.doc ORDER BY txn_date DESC, o_orderkey DESC LIMIT 1) AS latest
  FROM ledger t GROUP BY doc),
headers AS (
  SELECT doc, CASE WHEN doc % 5 <> 0 THEN CAST(round(c_acctbal * 100) AS BIGINT) END AS opening,
         CASE WHEN doc % 3 <> 1 THEN latest + (doc % 13 = 0)::INT END AS closing,
         CASE WHEN doc % 7 <> 0 THEN coalesce(debits, 0) + (doc % 13 = 0)::INT END::BIGINT AS total_debits,
         CASE WHEN doc % 7 <> 0 THEN coalesce(credits, 0) END::BIGINT AS total_credits,
         CASE WHEN doc % 7 <> 0 THEN n_debit END::BIGINT AS debit_count,
         CASE WHEN doc % 7 <> 0 THEN n_credit + (doc % 13 = 0)::INT END::BIGINT AS credit_count,
         CASE WHEN doc % 19 = 0 THEN NULL WHEN doc % 23 = 0 THEN last_on WHEN doc % 17 = 0 THEN first_on + 2 ELSE first_on END::DATE AS period_start,
         CASE WHEN doc % 23 = 0 THEN first_on ELSE last_on END AS period_end,
         CASE WHEN doc % 29 <> 0 THEN 'ABCD' || CASE WHEN doc % 31 = 0 THEN '1' ELSE '0' END || substr(lpad(doc::VARCHAR, 6, '0'), 1, 6) END AS ifsc,
         CASE WHEN doc % 37 <> 0 THEN CASE WHEN doc % 41 = 0 THEN '12-34' ELSE lpad(doc::VARCHAR, 10, 'X') END END AS account_number,
         CASE WHEN doc % 2 = 0 THEN lpad((doc * 1003)::VARCHAR, 9, '0') END AS routing_number,
         CASE WHEN doc % 43 <> 0 THEN c_name END AS account_holder_name
  FROM header_totals JOIN customer ON doc = c_custkey)"""
