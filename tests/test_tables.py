"""Found tables: pages without a heading, and cuts that are computed once."""

import datetime

import duckdb
from pyspark.sql import functions as F

from tallyspark.operators import infer as I
from tallyspark.operators import lines as L
from tallyspark.operators import tables as T
from tallyspark.plans import engine, registry


def statements(tmp_path, keys_of):
    """A folder of orders and customers: for each customer its order keys, in the order of their dates."""
    c = duckdb.connect()
    day = datetime.datetime(2000, 1, 1)
    orders = [(k, doc, "F" if n % 2 else "O", 1000.25 + k, day + datetime.timedelta(days=n)) for doc, keys in keys_of.items() for n, k in enumerate(keys)]
    c.sql("CREATE TABLE orders (o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP)")
    c.executemany("INSERT INTO orders VALUES (?, ?, ?, ?, ?)", orders)
    c.sql("CREATE TABLE customer (c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE)")
    c.executemany("INSERT INTO customer VALUES (?, ?, 1, 500.5)", [(doc, f"Customer {doc}") for doc in keys_of])
    for t in ("orders", "customer"):
        c.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    return str(tmp_path), c


def test_tables_whose_first_row_shows_no_amount(spark, tmp_path):
    # 781 is a multiple of 71 and of 11: neither an amount nor a balance
    d, c = statements(tmp_path, {1: [781, 782, 783, 784], 2: [785, 786, 787]})
    df = registry.QUERIES["inf9_found_tables"](spark, d)
    expected = c.sql(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLES['inf9_found_tables']})").fetchall()
    assert [tuple(r) for r in df.collect()] == expected
    assert [doc for doc, *_ in expected] == [2]
    # the operator finds both, the one without a heading by its rows
    found = T.found_tables(L.group_lines(engine.labelled_words(spark, d)))
    assert sorted((r.doc, r.headings[1], len(r.bounds)) for r in found.collect()) == [(1, "second line", 6), (2, "Details", 6)]


def test_edges_of_a_gap_are_made_once(spark):
    df = spark.sql("select array(named_struct('x0', 10.0D, 'x1', 40.0D), named_struct('x0', 35.0D, 'x1', 55.0D), named_struct('x0', 90.0D, 'x1', 95.0D)) as ws from range(2)")
    gap = df.select(I.best_gap(F.col("ws"), F.lit(20.0), F.lit(80.0)).alias("gap"))
    assert [r.gap for r in gap.collect()] == [67.5, 67.5]
    # asked for inside the walk over the runs, an expression is computed again for each of them
    assert gap._jdf.queryExecution().analyzed().toString().count("array_distinct(") == 1
