"""Mutations of a ledger that adds up: each gives exactly the issues it should."""

import random
from datetime import date, timedelta

import pytest

from tallyspark.operators import validate as v

SCHEMA = "doc long, i int, txn_date date, debit long, credit long, balance long, opening long"


def good(n=24, doc=1, opening=10_000):
    rng, rows, balance = random.Random(doc), [], opening
    for i in range(n):
        amount, out = rng.randrange(1, 9_000), rng.random() < 0.5
        balance += -amount if out else amount
        rows.append([doc, i, date(2024, 1, 1) + timedelta(days=i), amount if out else None, None if out else amount, balance, opening])
    return rows


def issues(spark, rows):
    return sorted((r.code, r.row_index) for r in v.chain_issues(spark.createDataFrame([tuple(r) for r in rows], SCHEMA)).collect())


def test_a_good_ledger_has_no_issues(spark):
    assert issues(spark, good()) == []


def test_changing_one_amount_flags_that_row_only(spark):
    rows = []
    for k in range(24):
        one = good(doc=k)
        at = 3 if one[k][3] is not None else 4
        one[k][at] += 1
        rows += one
    found = v.chain_issues(spark.createDataFrame([tuple(r) for r in rows], SCHEMA)).collect()
    assert sorted((r.doc, r.code, r.row_index) for r in found) == [(k, "balance_mismatch", k) for k in range(24)]


def test_changing_a_balance_flags_it_and_the_next(spark):
    rows = good()
    rows[7][5] += 5
    assert issues(spark, rows) == [("balance_mismatch", 7), ("balance_mismatch", 8)]


def test_a_missing_balance_is_carried(spark):
    rows = good()
    rows[7][5] = None
    assert issues(spark, rows) == [("balance_missing", 7)]


def test_an_error_row_without_balance_leaves_the_next_unchecked(spark):
    rows = good()
    rows[7][3] = rows[7][4] = rows[7][5] = None
    rows[8][3], rows[8][4] = 1, None
    assert issues(spark, rows) == [("missing_amount", 7)]


def test_negative_and_no_opening(spark):
    rows = good()
    for r in rows:
        r[6] = None
    rows[5][3], rows[5][4] = -3, None
    assert issues(spark, rows) == [("negative_amount", 5), ("no_opening_balance", 0)]


def test_newest_first_is_checked_oldest_first(spark):
    rows = list(reversed(good()))
    for i, r in enumerate(rows):
        r[1] = i
    assert issues(spark, rows) == []


def test_no_running_balance_is_one_warning(spark):
    rows = good()
    for r in rows:
        r[5] = None
    assert issues(spark, rows) == [("no_running_balance", None)]


@pytest.mark.parametrize("number,valid", [("021000021", True), ("021000022", False), ("12345678", False), ("0210000210", False), ("02100002a", False)])
def test_routing_numbers(spark, number, valid):
    from pyspark.sql import functions as F

    assert spark.range(1).select(v.routing_number_valid(F.lit(number))).first()[0] is valid
