from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.functions import dates, money, text


def amounts(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [(r.a.ok, r.a.value, r.a.suffix) for r in df.select("i", money.parse_amount(F.col("t")).alias("a")).orderBy("i").collect()]


VECTORS = [
    ("1,20,749.89", True, "120749.89", None), ("-", True, None, None), ("", True, None, None), ("9,999.99CR", True, "9999.99", "CR"), ("5.00 Dr.", True, "5", "DR"), ("(12.00)", True, "-12", None),
    ("45.10-", True, "-45.10", None), ("-₹ 5", True, "-5", None), ("(₹ 5 )", True, "-5", None), ("Rs. 50", True, "50", None), ("12.00 USD", True, "12", None), ("US$ 1", True, "1", None),
    ("(5.00", True, "5", None), ("(-5.00)", True, "5", None), ("abc", False, None, None), ("1.2.3", False, None, None), (",", False, None, None), ("₹ -", True, None, None), (None, True, None, None), ("1 2", False, None, None),
]


def test_amounts(spark):
    expected = [(ok, None if value is None else Decimal(value), suffix) for _, ok, value, suffix in VECTORS]
    assert amounts(spark, [t for t, *_ in VECTORS]) == expected


FORMATS = [n for n, _ in dates.CANDIDATES]


def test_dates_equal_the_standard_parser(spark):
    days = [date(1969, 1, 2), date(1998, 12, 31), date(2024, 2, 29), date(2068, 5, 6), date(2005, 10, 9)]
    texts = sorted({d.strftime(f) for d in days for f in FORMATS} | {"31/02/2024", "1/2/2024", "13/13/2024", "", "x", "2024-1-5", "05/06/20245", " 5  Jan 2024"})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r.t: r for r in df.select("t", *[dates.by_format(text.normalize_space(F.col("t")), f).alias(f"f{k}") for k, f in enumerate(FORMATS)]).collect()}
    for t in texts:
        for k, f in enumerate(FORMATS):
            yearless = f in ("%m/%d", "%b %d")
            try:
                clean = " ".join(t.split())
                expected = datetime.strptime(f"{clean} 1904" if yearless else clean, f"{f} %Y" if yearless else f).date()
            except ValueError:
                expected = None
            assert found[t][f"f{k}"] == expected, (t, f)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \t\n\xa0　0"), min_size=1, max_size=8))
def test_spaces_equal_split_and_join(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.select(text.normalize_space(F.col("t")), "i").orderBy("i").collect()] == [" ".join(t.split()) for t in texts]


@pytest.mark.parametrize("on,end,expected", [("1904-12-30", "2024-01-31", date(2023, 12, 30)), ("1904-01-05", "2024-01-31", date(2024, 1, 5)), ("1904-02-29", "2023-03-31", None), ("2022-02-01", "2024-01-31", date(2022, 2, 1))])
def test_years_from_the_period(spark, on, end, expected):
    found = spark.range(1).select(dates.resolve_year(F.lit(on).cast("date"), F.lit(None).cast("date"), F.lit(end).cast("date")))
    assert found.first()[0] == expected
