"""Printed dates: ordered formats, locales, and choosing a column's format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import bound, normalize_space

# fixed values: the formats tried, in order; name, as Spark reads it
DAY_FIRST = (
    ("%d/%m/%Y", "d/M/yyyy"), ("%d-%m-%Y", "d-M-yyyy"), ("%d.%m.%Y", "d.M.yyyy"), ("%d/%m/%y", "d/M/yy"), ("%d-%m-%y", "d-M-yy"),
    ("%d %b %Y", "d MMM yyyy"), ("%d-%b-%Y", "d-MMM-yyyy"), ("%d %b %y", "d MMM yy"), ("%d-%b-%y", "d-MMM-yy"), ("%d %B %Y", "d MMMM yyyy"), ("%Y-%m-%d", "yyyy-M-d"),
)
MONTH_FIRST = (
    ("%m/%d/%Y", "M/d/yyyy"), ("%m/%d/%y", "M/d/yy"), ("%m-%d-%Y", "M-d-yyyy"), ("%b %d, %Y", "MMM d, yyyy"), ("%B %d, %Y", "MMMM d, yyyy"),
    ("%b %d %Y", "MMM d yyyy"), ("%b. %d, %Y", "MMM. d, yyyy"),
)
YEARLESS = (("%m/%d", "M/d"), ("%b %d", "MMM d"))
CANDIDATES = DAY_FIRST + MONTH_FIRST + YEARLESS
#: The year given to dates printed without one, until the statement's period is known.
NO_YEAR = 1904
_SPARK = dict(CANDIDATES)
_YEARLESS = frozenset(name for name, _ in YEARLESS)


def month_first(formats) -> bool:
    return any(f in {n for n, _ in MONTH_FIRST + YEARLESS} for f in formats)


def header_formats(table_formats) -> list[str]:
    """The table's own formats, then the others in the table's locale order."""
    order = MONTH_FIRST + YEARLESS + DAY_FIRST if month_first(table_formats) else CANDIDATES
    return [*table_formats, *[n for n, _ in order if n not in table_formats]]


def header_formats_of(formats: Column) -> Column:
    """``header_formats`` of an array column."""
    names = lambda pairs: F.array(*[F.lit(n) for n, _ in pairs])
    order = F.when(F.arrays_overlap(formats, names(MONTH_FIRST + YEARLESS)), names(MONTH_FIRST + YEARLESS + DAY_FIRST)).otherwise(names(CANDIDATES))
    return F.concat(formats, F.array_except(order, formats))


def _form(spark: str) -> str:
    """What a text of a format looks like; failing here is far cheaper than failing to parse."""
    for part, form in (("yyyy", "<4>"), ("yy", "<2>"), ("MMMM", "<w>"), ("MMM", "<3>"), ("M", "<n>"), ("d", "<n>")):
        spark = spark.replace(part, form)
    spark = spark.replace(".", r"\.")
    for form, regex in (("<4>", r"\d{4}"), ("<2>", r"\d{2}"), ("<w>", "[A-Za-z]{3,9}"), ("<3>", "[A-Za-z]{3}"), ("<n>", r"\d{1,2}")):
        spark = spark.replace(form, regex)
    return rf"\A{spark}\z"


def by_format(text: Column, name: str) -> Column:
    """A normalised text as a date in one format; two-digit years from 69 on are of the last century."""
    spark = _SPARK[name]
    text = F.when(text.rlike(_form(spark)), text)
    if name in _YEARLESS:
        return F.try_to_date(F.concat(text, F.lit(f" {NO_YEAR}")), f"{spark} yyyy")
    found = F.try_to_date(text, spark)
    if name.endswith("%y"):
        found = F.when(F.year(found) >= 2069, F.add_months(found, -1200)).otherwise(found)
    return found


def _any_form(names) -> str:
    """One pattern for all that any of the formats could read, so that other texts cost one look."""
    return "|".join(dict.fromkeys(_form(_SPARK[n]) for n in names))


def _by_own(clean: Column, formats: Column) -> Column:
    """A text by the formats that an array column names, in its order."""

    def one(name: Column) -> Column:
        out = None
        for known, _ in CANDIDATES:
            value = by_format(clean, known)
            out = F.when(name == known, value) if out is None else out.when(name == known, value)
        return out

    return F.get(F.filter(F.transform(formats, one), lambda x: x.isNotNull()), F.lit(0))


def parse_date(text: Column, formats=None) -> Column:
    """The first format that reads the text; null if none does. ``formats``: names, or an array column of names."""
    if isinstance(formats, Column):
        near = F.when(text.rlike(r"\d"), text)
        every = _any_form([n for n, _ in CANDIDATES])
        return bound(normalize_space(near), lambda clean: F.when(clean.rlike(every), _by_own(clean, formats)))
    names = list(formats or [n for n, _ in CANDIDATES])
    # a date is far shorter than most texts, which need not even be normalised
    near = F.when(text.rlike(r"\d"), text)
    return bound(normalize_space(near), lambda clean: F.when(clean.rlike(_any_form(names)), F.coalesce(*[by_format(clean, f) for f in names])))


def is_date(text: Column, formats=None) -> Column:
    return parse_date(text, formats).isNotNull()


# fixed value: how a date begins
STARTS = r"(?i)^\d{1,2}(?:$|[\s/.\-])|^\d{4}-\d{2}-\d{2}|^(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+\d{1,2}\b"


def looks_like_date(text: Column) -> Column:
    return normalize_space(text).rlike(STARTS)


def choose_format(samples: DataFrame) -> DataFrame:
    """(grp, n, text) to (grp, format): one that reads all of a group's texts, in order if possible.

    Every sample is read in every format by one projection; formats that do not
    read all of a group fall before rows are multiplied, the others are judged
    by windows, and the first that gives dates all rising or all falling wins,
    else the first that reads all.
    """
    clean = samples.select("grp", "n", normalize_space(F.col("text")).alias("clean"))
    read = clean.select("grp", "n", F.array(*[by_format(F.col("clean"), name) for name, _ in CANDIDATES]).alias("read"))
    mask = F.aggregate(F.transform("read", lambda x, k: F.when(x.isNotNull(), F.call_function("shiftleft", F.lit(1), k)).otherwise(0)), F.lit(0), lambda a, x: a.bitwiseOR(x))
    whole = F.bit_and("mask").over(Window.partitionBy("grp"))
    rows = read.withColumn("mask", mask).withColumn("whole", whole).filter("whole > 0")
    each = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(name).alias("format"), F.col("read")[k].alias("on"), (F.call_function("getbit", F.col("whole"), F.lit(k)) == 1).alias("good")) for k, (name, _) in enumerate(CANDIDATES)])
    rows = rows.select("grp", "n", F.inline(F.filter(each, lambda x: x["good"])))
    before = F.lag("on").over(Window.partitionBy("grp", "ord").orderBy("n"))
    rows = rows.withColumn("before", before)
    judged = rows.groupBy("grp", "ord", "format").agg(
        F.bool_and(F.col("on").isNotNull()).alias("whole"),
        F.coalesce(F.bool_and(F.col("before") <= F.col("on")), F.lit(True)).alias("up"),
        F.coalesce(F.bool_and(F.col("before") >= F.col("on")), F.lit(True)).alias("down"),
    )
    best = F.min_by("format", F.struct(~(F.col("up") | F.col("down")), F.col("ord")))
    return judged.filter("whole").groupBy("grp").agg(best.alias("format"))


def resolve_year(on: Column, start: Column, end: Column) -> Column:
    """A date of the placeholder year moved into the statement's period; null where it cannot be."""
    year = F.when(end.isNotNull(), F.year(end) - (F.month(on) > F.month(end)).cast("int")).otherwise(F.year(start))
    text = F.concat_ws("-", year.cast("string"), F.date_format(on, "MM-dd"))
    return F.when(F.year(on) != NO_YEAR, on).when(year.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))
