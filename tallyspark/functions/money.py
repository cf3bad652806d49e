"""Printed amounts as exact decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.text import SPACE, among, bound, normalize_space

# fixed values: marks of currency, of sign, and the form of a number
CURRENCY = r"(?i)(?:₹|Rs\.?|INR|USD|US\$|\$)"
SUFFIX = r"\s*(CR|DR|Cr|Dr|cr|dr)\.?$"
NUMBER = r"^\(?-?[\d,]*\d(?:\.\d+)?\)?$"
EMPTY = ("", "-")
#: A number without marks, and the characters that a number with marks can have.
PLAIN = r"^-?[\d,]*\d(?:\.\d+)?$"
MARKED = r"(?i)^[-\d,.()\s₹$RSINUDC]*$"
EXACT = "decimal(38,6)"


def parse_amount(text: Column, empty=EMPTY) -> Column:
    """struct(ok, value, suffix): ok is false where the text is no amount; empty tokens give no value.

    The suffix says CR or DR and does not change the sign; parentheses and a
    trailing minus do. Commas may stand anywhere among the digits.
    """
    none, unmarked = F.lit(None).cast("string"), F.lit(None).cast(EXACT)
    told = lambda ok, value, suffix: F.struct(ok.alias("ok"), value.alias("value"), suffix.alias("suffix"))

    def read(raw: Column) -> Column:
        blank = among(raw, empty)
        stripped = among(_unmarked(raw), empty)
        marked = bound(_unmarked(raw), lambda clean: bound(_parts(clean), lambda parts: _amount(raw, clean, parts, empty)))
        # most texts are plain numbers or no numbers at all, and need none of the marks looked for
        return (
            F.when(blank, told(F.lit(True), unmarked, none))
            .when(raw.rlike(PLAIN), bound(F.replace(raw, F.lit(","), F.lit("")).try_cast(EXACT), lambda v: told(v.isNotNull(), v, none)))
            .when(~raw.rlike(r"\d"), told(stripped, unmarked, none))
            .when(raw.rlike(MARKED), marked)
            .otherwise(told(F.lit(False), unmarked, none))
        )

    return bound(normalize_space(text), read)


def _unmarked(raw: Column) -> Column:
    """Without marks of currency, and what they had pushed apart closed up."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(raw, CURRENCY, " "), SPACE + "+", " "))
    for apart, joined in (("- ", "-"), ("( ", "("), (" )", ")")):
        bare = F.replace(bare, F.lit(apart), F.lit(joined))
    return F.when(raw.rlike(CURRENCY), bare).otherwise(raw)


def _parts(clean: Column) -> Column:
    """struct(minus, suffix, number): a trailing minus, a CR or DR, and what is left."""
    minus = clean.rlike(r"\d-$")
    return bound(
        F.when(minus, F.regexp_replace(clean, "-$", "")).otherwise(clean),
        lambda rest: F.struct(minus.alias("minus"), F.nullif(F.upper(F.regexp_extract(rest, SUFFIX, 1)), F.lit("")).alias("suffix"), F.when(rest.rlike(SUFFIX), F.trim(F.regexp_replace(rest, SUFFIX, ""))).otherwise(rest).alias("number")),
    )


def _amount(raw: Column, clean: Column, parts: Column, empty) -> Column:
    number = parts["number"]
    nothing = among(raw, empty) | among(clean, empty)
    good = number.rlike(NUMBER)
    plain = F.replace(F.regexp_replace(number, r"^[()]+|[()]+$", ""), F.lit(","), F.lit("")).try_cast(EXACT)
    flipped = (number.startswith("(") & number.endswith(")")) | parts["minus"]

    def result(value: Column) -> Column:
        ok = nothing | F.coalesce(good & value.isNotNull(), F.lit(False))
        real = ~nothing & ok
        return F.struct(ok.alias("ok"), F.when(real, F.when(flipped, -value).otherwise(value)).alias("value"), F.when(real, parts["suffix"]).alias("suffix"))

    return bound(plain, result)


def is_amount(text: Column) -> Column:
    return parse_amount(text, ())["value"].isNotNull()


def to_cents(value: Column) -> Column:
    return F.round(value * 100).cast("long")
