"""Expressions over strings and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space, the non-breaking kinds and the ASCII separators included.
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def among(value: Column, members) -> Column:
    """Whether ``value`` is one of ``members``: literals, or an array column."""
    if isinstance(members, Column):
        return F.array_contains(members, value)
    return value.isin(*members) if members else F.lit(False)


def normalize_space(text: Column) -> Column:
    """Single blanks between words, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " "))


def shape(value: Column) -> Column:
    """Letters become A or a and digits 9; everything else stays; null becomes the word null."""
    masked = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[A-Z]", "A"), "[a-z]", "a"), r"(?U)\d", "9")
    return F.coalesce(masked, F.lit("null"))


def normalise_heading(text: Column, most_words: int = 5) -> Column:
    """The distinct words of a column heading in order; empty if it has a digit or too many words."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9/.]+", " ")
    words = F.filter(F.transform(F.split(clean, " "), lambda w: F.regexp_replace(w, r"^\.+|\.+$", "")), lambda w: w != "")
    words = F.array_distinct(words)
    bad = F.exists(words, lambda w: w.rlike("[0-9]")) | (F.size(words) > most_words)
    return F.when(bad, "").otherwise(F.array_join(words, " "))


def safe_label(label: Column, place: Column) -> Column:
    """A name fit for a key, at most 40 characters; ``column_<place>`` if nothing is left."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 40)
    return F.when(slug != "", slug).otherwise(F.concat(F.lit("column_"), place.cast("string")))


def item_kind(item: Column) -> Column:
    """An item id with every numbered segment made general: ``row:12:x`` is ``row:*:x``."""
    return F.regexp_replace(item, r":\d+(?=:|$)", ":*")


def layout_of(template: Column) -> Column:
    """A template id without its last segment, if it has three or more."""
    return F.when(F.size(F.split(template, "/")) >= 3, F.regexp_replace(template, "/[^/]*$", "")).otherwise(template)


def field_name(key: Column) -> Column:
    """What follows the first dot, underscores as blanks."""
    rest = F.when(F.instr(key, ".") > 0, F.regexp_replace(key, r"^[^.]*\.", "")).otherwise(key)
    return F.replace(rest, F.lit("_"), F.lit(" "))


def half_even(value: Column) -> Column:
    return F.bround(value, 0).cast("long")


def layout_fingerprint(bank: Column, markers: Column, columns: Column) -> Column:
    """Eight hex digits over the bank, its sorted markers and its columns (role, x0, x1)."""
    spans = F.transform(columns, lambda c: F.concat(c["role"], F.lit(":"), half_even(c["x0"]).cast("string"), F.lit("-"), half_even(c["x1"]).cast("string")))
    return F.substring(F.sha2(F.array_join(F.concat(F.array(bank), F.array_sort(markers), spans), "|").cast("binary"), 256), 1, 8)


def phrase_regex(phrase: str) -> str:
    """A whole phrase, in any case and with any white space, not inside a longer word."""
    import re

    body = r"\s+".join(re.escape(w) for w in phrase.split())
    return rf"(?iU)(?<![\w]){body}(?![\w])"


def phrase_pattern(phrase: Column) -> Column:
    """``phrase_regex`` of a column."""
    words = F.filter(F.split(phrase, SPACE + "+"), lambda w: w != "")
    quoted = F.transform(words, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.concat(F.lit(r"(?iU)(?<![\w])"), F.array_join(quoted, r"\s+"), F.lit(r"(?![\w])"))


def has_phrase(text: Column, phrase: str) -> Column:
    return F.coalesce(text.rlike(phrase_regex(phrase)), F.lit(False))


def all_markers(text: Column, markers: list[str]) -> Column:
    """True if there are markers and all of them stand in the text."""
    if not markers:
        return F.lit(False)
    found = has_phrase(text, markers[0])
    for m in markers[1:]:
        found = found & has_phrase(text, m)
    return found


def resolve_pages(pages: Column, count: Column) -> Column:
    """Page numbers with those counted from the end made plain, in range, without repeats."""
    plain = F.transform(pages, lambda p: F.when(p > 0, p).otherwise(count + 1 + p))
    return F.array_distinct(F.filter(plain, lambda p: (p >= 1) & (p <= count)))


# fixed values: the first four letters of an IFSC, the bank's code and its name, in this order
BANKS = (
    ("SBIN", "sbi", "State Bank of India"),
    ("HDFC", "hdfc", "HDFC Bank"),
    ("ICIC", "icici", "ICICI Bank"),
    ("UTIB", "axis", "Axis Bank"),
    ("PUNB", "pnb", "Punjab National Bank"),
    ("KKBK", "kotak", "Kotak Mahindra Bank"),
    ("BARB", "bob", "Bank of Baroda"),
    ("CNRB", "canara", "Canara Bank"),
    ("UBIN", "union", "Union Bank of India"),
    ("IDIB", "indianbank", "Indian Bank"),
    ("YESB", "yes", "Yes Bank"),
    ("IDFB", "idfcfirst", "IDFC FIRST Bank"),
    ("INDB", "indusind", "IndusInd Bank"),
    ("BKID", "boi", "Bank of India"),
)


def identify_bank(ifsc: Column, text: Column) -> Column:
    """struct(code, name): by the IFSC's bank letters, else by the first bank named, else unknown."""
    bank = lambda code, name: F.struct(F.lit(code).alias("code"), F.lit(name).alias("name"))
    out = None
    for letters, code, name in BANKS:
        when = F.substring(ifsc, 1, 4) == letters
        out = F.when(when, bank(code, name)) if out is None else out.when(when, bank(code, name))
    for _, code, name in BANKS:
        out = out.when(text.rlike(rf"(?iU)(?<![\w-])\Q{name}\E(?![\w-])"), bank(code, name))
    return out.otherwise(bank("unknown", None))
