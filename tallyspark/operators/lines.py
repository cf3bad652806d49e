"""Words to lines, lines to columns and texts: a page is one array, never a window.

A word starts a new line when its top differs from the first word of the line
by more than the tolerance, so lines depend on the words before them; a fold
over the page's sorted words finds where lines start. Pages are independent and
small; documents of any length spread over tasks by (doc, page).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.dates import looks_like_date

TOLERANCE = 3.0
MARGIN = 2.0


def tenth(top: Column) -> Column:
    """One decimal as Python rounds it, for values of at most two decimals."""
    return F.call_function("format_number", top, F.lit("0.0")).cast("double")


def page_words(words: DataFrame, sort_top: Column | None = None) -> DataFrame:
    """(doc, page, ws): every page's words by (top, x0, seq)."""
    key = tenth(F.col("top")) if sort_top is None else sort_top
    word = F.struct(key.alias("key"), "x0", "seq", "text", "x1", "top", "bottom")
    return words.groupBy("doc", "page").agg(F.array_sort(F.collect_list(word)).alias("ws"))


def line_starts(ws: Column, tolerance) -> Column:
    """Places (from 0) of the words that start a line."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("at"), F.lit(0).alias("n"))

    def step(s: Column, w: Column) -> Column:
        new = s["anchor"].isNull() | (F.abs(w["top"] - s["anchor"]) > tolerance)
        return F.struct(
            F.when(new, w["top"].cast("double")).otherwise(s["anchor"]).alias("anchor"),
            F.when(new, F.array_append(s["at"], s["n"])).otherwise(s["at"]).alias("at"),
            (s["n"] + 1).alias("n"),
        )

    return F.aggregate(ws, start, step, lambda s: s["at"])


def group_lines(words: DataFrame, tolerance=TOLERANCE, sort_top: Column | None = None) -> DataFrame:
    """(doc, page, line_no, ws, top, bottom): lines of a page from above, words from the left."""
    return page_lines(page_words(words, sort_top), tolerance)


def page_lines(pages: DataFrame, tolerance, keep=()) -> DataFrame:
    """Pages of sorted words to lines; ``keep`` names columns of the page that its lines carry on."""
    pages = pages.withColumn("at", line_starts(F.col("ws"), tolerance))
    cut = F.transform(
        F.col("at"),
        lambda s, k: F.slice(F.col("ws"), s + 1, F.coalesce(F.try_element_at(F.col("at"), k + 2), F.size("ws")) - s),
    )
    lines = pages.select("doc", "page", *keep, F.posexplode(cut).alias("line_no", "ws"))
    ordered = F.array_sort(F.transform("ws", lambda w, k: F.struct(w["x0"].alias("x0"), k.alias("k"), w["seq"].alias("seq"), w["text"].alias("text"), w["x1"].alias("x1"), w["top"].alias("top"), w["bottom"].alias("bottom"))))
    lines = lines.withColumn("ws", ordered)
    return lines.withColumns({
        "top": F.array_min(F.transform("ws", lambda w: w["top"])),
        "bottom": F.array_max(F.transform("ws", lambda w: w["bottom"])),
        "text": F.array_join(F.transform("ws", lambda w: w["text"]), " "),
    })


def page_text(lines: DataFrame) -> DataFrame:
    """(doc, page, text): a page's lines, one under another."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy("doc", "page").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def assign_columns(lines: DataFrame, columns: list[tuple], margin=MARGIN) -> DataFrame:
    """``lines`` with fits and cells (role to words): each word in the first column that holds its middle.

    ``columns`` are (role, x0, x1). A line fits only if no word leaves the grid,
    misses every column or reaches far into a neighbour. The grid is a handful
    of literals, so the range join is an expression over the line's own array.
    """
    columns = sorted(columns, key=lambda c: c[1])
    left, right = columns[0][1] - margin, columns[-1][2] + margin

    def place(w: Column) -> Column:
        mid = (w["x0"] + w["x1"]) / 2
        out = None
        for k, (_, x0, x1) in enumerate(columns):
            inside = (mid >= x0) & (mid < x1)
            value = F.when((w["x0"] >= x0 - 3 * margin) & (w["x1"] <= x1 + 3 * margin), F.lit(k))
            out = F.when(inside, value) if out is None else out.when(inside, value)
        return F.when((w["x0"] >= left) & (w["x1"] <= right), out)

    placed = F.transform("ws", lambda w: F.struct(place(w).alias("c"), w["text"].alias("text")))
    rows = lines.withColumn("__placed", placed)
    fits = F.forall("__placed", lambda p: p["c"].isNotNull())

    def cell(k: int, role: str) -> Column:
        own = F.filter("__placed", lambda p: p["c"] == k)
        return F.struct(F.lit(role).alias("role"), F.transform(own, lambda p: p["text"]).alias("words"))

    cells = [cell(k, c[0]) for k, c in enumerate(columns)]
    kept = F.filter(F.array(*cells), lambda c: F.size(c["words"]) > 0)
    return rows.withColumns({"fits": fits, "cells": F.when(fits, kept)}).drop("__placed")


def assign_own_columns(lines: DataFrame, columns: Column, margin=MARGIN) -> DataFrame:
    """``assign_columns`` by the grid that stands in the row: an array of (key, x0, x1), sorted by x0."""
    at = lambda k: F.element_at(columns, k)
    left, right = at(F.lit(1))["x0"] - margin, at(F.lit(-1))["x1"] + margin

    def place(w: Column) -> Column:
        mid = (w["x0"] + w["x1"]) / 2
        first = F.get(F.filter(F.sequence(F.lit(1), F.size(columns)), lambda k: (mid >= at(k)["x0"]) & (mid < at(k)["x1"])), F.lit(0))
        good = (w["x0"] >= left) & (w["x1"] <= right) & (w["x0"] >= at(first)["x0"] - 3 * margin) & (w["x1"] <= at(first)["x1"] + 3 * margin)
        return F.when(first.isNotNull() & good, first)

    rows = lines.withColumn("__placed", F.transform("ws", lambda w: F.struct(place(w).alias("c"), w["text"].alias("text"))))
    own = lambda k: F.transform(F.filter("__placed", lambda p: p["c"] == k), lambda p: p["text"])
    cells = F.transform(F.sequence(F.lit(1), F.size(columns)), lambda k: F.struct(at(k)["key"].alias("role"), own(k).alias("words")))
    fits = F.forall("__placed", lambda p: p["c"].isNotNull())
    return rows.withColumns({"fits": fits, "cells": F.when(fits, F.filter(cells, lambda c: F.size(c["words"]) > 0))}).drop("__placed")


def is_header_line(ws: Column, tokens, least) -> Column:
    """Whether all words of a line are header tokens (a list, or an array column), and there are enough of them."""
    if not isinstance(tokens, Column):
        if not tokens:
            return F.lit(False)
        tokens = F.array(*[F.lit(t) for t in tokens])
    return (F.size(tokens) > 0) & (F.size(ws) >= least) & F.forall(ws, lambda w: F.array_contains(tokens, w["text"]))


def starts_row(ws: Column, x0, x1, margin=MARGIN) -> Column:
    """True if the words in the date column read like the start of a date."""
    inside = F.filter(ws, lambda w: ((w["x0"] + w["x1"]) / 2 >= x0 - margin) & ((w["x0"] + w["x1"]) / 2 < x1 + margin))
    text = F.array_join(F.transform(inside, lambda w: w["text"]), " ")
    return (F.size(inside) > 0) & looks_like_date(text)


def classify_pages(pages: DataFrame, words: DataFrame, least: int = 20) -> DataFrame:
    """(doc, kind, n_pages, scanned): TEXT, MIXED, SCANNED or EMPTY by the characters on each page."""
    chars = words.groupBy("doc", "page").agg(F.sum(F.length("text")).alias("chars"))
    each = pages.join(chars, ["doc", "page"], "left").withColumn("poor", F.coalesce("chars", F.lit(0)) < least)
    out = each.groupBy("doc").agg(
        F.count("page").alias("n_pages"), F.count_if("poor").alias("n_poor"), F.array_sort(F.collect_list(F.when(F.col("poor"), F.col("page")))).alias("scanned")
    )
    kind = F.when(F.col("n_pages") == 0, "EMPTY").when(F.col("n_poor") == 0, "TEXT").when(F.col("n_poor") == F.col("n_pages"), "SCANNED").otherwise("MIXED")
    return out.select("doc", kind.alias("kind"), "n_pages", "scanned")
