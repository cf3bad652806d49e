"""Printed tables with known truth, read back by the row reader."""

import random

import pytest

from tallyspark.operators import headers as H
from tallyspark.operators import lines as L
from tallyspark.operators import rows as R

WORDS = "doc long, page int, seq int, text string, x0 double, x1 double, top double, bottom double"
SPEC = R.TableSpec(
    columns=(("txn_date", 30.0, 100.0), ("description", 100.0, 300.0), ("amount", 300.0, 400.0), ("balance", 400.0, 500.0)),
    date_formats=("%d %b %Y", "%d/%m/%Y"), header_tokens=("Date", "Details", "Amount", "Balance"), amount_mode="signed",
)


class Page:
    def __init__(self, doc=1, page=1):
        self.rows, self.doc, self.page = [], doc, page

    def line(self, top, *words, height=9.0):
        for text, x0 in words:
            self.rows.append((self.doc, self.page, len(self.rows), text, float(x0), float(x0 + 5 * len(text)), float(top), float(top + height)))
        return self

    def head(self, top=50):
        return self.line(top, ("Date", 32), ("Details", 110), ("Amount", 310), ("Balance", 410))

    def row(self, top, day, text, amount, balance):
        return self.line(top, (day, 32), (text, 110), (amount, 310), (balance, 410))


def read(spark, *pages, spec=SPEC):
    lines = L.group_lines(spark.createDataFrame([r for p in pages for r in p.rows], WORDS))
    return lines, R.assemble_rows(lines, spec)


def cells(rows):
    return [(r.row, r.page, r.cells.get("txn_date"), r.cells.get("description"), r.cells.get("amount")) for r in rows.orderBy("row").collect()]


def test_rows_go_on_over_lines_and_pages(spark):
    one = Page().line(20, ("letterhead", 200)).head().row(80, "01/02/2024", "first", "-5.00", "95.00").line(95, ("more", 110)).row(120, "02/02/2024", "second", "7.00", "102.00")
    two = Page(page=2).head().line(70, ("tail", 110)).row(90, "03/02/2024", "third", "1.00", "103.00").line(200, ("footer", 2))
    _, rows = read(spark, one, two)
    assert cells(rows) == [(0, 1, "01/02/2024", "first more", "-5.00"), (1, 1, "02/02/2024", "second tail", "7.00"), (2, 2, "03/02/2024", "third", "1.00")]
    t = R.transactions(rows, SPEC).orderBy("row_index").collect()
    assert [(float(r.debit or 0), float(r.credit or 0)) for r in t] == [(5.0, 0.0), (0.0, 7.0), (0.0, 1.0)]


def test_lead_lines_belong_to_the_row_below(spark):
    page = Page().head().row(80, "01/02/2024", "a", "1.00", "1.00").line(110, ("lead", 110)).row(118, "02/02/2024", "b", "1.00", "2.00")
    assert [c[3] for c in cells(read(spark, page)[1])] == ["a", "lead b"]


def test_a_wrapped_date_is_put_together(spark):
    page = Page().head().line(80, ("01", 32), ("Feb", 45), ("x", 110), ("1.00", 310)).line(92, ("2024", 32), ("y", 110)).row(120, "02/02/2024", "z", "1.00", "2.00")
    assert cells(read(spark, page)[1]) == [(0, 1, "01 Feb 2024", "x y", "1.00"), (1, 1, "02/02/2024", "z", "1.00")]


def test_text_after_the_table_ends_the_page_and_is_noted(spark):
    page = Page().head().row(80, "01/02/2024", "a", "1.00", "1.00").line(100, ("stray", 2)).row(120, "02/02/2024", "b", "1.00", "2.00")
    lines, rows = read(spark, page)
    assert len(cells(rows)) == 1
    assert [(r.reason, r.rows_after, r.near_row) for r in R.skipped_text(lines, SPEC).collect()] == [("early_end", 1, 0)]


def test_no_heading_no_rows(spark):
    assert cells(read(spark, Page().row(80, "01/02/2024", "a", "1.00", "1.00"))[1]) == []


def test_bad_values_are_problems(spark):
    # a line after an unreadable date would be taken for its second half, so it comes last
    page = Page().head().row(80, "01/02/2024", "b", "x", "2.00DR").row(100, "31/02/2024", "a", "1.00", "1.00")
    _, rows = read(spark, page)
    assert sorted((r.row, r.code) for r in R.problems(rows, SPEC).collect()) == [(0, "unparseable_amount"), (1, "unparseable_date")]
    (t,) = R.transactions(rows, SPEC).collect()
    assert (t.row_index, t.row, float(t.balance)) == (0, 0, -2.0)


def test_lines_are_anchored_at_their_first_word(spark):
    rng = random.Random(5)
    rows = [(d, 1, k, "w", float(rng.randrange(0, 500)), 510.0, rng.randrange(0, 4000) / 100, 50.0) for d in range(40) for k in range(30)]
    found = {}
    for r in L.group_lines(spark.createDataFrame(rows, WORDS)).select("doc", "line_no", "ws").collect():
        for w in r.ws:
            found[r.doc, w.seq] = r.line_no
    for d in range(40):
        own = sorted((r for r in rows if r[0] == d), key=lambda r: (round(r[6], 1), r[4], r[2]))
        anchor, line = None, -1
        for r in own:
            if anchor is None or abs(r[6] - anchor) > 3.0:
                anchor, line = r[6], line + 1
            assert found[d, r[2]] == line


def test_block_values(spark):
    page = Page().line(10, ("Name:", 10), ("ACME", 60), ("Ltd", 85), ("Phone:", 200)).line(21, ("Holdings,", 60)).line(60, ("far", 60))
    lines = L.group_lines(spark.createDataFrame(page.rows, WORDS))
    assert [r.value for r in H.block_values(lines, r"\bName\s*:").collect()] == ["ACME Ltd Holdings"]


@pytest.mark.parametrize("mode,text,debit,credit", [("dr_cr", "5.00 CR", None, 5.0), ("dr_cr", "5.00Dr", 5.0, None), ("signed", "-5.00", 5.0, None)])
def test_amount_modes(spark, mode, text, debit, credit):
    from dataclasses import replace

    page = Page().head().row(80, "01/02/2024", "a", text, "1.00")
    spec = replace(SPEC, amount_mode=mode)
    (t,) = R.transactions(read(spark, page, spec=spec)[1], spec).collect()
    assert ((float(t.debit) if t.debit is not None else None), (float(t.credit) if t.credit is not None else None)) == (debit, credit)
