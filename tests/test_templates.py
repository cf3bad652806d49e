"""Template files: what loads, what does not and why, and what becomes of them when documents are read."""

import json

from tallyspark.operators import trial as Q
from tallyspark.sources import layouts as Y

WHOLE = {"format": 1, "bank_code": "b", "bank_name": "B", "layout_id": "l", "version": 2, "markers": ["Bank"], "table": {"columns": [{"role": "balance", "x0": 50, "x1": 90}, {"role": "ignore", "x0": 20, "x1": 50, "label": "serial"}, {"role": "txn_date", "x0": 1, "x1": 20}], "date_formats": ["%d/%m/%Y"]},
         "header_rules": [{"kind": "regex", "targets": ["header.ifsc"], "pattern": "x(.)", "pages": [1, -1]}, {"kind": "block", "targets": ["header.branch"], "pattern": "y"}, {"kind": "regex", "targets": ["header.extra.any"], "pattern": "z"}]}


def without(*keys):
    return {k: v for k, v in WHOLE.items() if k not in keys}


def test_files_with_problems_do_not_load(spark):
    table = WHOLE["table"]
    files = {
        "r/b/l/v2.json": WHOLE, "s/b/l/v2.json": WHOLE, "r/b/other/v2.json": WHOLE, "r/b/l/v1.json": "{", "r/b/l/v3.json": [1], "r/b/l/v4.json": without("bank_name", "markers") | {"version": 4}, "r/b/l/v5.json": WHOLE | {"version": 5, "format": 2},
        "r/b/l/v6.json": WHOLE | {"version": 6, "header_rules": [{"kind": "regex", "targets": ["header.nothing"]}]}, "r/b/l/v7.json": WHOLE | {"version": 7, "table": {"date_formats": []}}, "r/b/l/v8.json": WHOLE | {"version": 8, "status": "candidate", "table": table | {"columns": table["columns"][:2]}},
        "r/b/l/v9.json": WHOLE | {"version": 9, "status": "candidate"},
    }
    df = spark.createDataFrame([(p, f if isinstance(f, str) else json.dumps(f)) for p, f in files.items()], "path string, json string")
    parsed = Y.parse_templates(df)
    assert [r.path for r in Y.loaded(parsed).collect()] == ["r/b/l/v2.json"]
    assert sorted(r.path for r in Y.loaded(parsed, with_unapproved=True).collect()) == ["r/b/l/v2.json", "r/b/l/v9.json"]
    assert sorted((r.path, r.error) for r in Y.refused(parsed).collect()) == [
        ("r/b/l/v1.json", "not_an_object"), ("r/b/l/v3.json", "not_an_object"), ("r/b/l/v4.json", "missing_bank_name"), ("r/b/l/v4.json", "missing_markers"), ("r/b/l/v5.json", "unsupported_format"), ("r/b/l/v6.json", "unknown_target"),
        ("r/b/l/v7.json", "no_columns"), ("r/b/l/v8.json", "no_date_column"), ("r/b/other/v2.json", "path_mismatch"), ("s/b/l/v2.json", "duplicate"),
    ]


def test_a_loaded_template_is_a_layout_in_a_row(spark):
    df = spark.createDataFrame([("r/b/l/v2.json", json.dumps(WHOLE | {"template_id": "b/l/v2"}))], "path string, json string")
    row = Q.templates_of(Y.loaded(Y.parse_templates(df))).first()
    assert [(c.key, c.x0) for c in row.layout.columns] == [("txn_date", 1.0), ("serial", 20.0), ("balance", 50.0)]
    assert (row.layout.line_tolerance, row.layout.amount_mode, row.layout.empty_tokens, row.layout.header_on_every_page) == (3.0, "columns", ["", "-"], True)
    assert [(r.targets, r.pages, r.pattern) for r in row.rules] == [(["header.ifsc"], [1, -1], "x(.)"), (["header.extra.any"], [1], "z")]
