"""Recorded layouts: JSON files of positioned words, and the template registry's files.

A layout is ``{format: 1, layout|source, note?, pages: [{number, width, height,
words: [[text, x0, x1, top, bottom], ...]}]}``. The word rows mix strings and
numbers, so they are read as strings and cast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.text import SPACE
from tallyspark.sources.codec import HEADER, SUMMARY

LAYOUT = "format int, layout string, source string, note string, pages array<struct<number:int,width:double,height:double,words:array<array<string>>>>"
TEMPLATE = (
    "format int, template_id string, bank_code string, bank_name string, layout_id string, version int, status string, strategy string, markers array<string>, "
    "table struct<columns:array<struct<role:string,x0:double,x1:double,label:string>>,amount_mode:string,date_formats:array<string>,header_tokens:array<string>,min_header_tokens:int,header_on_every_page:boolean,"
    "empty_tokens:array<string>,line_tolerance:double>, "
    "header_rules array<struct<kind:string,targets:array<string>,pages:array<int>,pattern:string,flags:string,after:string,before:string,x_min:double,x_max:double,lines:array<int>,strip:string,join:string,date_formats:array<string>>>, "
    "required_checks array<string>, provenance map<string,string>, regression map<string,string>"
)
FORMAT = 1
REQUIRED = ("bank_code", "bank_name", "layout_id", "version", "markers", "table")
TARGETS = tuple(f"header.{k}" for k in HEADER if k != "extra") + tuple(f"summary.{k}" for k in SUMMARY)
# fixed values: what a template may say
ROLES = ("txn_date", "value_date", "description", "reference", "debit", "credit", "amount", "dr_cr", "balance", "ignore")
KINDS, STATUSES, MODES, STRATEGIES = ("regex", "region", "block"), ("approved", "candidate", "rejected"), ("columns", "signed", "dr_cr"), ("word_columns",)


def words_of(layouts: DataFrame) -> DataFrame:
    """(doc, page, seq, text, x0, x1, top, bottom) of parsed layouts (doc, format, pages)."""
    pages = layouts.filter("format = 1").select("doc", F.explode("pages").alias("p"))
    words = pages.select("doc", F.col("p.number").alias("page"), F.posexplode("p.words").alias("seq", "w"))
    number = lambda k: F.col("w")[k].cast("double")
    return words.select("doc", "page", "seq", F.col("w")[0].alias("text"), number(1).alias("x0"), number(2).alias("x1"), number(3).alias("top"), number(4).alias("bottom"))


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """All layout files under a path, one document each, named by file."""
    raw = spark.read.schema(LAYOUT).option("multiLine", True).json(path)
    return words_of(raw.select(F.input_file_name().alias("doc"), "format", "pages"))


def layouts_json(words: DataFrame, width: float, height: float, digits: int = 2) -> DataFrame:
    """(doc, json): layouts as they are recorded, coordinates rounded."""
    rounded = lambda c: F.round(F.col(c).cast("double"), digits).cast("string")
    word = F.array("text", *[rounded(c) for c in ("x0", "x1", "top", "bottom")])
    pages = words.groupBy("doc", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", word.alias("w")))), lambda r: r["w"]).alias("words"))
    page = F.struct(F.col("page").alias("number"), F.lit(width).alias("width"), F.lit(height).alias("height"), "words")
    docs = pages.groupBy("doc").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    return docs.select("doc", F.to_json(F.struct(F.lit(1).alias("format"), F.lit("recorded").alias("layout"), "pages")).alias("json"))


def parse_layouts(texts: DataFrame) -> DataFrame:
    """(doc, json) to words; a text that is no layout gives none."""
    parsed = texts.select("doc", F.from_json("json", LAYOUT).alias("l"))
    return words_of(parsed.select("doc", "l.format", "l.pages"))


def template_problems(templates: DataFrame) -> DataFrame:
    """(template_id, problem): every rule of the template schema that a file breaks.

    A missing status is approved, a missing amount mode is columns and a missing
    strategy is word_columns; none of them is a problem.
    """
    known = lambda values, column: F.array_except(column, F.array(*[F.lit(v) for v in values]))
    columns = F.col("table.columns")
    roles = F.transform(columns, lambda c: c["role"])
    checks = [
        ("bad_version", F.coalesce(F.col("version"), F.lit(0)) < 1),
        ("unknown_status", ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(True))),
        ("no_columns", F.coalesce(F.size(columns), F.lit(0)) < 1),
        ("unknown_role", F.size(known(ROLES, roles)) > 0),
        ("empty_column", F.exists(columns, lambda c: ~F.coalesce(c["x0"] < c["x1"], F.lit(False)))),
        ("no_date_column", ~F.array_contains(roles, "txn_date")),
        ("unknown_mode", ~F.coalesce(F.col("table.amount_mode").isin(*MODES), F.lit(True))),
        ("unknown_strategy", ~F.coalesce(F.col("strategy").isin(*STRATEGIES), F.lit(True))),
        ("no_date_formats", F.col("table.date_formats").isNull()),
        ("unknown_rule", F.exists("header_rules", lambda r: ~F.coalesce(r["kind"].isin(*KINDS), F.lit(False)))),
        ("rule_without_target", F.exists("header_rules", lambda r: F.coalesce(F.size(r["targets"]), F.lit(0)) < 1)),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(code)) for code, when in checks]))
    return templates.select("template_id", F.explode(found).alias("problem"))


def registry(files: DataFrame, with_unapproved: bool = False) -> DataFrame:
    """(path, template columns) to the templates that load: identity equal to the path, the first of duplicates, newest first."""
    from pyspark.sql import Window

    own = F.concat_ws("/", "bank_code", "layout_id", F.concat(F.lit("v"), F.col("version").cast("string")))
    rows = files.filter(F.regexp_extract("path", r"([^/]+/[^/]+/v\d+)\.json$", 1) == own)
    nth = F.row_number().over(Window.partitionBy("bank_code", "layout_id", "version").orderBy("path"))
    rows = rows.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")
    return rows if with_unapproved else rows.filter("coalesce(status, 'approved') = 'approved'")


def load_errors(files: DataFrame) -> DataFrame:
    """(path, error) of the files that do not load."""
    good = registry(files, with_unapproved=True).select("path")
    own = F.concat_ws("/", "bank_code", "layout_id", F.concat(F.lit("v"), F.col("version").cast("string")))
    moved = F.regexp_extract("path", r"([^/]+/[^/]+/v\d+)\.json$", 1) != own
    return files.join(good, "path", "left_anti").select("path", F.when(moved, "path_mismatch").otherwise("duplicate").alias("error"))


def parse_templates(files: DataFrame) -> DataFrame:
    """(path, json) to path, the template's columns and its problems; a text that is no object has the one that says so.

    What a file leaves out is set as when it is read by hand: approved, words in
    columns, header on every page, dashes and blanks as empty amounts, header
    rules for page 1 and, where no check is named, the balance chain.
    """
    rows = files.select("path", "json", F.from_json("json", TEMPLATE).alias("t")).select("path", "json", "t.*")
    known = F.array(*[F.lit(t) for t in TARGETS])
    strange = F.exists(F.flatten(F.coalesce(F.transform("header_rules", lambda r: F.coalesce(r["targets"], F.array().cast("array<string>"))), F.array().cast("array<array<string>>"))), lambda t: ~F.array_contains(known, t) & ~t.startswith("header.extra."))
    good = F.try_variant_get(F.try_parse_json("json"), "$", "map<string,variant>").isNotNull()
    first = F.when(~good, F.array(F.lit("not_an_object"))).otherwise(F.array_compact(F.array(
        F.when(~F.coalesce(F.col("format") == FORMAT, F.lit(False)), F.lit("unsupported_format")),
        *[F.when(F.col(k).isNull(), F.lit(f"missing_{k}")) for k in REQUIRED], F.when(strange, F.lit("unknown_target")),
    )))
    found = template_problems(rows.withColumn("template_id", F.col("path"))).groupBy("template_id").agg(F.array_sort(F.collect_set("problem")).alias("more")).withColumnRenamed("template_id", "path")
    rows = rows.withColumn("first", first).join(found, "path", "left")
    problems = F.when(F.array_contains("first", "not_an_object"), F.col("first")).otherwise(F.concat("first", F.coalesce("more", F.array().cast("array<string>"))))
    rule = F.transform("header_rules", lambda r: r.withField("pages", F.coalesce(r["pages"], F.array(F.lit(1)))).withField("date_formats", F.coalesce(r["date_formats"], F.array().cast("array<string>"))))
    rows = rows.withColumns({"problems": problems, "status": F.coalesce("status", F.lit("approved")), "strategy": F.coalesce("strategy", F.lit("word_columns")), "header_rules": rule, "required_checks": F.coalesce("required_checks", F.array(F.lit("balance_chain")))})
    return rows.drop("first", "more", "json")


def loaded(templates: DataFrame, with_unapproved: bool = False) -> DataFrame:
    """Parsed templates that load: without a problem, standing where they say, the first of duplicates."""
    return registry(templates.filter(F.size("problems") == 0), with_unapproved).drop("problems")


def refused(templates: DataFrame) -> DataFrame:
    """(path, error) of the files that do not load: each problem of its own, a wrong place or a duplicate."""
    wrong = templates.filter(F.size("problems") > 0).select("path", F.explode("problems").alias("error"))
    return wrong.unionByName(load_errors(templates.filter(F.size("problems") == 0)))


def first_password(texts: DataFrame) -> DataFrame:
    """(doc, content) to the first line that is not blank; for use, never to be stored."""
    lines = F.filter(F.split("content", r"\r?\n"), lambda line: F.regexp_replace(line, SPACE, "") != "")
    return texts.select("doc", F.try_element_at(lines, F.lit(1)).alias("password"), F.size(lines).alias("n_candidates"))


def chars_to_words(chars: DataFrame) -> DataFrame:
    """(doc, page, seq, ch, x0, x1, top, bottom) to words.

    A word ends at white space, where x moves back by more than half the
    height, where the baseline shifts by more than half of it, and after the
    soft break mark, which becomes a hyphen. Boxes grow with their word, so a
    page's characters are folded in order.
    """
    mark = chr(0xFFFE)
    ch = F.struct("seq", "ch", "x0", "x1", "top", "bottom")
    pages = chars.groupBy("doc", "page").agg(F.array_sort(F.collect_list(ch)).alias("cs"))
    box = "struct<text:string,x0:double,x1:double,top:double,bottom:double>"
    start = F.struct(F.array().cast(f"array<{box}>").alias("done"), F.lit(None).cast(box).alias("now"))

    def step(s, c):
        blank = c["ch"].rlike(r"^\s$")
        soft = c["ch"] == mark
        now = s["now"]
        half = (now["bottom"] - now["top"]) / 2
        apart = now.isNotNull() & ((c["x0"] < now["x1"] - half) | (F.abs(c["bottom"] - now["bottom"]) > half))
        letter = F.when(soft, "-").otherwise(c["ch"])
        fresh = F.struct(letter.alias("text"), c["x0"].alias("x0"), c["x1"].alias("x1"), c["top"].alias("top"), c["bottom"].alias("bottom")).cast(box)
        grown = F.struct(
            F.concat(now["text"], letter).alias("text"), F.least(now["x0"], c["x0"]).alias("x0"), F.greatest(now["x1"], c["x1"]).alias("x1"),
            F.least(now["top"], c["top"]).alias("top"), F.greatest(now["bottom"], c["bottom"]).alias("bottom"),
        ).cast(box)
        word = F.when(now.isNull() | apart, fresh).otherwise(grown)
        none = F.lit(None).cast(box)
        done = F.when(now.isNotNull() & (blank | apart), F.array_append(s["done"], now)).otherwise(s["done"])
        done = F.when(~blank & soft, F.array_append(done, word)).otherwise(done)
        return F.struct(done.alias("done"), F.when(blank | soft, none).otherwise(word).alias("now"))

    words = F.aggregate("cs", start, step, lambda s: F.when(s["now"].isNotNull(), F.array_append(s["done"], s["now"])).otherwise(s["done"]))
    return pages.select("doc", "page", F.posexplode(words).alias("seq", "w")).select("doc", "page", "seq", "w.*")
