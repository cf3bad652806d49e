import random
import re
from functools import lru_cache

from tallyspark.llm import licenses as L
from tests.llm.cases import ROWS, documents, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@lru_cache(1)
def compiled():
    return [r | {"p": re.compile(r["p"])} for r in L.rules()]


def brute(text):
    """All rules at all words, then suppression by comparing all pairs."""
    words = WORD.findall((text or "").translate(LOWER))
    found = []
    for i in range(len(words)):
        rest = " ".join(words[i:])
        for r in compiled():
            if m := r["p"].match(rest):
                found.append((i, i + len(m[0].split(" ")), r))

    def inside(a, b):
        (s, e, r), (t, f, q) = a, b
        if not (t <= s and f >= e) or q["prio"] > r["prio"] or a is b:
            return False
        return q["prio"] < r["prio"] or f - t > e - s or ((s, e) == (t, f) and q["n"] < r["n"])

    kept = [a for a in found if a[2]["base"] or not any(inside(a, b) for b in found)]
    return len(words), sorted((s, e, r["n"]) for s, e, r in kept)


def check(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    for r in L.scan_licenses(df).collect():
        assert (r.n_words, sorted((d.s, d.e, d.n) for d in r.detections)) == brute(texts[r.doc_id]), texts[r.doc_id]


def test_against_brute_force(spark):
    rng = random.Random(3)
    parts = ["released under the mit license", "GNU General Public License, version 3", "Apache License, Version 2.0", "CC BY-NC 4.0", "cc by nc sa 4 0", "all rights reserved", "SPDX-License-Identifier: GPL-2.0-only", "the", "licensed under", "BSD 3-Clause", "mit", "Creative Commons Attribution ShareAlike 4.0 International License", "under the terms of the", "permission is hereby granted, free of charge, to any person obtaining a copy"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(60)] + [None, "", "mit", "license", "under the mit license " * 40]
    check(spark, texts)


def test_no_rule_is_cut_by_the_window(spark):
    notice = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software"
    texts = [notice.format(" ".join(["the", "copyright", "holder", "or", "of", "its", "owners", "x", "y"][:n])) for n in range(1, 10)]
    texts += ["licensed under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3.0 of the license", "x " * 30 + notice.format("the copyright holder") + " released under the mit license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in L.summarised(L.scan_licenses(df)).collect()}
    for i, text in enumerate(texts):
        assert sorted((d.s, d.e, d.n) for d in rows[i].detections) == brute(text)[1], text
    assert ["bsd-3-clause" in rows[i].labels for i in range(9)] == [True] * 8 + [False]


def forms(p, at=0):
    """All texts that a rule's pattern stands for, with one or two x for any words, and where its group ends."""
    out, here = [], [""]
    while at < len(p) and p[at] != ")":
        last = None
        if p[at] == "|":
            out, here, at = out + here, [""], at + 1
            continue
        if p.startswith(("(?!", "(?="), at):
            at = forms(p, at + 3)[1] + 1
            continue
        if p.startswith("(?:", at):
            last, at = forms(p, at + 3)
            at += 1
        elif p.startswith("[^ ]+", at):
            last, at = ["x"], at + 5
        elif p[at] == "[":
            end = p.index("]", at)
            last, at = [p[at + 1]], end + 1
        else:
            last, at = [p[at]], at + 1
        if at < len(p) and p[at] == "?":
            last, at = ["", *last], at + 1
        elif at < len(p) and p[at] == "{":
            end = p.index("}", at)
            low, high = map(int, p[at + 1 : end].split(","))
            some = [[""]]
            for _ in range(high):
                some.append([a + b for a in some[-1] for b in last])
            last, at = [t for n in range(low, min(high, low + 2) + 1) for t in some[n]], end + 1
        here = [a + b for a in here for b in last]
    return out + here, at


def test_there_are_hundreds_of_rules_and_every_match_holds_its_keyword_and_a_gate_word():
    rules = L.rules()
    assert len(rules) > 1000 and len(L.BASE + L.NAMES + L.NOTICES + L.SPDX) > 160
    gate = L.gate_words()
    for r in {(r["k"], r["p"].split(" ", 1)[-1]): r for r in rules}.values():
        for text in forms(r["p"].removeprefix("^").removesuffix("(?= |$)"))[0]:
            assert r["k"] in text and text.split(" ")[0] == r["lead"] and any(all(x in text for x in w) for w in gate), (r, text)


def test_signatures_that_stand_alone(spark):
    texts = ["You may not use this file except in compliance with the License.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "for noncommercial use only", "clean prose about a permit and a mitten"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.labels for r in L.summarised(L.scan_licenses(df)).orderBy("doc_id").collect()] == ["apache-2", "cc-by", "non-commercial", ""]


def test_summary_and_hard_rows(spark):
    rows = {(r.doc_id, r.text): r for r in L.summarised(L.scan_licenses(documents(spark, clash=True))).collect()}
    r = rows[13, ROWS[16][1]]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (3, 1, 9, "apache-2,cc-by-nc,mit")
    blank = rows[4, ""]
    assert (blank.n_words, blank.n_base, blank.first_word, blank.labels, blank.score) == (0, 0, None, "", 0.0)
    assert L.summarised(L.scan_licenses(empty(spark))).count() == 0


def test_the_main_path_has_no_python(spark):
    plan = L.summarised(L.scan_licenses(documents(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
