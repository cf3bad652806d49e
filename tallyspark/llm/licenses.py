"""Operator 1: license scans by ordered signature rules, with DataFrame functions only.

A rule is a regular expression over the words of a text (lower-cased A-Z, one
space between words), a keyword that any match must contain, a priority and a
label. A text is looked at further only if it holds a word of one of the keywords; then
each word that starts some rule opens a window of ``WINDOW`` words, and the
rules of that word whose keyword stands in the window are tried at its start.
A match inside another of the same or a better priority is suppressed. The
whole scan is one narrow projection: no row moves and none is multiplied.

Defined cases: a null text is empty; an empty text has no words, no places, no
labels (empty strings) and score 0; repeated rows give repeated rows; an empty
table gives an empty table; columns of the input named like a result column are
replaced by it. Overlapping matches that do not contain each other all stay.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Priorities: 1 a grant or an identifier, 2 a phrase of scope or a notice's text, 3 a bare name.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# label, a word run that any form of the name contains, first words of the name, the name
NAMES = [
    ("mit", "mit license", "mit", "mit license"),
    ("mit", "expat license", "expat", "expat license"),
    ("apache-1", "apache", "apache", "apache (?:software )?license version 1(?: [01])?"),
    ("apache-2", "apache", "apache", "apache (?:software )?license(?: version)? 2(?: 0)?"),
    ("apache-2", "apache", "apache", "apache 2(?: 0)? license"),
    ("apache", "apache license", "apache", "apache license"),
    ("gpl-2", "gpl", "gpl", "gpl(?: version)? v?2(?: 0)?"),
    ("gpl-2", "gplv2", "gplv2", "gplv2"),
    ("gpl-3", "gpl", "gpl", "gpl(?: version)? v?3(?: 0)?"),
    ("gpl-3", "gplv3", "gplv3", "gplv3"),
    ("gpl-2", "general public license", "gnu", "gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version)? v?2(?: 0)?"),
    ("gpl-3", "general public license", "gnu", "gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version)? v?3(?: 0)?"),
    ("gpl", "general public license", "gnu", "gnu general public license"),
    ("gpl", "gnu gpl", "gnu", "gnu gpl"),
    ("lgpl-2.1", "lgpl", "lgpl", "lgpl(?: version)? v?2 1"),
    ("lgpl-3", "lgpl", "lgpl", "lgpl(?: version)? v?3(?: 0)?"),
    ("lgpl-2.1", "general public license", "gnu", "gnu (?:lesser|library) general public license(?: version)? v?2(?: [01])?"),
    ("lgpl-3", "general public license", "gnu", "gnu lesser general public license(?: version)? v?3(?: 0)?"),
    ("lgpl", "general public license", "gnu", "gnu (?:lesser|library) general public license"),
    ("agpl-3", "agpl", "agpl", "agpl(?: version)? v?3(?: 0)?"),
    ("agpl-3", "agplv3", "agplv3", "agplv3"),
    ("agpl-3", "general public license", "gnu", "gnu affero general public license(?: version)? v?3(?: 0)?"),
    ("agpl", "general public license", "gnu", "gnu affero general public license"),
    ("gfdl", "free documentation license", "gnu", "gnu free documentation license(?: version 1(?: [123])?)?"),
    ("bsd-2-clause", "bsd", "bsd", "bsd 2 clause(?: simplified)?(?: license)?"),
    ("bsd-2-clause", "simplified bsd", "simplified", "simplified bsd license"),
    ("bsd-3-clause", "bsd", "bsd", "bsd 3 clause(?: new| revised)?(?: license)?"),
    ("bsd-3-clause", "bsd license", "new", "new bsd license"),
    ("bsd-3-clause", "bsd license", "modified", "modified bsd license"),
    ("bsd-4-clause", "bsd", "bsd", "bsd 4 clause(?: original)?(?: license)?"),
    ("bsd", "bsd license", "bsd", "bsd license"),
    ("0bsd", "0bsd", "0bsd", "0bsd(?: license)?"),
    ("isc", "isc license", "isc", "isc license"),
    ("zlib", "zlib", "zlib", "zlib(?: libpng)? license"),
    ("mpl-1.1", "mozilla public license", "mozilla", "mozilla public license(?: version)? v?1 1"),
    ("mpl-2", "mozilla public license", "mozilla", "mozilla public license(?: version)? v?2(?: 0)?"),
    ("mpl", "mozilla public license", "mozilla", "mozilla public license"),
    ("epl-1", "eclipse public license", "eclipse", "eclipse public license(?: version)? v?1(?: 0)?"),
    ("epl-2", "eclipse public license", "eclipse", "eclipse public license(?: version)? v?2(?: 0)?"),
    ("epl", "eclipse public license", "eclipse", "eclipse public license"),
    ("cddl-1", "common development and distribution license", "common", "common development and distribution license(?: version)?(?: 1(?: [01])?)?"),
    ("cpl-1", "common public license", "common", "common public license(?: version)?(?: 1(?: 0)?)?"),
    ("eupl", "european union public licence", "european", "european union public licence(?: version)?(?: 1(?: [012])?)?"),
    ("eupl", "eupl", "eupl", "eupl(?: 1 [012])?"),
    ("bsl-1", "boost software license", "boost", "boost software license(?: version)?(?: 1(?: 0)?)?"),
    ("unlicense", "unlicense", "unlicense", "unlicense(?: license)?"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("artistic-1", "artistic license", "artistic", "artistic license(?: version)? 1(?: 0)?"),
    ("artistic-2", "artistic license", "artistic", "artistic license(?: version)? 2(?: 0)?"),
    ("artistic", "artistic license", "artistic", "artistic license"),
    ("psf-2", "python software foundation license", "python", "python software foundation license(?: version 2)?"),
    ("ruby", "ruby license", "ruby", "ruby license"),
    ("php-3", "php license", "php", "php license(?: version)?(?: 3(?: 0(?:1)?)?)?"),
    ("openssl", "openssl license", "openssl", "openssl license"),
    ("ofl-1.1", "open font license", "sil", "sil open font license(?: version)?(?: 1(?: 1)?)?"),
    ("odbl-1", "open database license", "open", "open database license"),
    ("osl-3", "open software license", "open", "open software license(?: version)?(?: 3(?: 0)?)?"),
    ("afl-3", "academic free license", "academic", "academic free license(?: version)?(?: 3(?: 0)?)?"),
    ("ms-pl", "microsoft public license", "microsoft", "microsoft public license"),
    ("ms-rl", "microsoft reciprocal license", "microsoft", "microsoft reciprocal license"),
    ("upl-1", "universal permissive license", "universal", "universal permissive license(?: version)?(?: 1(?: 0)?)?"),
    ("cc-by", "cc by", "cc", "cc by(?: [1234] [05])?(?! nc| nd| sa)"),
    ("cc-by-sa", "cc by sa", "cc", "cc by sa(?: [1234] [05])?"),
    ("cc-by-nd", "cc by nd", "cc", "cc by nd(?: [1234] [05])?"),
    ("cc-by-nc", "cc by nc", "cc", "cc by nc(?: [1234] [05])?(?! nd| sa)"),
    ("cc-by-nc-sa", "cc by nc sa", "cc", "cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc-nd", "cc by nc nd", "cc", "cc by nc nd(?: [1234] [05])?"),
    ("cc0", "cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "creative commons", "creative", "creative commons attribution(?: [1234] [05])?(?! noncommercial| non commercial| sharealike| share alike| noderiv)(?: international| unported| generic)?(?: license)?"),
    ("cc-by-sa", "creative commons", "creative", "creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: license)?"),
    ("cc-by-nd", "creative commons", "creative", "creative commons attribution no ?deriv(?:ative)?s?(?:works)?(?: [1234] [05])?(?: international| unported| generic)?(?: license)?"),
    ("cc-by-nc", "creative commons", "creative", "creative commons attribution non ?commercial(?: [1234] [05])?(?! share ?alike| no ?deriv)(?: international| unported| generic)?(?: license)?"),
    ("cc-by-nc-sa", "creative commons", "creative", "creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: license)?"),
    ("cc-by-nc-nd", "creative commons", "creative", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1234] [05])?(?: international| unported| generic)?(?: license)?"),
    ("cc", "creative commons license", "creative", "creative commons license"),
]

# how a name is used: first words, what stands before it, priority, score
USES = [
    (("licensed", "released", "distributed", "available", "published", "provided", "issued", "covered", "offered"), "under (?:the |a )?(?:terms of (?:the |a )?|conditions of (?:the |a )?)?", 1, 1.0),
    (("under",), "(?:the |a )?(?:terms of (?:the |a )?|conditions of (?:the |a )?)?", 2, 0.9),
    (("subject", "according"), "to (?:the )?(?:terms of (?:the )?)?", 2, 0.9),
    (("governed",), "by (?:the )?(?:terms of (?:the )?)?", 2, 0.9),
]

# label, keyword, first word, what follows it, priority, score
NOTICES = [
    ("mit", "permission is hereby granted", "permission", "is hereby granted free of charge to any person obtaining a copy", 1, 1.0),
    ("isc", "permission to use copy modify", "permission", "to use copy modify and or distribute this software for any purpose", 1, 1.0),
    ("bsd", "redistribution and use", "redistribution", "and use in source and binary forms with or without modification", 1, 1.0),
    ("bsd-3-clause", "endorse or promote products", "neither", "the name of (?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote products", 2, 0.9),
    ("bsd-4-clause", "advertising materials", "all", "advertising materials mentioning features or use of this software", 2, 0.9),
    ("gpl", "free software you can redistribute", "is", "free software you can redistribute it and or modify it", 2, 0.9),
    ("apache-2", "may not use this file except in compliance", "you", "may not use this file except in compliance with the license", 2, 0.9),
    ("zlib", "provided as is without any express", "this", "software is provided as is without any express or implied warranty", 2, 0.8),
    ("unlicense", "released into the public domain", "released", "into the public domain", 1, 1.0),
    ("public-domain", "public domain", "dedicated", "to the public domain", 1, 1.0),
    ("public-domain", "public domain", "in", "the public domain", 3, 0.6),
    ("proprietary", "all rights reserved", "all", "rights reserved", 3, 0.5),
    ("proprietary", "proprietary and confidential", "proprietary", "and confidential", 2, 0.7),
    ("proprietary", "unauthorized copying", "unauthorized", "copying of this (?:file|work|document|software)", 2, 0.7),
    ("spdx-other", "spdx license identifier", "spdx", "license identifier [^ ]+", 3, 0.6),
    ("mit", "this permission notice shall be included", "the", "above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 2, 0.9),
    ("mit", "to deal in the software without restriction", "to", "deal in the software without restriction including without limitation the rights to use", 2, 0.9),
    ("mit", "warranty of any kind express or implied", "the", "software is provided as is without warranty of any kind express or implied", 2, 0.8),
    ("isc", "the author disclaims all warranties", "the", "software is provided as is and the author disclaims all warranties with regard to this software", 2, 0.9),
    ("bsd", "redistributions of source code", "redistributions", "of source code must retain the above copyright notice this list of conditions and the following disclaimer", 2, 0.9),
    ("bsd", "redistributions in binary form", "redistributions", "in binary form must reproduce the above copyright notice this list of conditions", 2, 0.9),
    ("bsd", "any express or implied warranties", "this", "software is provided by (?:the )?(?:[^ ]+ ){1,8}as is and any express or implied warranties", 2, 0.8),
    ("apache-2", "warranties or conditions of any kind", "distributed", "on an as is basis without warranties or conditions of any kind", 2, 0.8),
    ("apache-2", "required by applicable law or agreed to in writing", "unless", "required by applicable law or agreed to in writing(?: software distributed under the license)?", 2, 0.8),
    ("apache-2", "grant of patent license", "grant", "of patent license subject to the terms and conditions of this license", 2, 0.8),
    ("gpl", "without even the implied warranty", "without", "even the implied warranty of merchantability or fitness for a particular purpose", 2, 0.8),
    ("gpl", "general public license for more details", "see", "the gnu general public license for more details", 2, 0.9),
    ("lgpl", "general public license for more details", "see", "the gnu (?:lesser|library) general public license for more details", 2, 0.9),
    ("agpl", "general public license for more details", "see", "the gnu affero general public license for more details", 2, 0.9),
    ("gpl", "should have received a copy of the gnu", "you", "should have received a copy of the gnu general public license", 2, 0.9),
    ("lgpl", "should have received a copy of the gnu", "you", "should have received a copy of the gnu (?:lesser|library) general public license", 2, 0.9),
    ("agpl", "should have received a copy of the gnu", "you", "should have received a copy of the gnu affero general public license", 2, 0.9),
    ("gpl", "at your option any later version", "either", "version [123](?: [01])? of the license or at your option any later version", 3, 0.6),
    ("mpl-2", "this source code form is subject", "this", "source code form is subject to the terms of the mozilla public license v ?2 0", 1, 1.0),
    ("mpl-2", "a copy of the mpl was not distributed", "if", "a copy of the mpl was not distributed with this file", 2, 0.9),
    ("mpl-1.1", "contents of this file are subject to the mozilla", "the", "contents of this file are subject to the mozilla public license version 1 1", 1, 1.0),
    ("cddl-1", "contents of this file are subject to the terms of the common development", "the", "contents of this file are subject to the terms of the common development and distribution license", 1, 1.0),
    ("epl", "program and the accompanying materials", "this", "program and the accompanying materials are made available under the terms of the eclipse public license", 1, 1.0),
    ("bsl-1", "any person or organization obtaining a copy", "permission", "is hereby granted free of charge to any person or organization obtaining a copy", 1, 1.0),
    ("unlicense", "free and unencumbered software", "this", "is free and unencumbered software released into the public domain", 1, 1.0),
    ("wtfpl", "do what the fuck you want to", "you", "just do what the fuck you want to", 1, 1.0),
    ("beerware", "buy me a beer in return", "buy", "me a beer in return", 1, 1.0),
    ("perl", "the same terms as perl", "under", "the same terms as perl(?: itself)?", 1, 1.0),
    ("zlib", "source versions must be plainly marked", "altered", "source versions must be plainly marked as such", 2, 0.9),
    ("zlib", "origin of this software must not be misrepresented", "the", "origin of this software must not be misrepresented", 2, 0.9),
    ("cc0", "has waived all copyright", "to", "the extent possible under law (?:[^ ]+ ){1,8}has waived all copyright", 1, 1.0),
    ("ofl-1.1", "font software is licensed under the sil", "this", "font software is licensed under the sil open font license(?: version 1 1)?", 1, 1.0),
    ("openssl", "developed by the openssl project", "developed", "by the openssl project for use in the openssl toolkit", 2, 0.9),
    ("php-3", "includes php software freely available", "includes", "php software freely available from", 2, 0.9),
    ("bsd-4-clause", "this product includes software developed by", "this", "product includes software developed by", 2, 0.8),
    ("proprietary", "may be reproduced", "no", "part of this (?:publication|document|work|software|book) may be reproduced", 2, 0.7),
    ("proprietary", "the prior written", "without", "the prior written (?:permission|consent) of", 2, 0.6),
    ("proprietary", "trade secret", "contains", "(?:confidential |proprietary |valuable ){0,2}(?:information and )?trade secrets?", 2, 0.6),
    ("proprietary", "internal use only", "for", "internal use only", 3, 0.5),
    ("proprietary", "end user license agreement", "end", "user license agreement", 2, 0.7),
    ("proprietary", "reverse engineer", "may", "not (?:decompile |disassemble |or ){0,3}reverse engineer", 2, 0.7),
    ("non-commercial", "commercial use only", "for", "non ?commercial use only", 2, 0.7),
    ("non-commercial", "commercial purposes", "for", "non ?commercial purposes(?: only)?", 3, 0.6),
    ("public-domain", "no known copyright", "no", "known copyright(?: restrictions)?", 2, 0.7),
    ("public-domain", "united states government work", "a", "united states government work", 2, 0.7),
]

SPDX = [
    ("mit", "mit"), ("apache-2", "apache 2 0"), ("gpl-2", "gpl 2 0(?: only| or later)?"), ("gpl-3", "gpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?"), ("lgpl-3", "lgpl 3 0(?: only| or later)?"), ("agpl-3", "agpl 3 0(?: only| or later)?"),
    ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"), ("0bsd", "0bsd"), ("isc", "isc"), ("zlib", "zlib"), ("mpl-2", "mpl 2 0"),
    ("epl-2", "epl 2 0"), ("cddl-1", "cddl 1 0"), ("bsl-1", "bsl 1 0"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("cc0", "cc0 1 0"),
    ("cc-by", "cc by [1234] [05]"), ("cc-by-sa", "cc by sa [1234] [05]"), ("cc-by-nc", "cc by nc [1234] [05]"), ("ofl-1.1", "ofl 1 1"), ("eupl", "eupl 1 2"), ("upl-1", "upl 1 0"),
]


def rules() -> list[dict]:
    """All rules in order; ``lead`` is a match's first word and ``k`` stands in every match."""
    out = []

    def add(label, key, lead, rest, prio, score, base=0):
        body = f"{lead} {rest}".strip() if rest else lead
        out.append({"n": len(out), "label": label, "k": key, "lead": lead, "p": f"^(?:{body})(?= |$)", "prio": prio, "score": score, "base": base})

    for phrase, label in BASE:
        lead, rest = phrase.split(" ", 1)
        add(label, phrase, lead, rest, 2, 1.0, 1)
    for label, key, lead, rest, prio, score in NOTICES:
        add(label, key, lead, rest, prio, score)
    for label, name in SPDX:
        add(label, "spdx license identifier", "spdx", f"license identifier {name}", 1, 1.0)
    for leads, between, prio, score in USES:
        for lead in leads:
            for label, key, _, name in NAMES:
                add(label, key, lead, f"{between}{name}", prio, score)
    for label, key, lead, name in NAMES:
        add(label, key, lead, name[len(lead) :].strip() if name.startswith(lead + " ") else name[len(lead) :], 3, 0.6)
        if not name.startswith(lead + " "):
            out[-1]["p"] = f"^(?:{name})(?= |$)"
    return out


def _words(p: str, at: int = 0) -> tuple[int, int]:
    """The most spaces a match of ``p`` can hold or look at, and where its group ends."""
    most = here = last = 0
    while at < len(p) and p[at] != ")":
        if p.startswith("[^ ]", at):
            last, at = 0, at + 4
        elif p[at] == "(":
            last, at = _words(p, at + 3)
            here, at = here + last, at + 1
        elif p[at] == "|":
            most, here, last, at = max(most, here), 0, 0, at + 1
        elif p[at] == "{":
            end = p.index("}", at)
            here, at = here + last * (int(p[at + 1 : end].split(",")[-1]) - 1), end + 1
        else:
            here, last, at = here + (p[at] == " "), int(p[at] == " "), at + 1
    return max(most, here), at


#: The longest match of any rule, in words, and the word behind it.
WINDOW = max(_words(r["p"])[0] for r in rules()) + 1


#: Words that ordinary texts have, which make poor gates.
COMMON = frozenset("the and for any all was not you may are this file with without what want source product products provided distributed available public free use under required subject received written agreed contents modification version program materials copy made part work software person same one other prior terms must only united states return development".split())


def gate_words() -> list[tuple[str, ...]]:
    """Words that stand in the keywords, so that every keyword has one: a word that others share, else its longest.

    A keyword of short words alone, which any text has, counts as a whole.
    """
    left = {r["k"] for r in rules()}
    words = sorted({w for k in left for w in k.split(" ") if len(w) > 2 and w not in COMMON})
    out = []
    while some := {k for k in left if any(w in k for w in words)}:
        best = max(words, key=lambda w: (sum(w in k for k in some), len(w), w))
        out.append((best,))
        left = {k for k in left if best not in k}
    short = sorted((tuple(k.split(" ")) for k in left), key=len)
    return out + [k for n, k in enumerate(short) if not any(k[: len(o)] == o for o in short[:n])]


def gated(text: Column) -> Column:
    """True for every text that can hold a keyword: plain searches, hardly a pattern is tried on other texts."""
    low = F.lower(text)
    return reduce(or_, [F.contains(low, F.lit(w[0])) & (F.rlike(low, F.lit(BREAK.join(w))) if len(w) > 1 else F.lit(True)) for w in gate_words()])


_RULE = "n int, label string, k string, p string, prio int, score double, base int"
_DET = "struct<s:int,e:int,prio:int,n:int,label:string,score:double,base:int>"


def _by_lead() -> tuple[str, list[str]]:
    by: dict[str, list[dict]] = {}
    for r in rules():
        by.setdefault(r["lead"], []).append({k: v for k, v in r.items() if k != "lead"})
    return json.dumps(by), sorted(by)


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def detections(text: Column) -> Column:
    """All matches of a text that are left after suppression, by start."""
    known, leads = _by_lead()
    table_of = F.from_json(F.lit(known), f"map<string,array<struct<{_RULE.replace(' ', ':').replace(',:', ',')}>>>")
    lead_list = F.array(*[F.lit(x) for x in leads])
    words = F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))

    def tried(win: Column) -> Column:
        """Matches at the window's start; those inside a better one at the same start go."""
        found = F.filter(F.element_at(table_of, win["w"]), lambda r: F.contains(win["t"], r["k"]) & F.call_function("rlike", win["t"], r["p"]))
        found = F.transform(
            found,
            lambda r: F.struct(
                win["i"].alias("s"),
                (win["i"] + F.size(F.split(F.call_function("regexp_extract", win["t"], r["p"], F.lit(0)), " "))).alias("e"),
                r["prio"].alias("prio"), r["n"].alias("n"), r["label"].alias("label"), r["score"].alias("score"), r["base"].alias("base"),
            ),
        )
        return found

    def inside(a: Column, b: Column) -> Column:
        longer = (b["e"] - b["s"]) > (a["e"] - a["s"])
        same = (b["s"] == a["s"]) & (b["e"] == a["e"])
        better = (b["prio"] < a["prio"]) | ((b["prio"] == a["prio"]) & (longer | (same & (b["n"] < a["n"]))))
        return (b["s"] <= a["s"]) & (b["e"] >= a["e"]) & better

    def unsuppressed(found: Column, near) -> Column:
        return F.filter(found, lambda a, j: (a["base"] == 1) | ~F.exists(near(found, j), lambda b: inside(a, b)))

    def of(ws: Column) -> Column:
        starts = F.filter(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(lead_list, x["w"]))
        wins = F.transform(starts, lambda x: F.struct(x["w"].alias("w"), x["i"].alias("i"), F.array_join(F.slice(ws, x["i"] + 1, WINDOW), " ").alias("t")))
        at_start = F.filter(F.transform(wins, lambda x: unsuppressed(tried(x), lambda f, j: f)), lambda d: F.size(d) > 0)
        # at most one match of each priority and one base phrase is left at a start, so those
        # that can contain a match are among the 4 * WINDOW before it
        back = 4 * WINDOW
        return unsuppressed(F.flatten(at_start), lambda f, j: F.slice(f, F.greatest(j + 1 - back, F.lit(1)), F.lit(back + 8)))

    # a one-element array binds the words once
    bound = F.flatten(F.transform(F.array(words), of))
    return F.when(F.coalesce(gated(text), F.lit(False)), bound).otherwise(F.array().cast(f"array<{_DET}>"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words and detections (s and e: first word and the word after the last)."""
    n = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long")
    return docs.withColumns({"n_words": n, "detections": detections(F.col("text"))})


def summarised(scanned: DataFrame) -> DataFrame:
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")
    base = F.filter("detections", lambda d: d["base"] == 1)
    starts = F.transform(base, lambda d: d["s"].cast("long"))
    return scanned.withColumns({
        "n_base": F.size(base).cast("long"),
        "first_word": F.array_min(starts),
        "last_word": F.array_max(starts),
        "base_labels": labels(base),
        "labels": labels(F.col("detections")),
        "score": F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0)),
    })


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = summarised(scan_licenses(docs))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("detections").cast("long").alias("n_detections"))
