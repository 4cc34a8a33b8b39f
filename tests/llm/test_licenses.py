from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from verbarium.llm import license_scan as L
from verbarium.llm import queries

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def places(words, phrase):
    want = phrase.split()
    return [k for k in range(len(words) - len(want) + 1) if words[k : k + len(want)] == want]


def brute(text):
    words = words_of(text)
    base = [(k, r.label) for r in L.BASE for k in places(words, r.phrase)]
    evidence = {}
    for r in L.RULES:
        if places(words, r.phrase):
            evidence[r.label] = max(evidence.get(r.label, 0), r.strength)
    left = 1.0
    for label in sorted(evidence):
        left *= 1 - evidence[label]
    at = [k for k, _ in base]
    return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(evidence)), round(1 - left, 9)


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def shown(row):
    return tuple(round(row[c], 9) if c == "score" else row[c] for c in COLUMNS)


def test_documents_against_brute_force(documents, data, spark):
    got = {r.doc_id: r for r in queries.QUERIES["op12_license_scan"](spark, data).collect()}
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys() and sum(r.n_base for r in got.values()) > 0
    for k, text in texts.items():
        assert shown(got[k]) == brute(text), k


TEXTS = [
    None, "", " .,;", "Released under the MIT License.", "under the\nMIT-license under the mit License", "cc by nc", "CC-BY-NC-SA 4.0 and xcc by nc", "the apache license version 2é", "The Apache License, Version 2.0",
    "Apache License, Version 2 under the MIT license; cc.by.nc " * 4000, "été under the mit licence", "\x00under\x7fthe mit license{", "日本 under the mit license 日本",
]


def test_odd_texts(spark, odd, none):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in L.summary(L.scan(docs)).collect():
        assert shown(r) == brute(TEXTS[r.doc_id]), r
    out = L.summary(L.scan(odd)).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in out) == sorted((str(r.doc_id), len(words_of(r.text))) for r in odd.collect())
    assert L.summary(L.scan(none)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["under", "the", "MIT", "license", "apache", "version", "2", "cc", "by", "nc", "-", "é", "\n", "."]), max_size=40))
def test_places_of_phrases(parts):
    text = " ".join(parts)
    n, matches, _ = L.scan_text(text.encode(), L.automaton(L.BASE))
    words = words_of(text)
    assert n == len(words) and sorted((m[0], m[2]) for m in matches) == sorted((k, r.label) for r in L.BASE for k in places(words, r.phrase))


# -- expressions, against a recursive reading of trees ------------------------------------------------------------------------------

names = st.sampled_from(["MIT", "Apache-2.0", "GPL-3.0-or-later", "Zlib", "LicenseRef-x"])
trees = st.recursive(names | st.tuples(st.just("with"), names, st.just("Classpath-exception-2.0")), lambda t: st.tuples(st.sampled_from(["and", "or"]), t, t), max_leaves=12)


def written(t, case):
    if isinstance(t, str):
        return t
    left, right = (f"({written(x, case)})" if not isinstance(x, str) else x for x in t[1:])
    return f"{left} {t[0].upper() if case else t[0]} {right}"


def met(t):
    if isinstance(t, str):
        return L.label_of(t) in L.PERMISSIVE
    return met(t[1]) if t[0] == "with" else (any if t[0] == "or" else all)(met(x) for x in t[1:])


def licences(t):
    return {L.label_of(t)} if isinstance(t, str) else licences(t[1]) if t[0] == "with" else licences(t[1]) | licences(t[2])


@settings(max_examples=200, deadline=None)
@given(trees, st.booleans(), st.sampled_from(["", " OR", " AND (", " see", ")", ", x", " OR (MIT AND", ". Then"]))
def test_expressions(tree, case, tail):
    got = L.parse(written(tree, case) + tail)
    assert (got.labels, got.permitted) == (licences(tree), met(tree))
    assert L.parse(got.text) == got  # the canonical text reads as itself


def test_binding_and_limits():
    assert L.parse("GPL-2.0-only OR MIT AND Zlib").permitted and not L.parse("(GPL-2.0-only OR MIT) AND GPL-3.0+").permitted
    assert L.parse("GPL-2.0-only WITH Classpath-exception-2.0 WITH other").text == "GPL-2.0-only WITH Classpath-exception-2.0"
    assert [L.parse(t) for t in ("", "(", "(MIT", "AND MIT", ")", "(MIT OR")] == [None] * 6
    assert len(L.parse("a or " * 20_000 + "b").labels) == 2 and L.parse("(" * 20_000) is None
    assert [L.label_of(x) for x in ("GPL-2.0+", "CC-BY-NC-SA-4.0", "CC0-1.0", "Apache-2.0", "LGPL-2.1-only", "BSD-3-Clause")] == ["gpl-2", "cc-by-nc-sa", "cc0", "apache-2", "lgpl-2.1", "bsd-3-clause"]


def test_tags():
    machine = L.automaton()
    tags = lambda t: [e[1:] for e in L.scan_text(t.encode(), machine)[2]]
    assert tags("# SPDX-License-Identifier: (MIT OR GPL-3.0-or-later) AND Zlib\nMIT") == [("(MIT OR GPL-3.0-or-later) AND Zlib", ["gpl-3", "mit", "zlib"], True)]
    assert tags("é\n/* spdx-license-identifier: LicenseRef-Own */") == [("LicenseRef-Own", ["licenseref-own"], False)]
    assert tags('{"license": "MIT OR Apache-2.0"}') == [("MIT OR Apache-2.0", ["apache-2", "mit"], True)] == tags("license = 'MIT OR Apache-2.0'")
    assert tags("License: see below") == tags("the license MIT") == tags("SPDX-License-Identifier MIT") == tags("SPDX-License-Identifier:") == []
    assert [e[0] for e in L.scan_text(b"one two SPDX-License-Identifier: MIT", machine)[2]] == [2]


def test_summary_of_tags(spark):
    docs = spark.createDataFrame([(1, "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: GPL-2.0-only\ncc by nc"), (2, "License: Zlib")], "doc_id long, text string")
    rows = {r.doc_id: r for r in L.summary(L.scan(docs)).collect()}
    assert (rows[1].labels, rows[1].base_labels, rows[1].expressions, rows[1].permitted, rows[1].score) == ("cc-by-nc,gpl-2,mit", "cc-by-nc", "MIT; GPL-2.0-only", False, 1.0)
    assert (rows[2].labels, rows[2].n_base, rows[2].permitted) == ("zlib", 0, True)
