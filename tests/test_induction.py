"""Row patterns from marked samples."""

from __future__ import annotations

import re

import pytest

from verbarium.operators import grammar as G
from verbarium.operators import induction as I


def mark(text):
    """`<t:12>` marks a field: turn, speaker, text or a custom one."""
    names, line, spans = {"t": "turn", "s": "speaker", "x": "text"}, "", []
    for piece in re.split(r"(<\w+:[^>]*>)", text):
        m = re.fullmatch(r"<(\w+):([^>]*)>", piece)
        value = m[2] if m else piece
        if m:
            spans.append({"field": names.get(m[1], m[1]), "start": len(line), "end": len(line) + len(value)})
        line += value
    return {"line": line, "spans": spans}


def read(row, line):
    m = re.search(re.sub(r"\(\?<(\w+)>", r"(?P<\1>", row["pattern"]).replace(r"\p{Lu}", "[A-Z]").replace(r"\p{Ll}", "[a-z]").replace(r"\p{L}", "A-Za-z"), line)
    return m and m.groupdict()


def test_parts_and_their_least_cover():
    assert [(p.kind, p.text) for p in I.parts("Ab 12--x")] == [("upper", "A"), ("lower", "b"), ("blank", " "), ("digit", "12"), ("mark", "-"), ("mark", "-"), ("lower", "x")]
    assert I.pattern_of(I.anti_unify(["S01", "S12", "S9"])) == r"S\d+" and I.pattern_of(I.anti_unify(["S01", "S12"])) == r"S\d{2}"
    assert I.pattern_of(I.anti_unify(["S01", "T12"])) == r"\p{Lu}\d{2}" and I.pattern_of(I.anti_unify(["a-1", "a-2b"])) == r"a\-\d(?:b)?"
    assert I.pattern_of(I.anti_unify(["", "x"])) == "(?:x)?" and I.anti_unify([""]) == [] and I.bits([]) == 0.0


def test_alignment_costs_the_least():
    """Against all alignments of short sequences."""
    import itertools
    import random

    def brute(a, b):
        if not a or not b:
            return sum(I.SKIP * (not p.may) for p in a) + I.SKIP * len(b)
        ways = [brute(a[1:], b) + I.SKIP * (not a[0].may), brute(a, b[1:]) + I.SKIP]
        if both := I.generalised(a[0], b[0]):
            ways.append(both[1] + brute(a[1:], b[1:]))
        return min(ways)

    r = random.Random(3)
    texts = ["".join(r.choice("aB1 -:") for _ in range(r.randrange(6))) for _ in range(12)]
    for x, y in itertools.combinations(texts, 2):
        a, b = I.parts(x), I.parts(y)
        assert abs(I.unified(a, b)[1] - brute(a, b)) < 1e-9


def lines_of(spark, said):
    return spark.createDataFrame([("d", k, x) for k, x in enumerate(said)], "doc string, line_no long, line string")


def test_lines_decide_how_general_a_pattern_is(spark):
    marked = [mark("<t:1>. <s:AB>: <x:well, so>"), mark("<t:2>. <s:CD>: <x:yes>")]
    special = [f"{k}. {s}: word {k}" for k in range(1, 10) for s in ("AB", "XY")]
    row = I.induce(lines_of(spark, special), marked)
    assert row["fields"] == ["turn", "speaker", "text"] and r"(?<speaker>\p{Lu}{2})" in row["pattern"] and r"(?<turn>\d)" in row["pattern"]
    wider = [f"{k}. {s}: word {k}" for k in range(1, 60) for s in ("AB", "LONG")] + ["just a line", None, ""]
    row = I.induce(lines_of(spark, wider), marked)
    assert r"(?<speaker>\p{Lu}+)" in row["pattern"] and r"(?<turn>\d+)" in row["pattern"] and read(row, "just a line") is None
    assert read(row, "12. LONG: a b") == {"turn": "12", "speaker": "LONG", "text": "a b"} and row["rowStart"].startswith("^(?<turn>")
    odd = [f"{k}. s_{k}:no blank" for k in range(40)]
    assert read(I.induce(lines_of(spark, odd), marked), odd[7]) == {"turn": "7", "speaker": "s_7", "text": "no blank"}


def test_fields_that_may_miss_and_no_lines(spark):
    marked = [mark("<t:1> <s:A>\t<x:so>"), mark("<s:B>\t<x:yes>")]
    row = I.induce(lines_of(spark, []), marked)
    assert read(row, "1 A\tso") == {"turn": "1", "speaker": "A", "text": "so"} and read(row, "B\tyes")["turn"] is None
    with pytest.raises(ValueError):
        I.induce(lines_of(spark, []), [])
    with pytest.raises(ValueError):
        I.candidates([mark("<t:1> <s:A> <x:a>"), mark("<s:A> <t:1> <x:a>")])
    many = mark("".join(f"<c_{k}:{k}>," for k in range(7)) + "<x:end>")
    assert len(I.candidates([many])) <= I.MOST


def test_tried_counts_what_each_pattern_matches(spark):
    marked = [mark("<t:1>. <s:AB>: <x:so>")]
    said = ["1. AB: so", "2. AB: no", "33. CD: x", "4) AB: x", "", None]
    for c in I.tried(lines_of(spark, said), I.candidates(marked)):
        assert c["n"] == sum(read(c["row"], x or "") is not None for x in said if x)


def test_induced_rows_in_a_grammar_and_its_regions(spark):
    docs = spark.createDataFrame([("d", "MAIN\n1. AB: one\n  more\n12. CDE: two\n%x")], "doc string, text string")
    lines = G.read_lines(docs)
    row = I.induce(lines, [mark("<t:1>. <s:AB>: <x:one>"), mark("<t:2>. <s:CDE>: <x:two>")])
    g = {**G.build("i", [], [mark("<t:1>. <s:AB>: <x:one>")], main_start="MAIN", sections=["MAIN"], ignore=["^%"], has_header=False), "turnRow": row}
    p = G.parse(lines, g)
    assert not G.validate(g) and [(r.turn_number, r.text) for r in G.rows(p).orderBy("row_no").collect()] == [("1", "one more"), ("12", "two")]
    assert [(r.region, r.marker) for r in I.regions(p).orderBy("line_no").collect()] == [("main", True), ("main", False), ("main", False), ("main", False), ("ignore", False)]
