from __future__ import annotations

import pytest

from verbarium.operators import grammar as G
from verbarium.operators import transcripts as T

PLAIN = """Transcript: one
Speakers:
D: Odo [Odo Brandt] (Frisian, old) #odo
S: Runa #runa
C: Tilda #tilda

PRELIMINARIES
C:\thow many nets did you mend?
MAIN
D: nine
   and a half
S: that was
1931 was the storm
6\t(0.4)
POSTLIMINARIES
lost line
S: enough (12:30)
END OF TRANSCRIPT
"""


@pytest.fixture(scope="module")
def parsed(spark):
    docs = spark.createDataFrame([("d", PLAIN), ("e", "Key: value\nA: hi\nB: yo\nA: bye"), ("f", None)], "doc string, text string")
    return {k: v.cache() for k, v in T.parse(docs).items()}


def rows(parsed, doc):
    return [(r.turn_number, r.speaker_id, r.text, r.section) for r in parsed["rows"].where(f"doc = '{doc}'").orderBy("row_no").collect()]


def test_rows(parsed):
    assert rows(parsed, "d") == [
        ("", "#tilda", "how many nets did you mend?", "PRE"), ("", "#odo", "nine and a half", "MAIN"), ("", "#runa", "that was 1931 was the storm", "MAIN"), ("6", "", "(0.4)", "MAIN"), ("", "#runa", "enough", "POST"),
    ]
    assert rows(parsed, "e") == [("", "#A", "hi", "MAIN"), ("", "#B", "yo", "MAIN"), ("", "#A", "bye", "MAIN")] and rows(parsed, "f") == []


def test_speakers(parsed):
    s = {r.code: r for r in parsed["speakers"].where("doc = 'd'").collect()}
    assert (s["D"].name, s["D"].alternate_name, s["D"].demographic, s["D"].resolved) == ("Odo", "Odo Brandt", "Frisian, old", "#odo")
    assert {r.resolved for r in parsed["speakers"].where("doc = 'e'").collect()} == {"#A", "#B"}


def test_diagnostics(parsed):
    found = [(r.line, [i.kind for i in r.issues]) for r in parsed["body_diagnostics"].where("doc = 'd'").orderBy("line").collect()]
    assert found == [(14, ["turn-number-missing-period", "speaker-code-missing"]), (16, ["speaker-code-missing"])]
    assert [(r.kind, r.n) for r in T.issue_tally(parsed["body_diagnostics"]).collect()] == [("speaker-code-missing", 2), ("turn-number-missing-period", 1)]
    reasons = {r.name: r.processed for r in parsed["section_diagnostics"].where("doc = 'd'").collect()}
    assert all(reasons.values()) and len(reasons) == 3
    assert T.order_warnings(["MAIN", "PRELIMINARIES"])[0].startswith("Unexpected") and len(T.order_warnings([])) == 1


def test_exports(parsed):
    csv = T.csv_text(parsed["rows"]).where("doc = 'd'").first().text.split("\n")
    assert csv[0] == "turnNumber,speakerID,text,section" and csv[1] == ",#tilda,how many nets did you mend?,PRE" and csv[-1] == ""
    chat = T.chat_text(parsed["rows"], parsed["speakers"], "eng", "c").where("doc = 'd'").first().text.split("\n")
    assert chat[0] == "@Participants: D Participant, S Participant, C Participant" and chat[1] == "@ID: eng|c|D|||Frisian, old||Participant|||" and chat[4] == "@Begin" and chat[5] == "*C: how many nets did you mend?" and chat[-2] == "@End"
    assert {r.id for r in T.person_entities(parsed["speakers"]).collect()} >= {"#odo", "#runa", "#tilda", "#A"}
    assert "5 rows" in T.log_text(parsed).where("doc = 'd'").first().text


def test_numbering_and_trimming(spark):
    docs = spark.createDataFrame([("n", "Speakers:\nA: Jo #a\nB: Ulf #b\nPRELIMINARIES\nMAIN\n1. A: rope\n2 B: tar\n3. A oil\n4. C: salt\nB:")], "doc string, text string")
    p = T.parse(docs, header_rows=1, footer_rows=1)
    assert [(r.turn_number, r.speaker_id, r.text) for r in p["rows"].orderBy("row_no").collect()] == [("2", "#b", "tar"), ("3", "#a", "oil"), ("4", "C", "salt")]
    kinds = {k for r in p["body_diagnostics"].collect() for i in r.issues for k in [i.kind]}
    assert kinds == {"turn-number-missing-period", "speaker-code-missing-colon", "speaker-code-undeclared", "text-missing"}


# -- grammars ----------------------------------------------------------------------------------------------------------------------


def sample(line, **fields):
    return {"line": line, "spans": [{"field": f, "start": line.index(v), "end": line.index(v) + len(v)} for f, v in fields.items()]}


DOC = """Title: x
Date: y
Speakers
A: Ann #ann
B: Ben #ben
bad one
MAIN
1  A: hello (3) there
  more
% note
2  B: yes
2  B: again
3 nothing
tail
END
lost
4  A: bye"""


def make(**options):
    return G.build("t", [sample("A: Ann #ann", code="A", name="Ann", id="#ann")], [sample("1  A: hello there", turn="1", speaker="A", text="hello there")], speakers_start="Speakers", main_start="MAIN", sections=["MAIN", "END"],
                   ignore=[r"^%.*"], strip=[r"\(\d+\)"], **options)


def test_trial(spark):
    found, missed = G.trial(G.read_lines(spark.createDataFrame([("d", DOC)], "doc string, text string")), make())
    assert {r.role: r.n for r in found.collect()}["main"] >= 3 and {r.line.strip() for r in missed.collect()} >= {"bad one"}
    again = G.saved(make(), "d.txt", "2026-01-01T00:00:00Z")
    assert again["markedUpFrom"] == "d.txt" and not G.validate(again)


def test_every_line_is_accounted_for_once(spark):
    lines = G.read_lines(spark.createDataFrame([("d", DOC)], "doc string, text string"))
    p = G.parse(lines, make(join_repeats=True)).cache()
    roles = [r.role for r in p.orderBy("line_no").collect()]
    assert roles == ["header", "header", "speakers:marker", "speakers", "speakers", "speakers:unmatched", "main:marker", "main", "main:continuation", "ignore", "main", "main:joined", "main:malformed", "main:continuation", "main:marker", "main:unmatched", "main"]
    assert [(r.line_no, r.text, r.malformed) for r in G.turns(p).orderBy("line_no").collect()] == [(8, "hello there more", False), (11, "yes again", False), (13, "nothing tail", True), (17, "bye", False)]
    assert [(r.turn_number, r.speaker_id, r.section) for r in G.rows(p).orderBy("row_no").collect()] == [("1", "#ann", "MAIN"), ("2", "#ben", "MAIN"), ("3", "", "MAIN"), ("4", "#ann", "END")]
    assert {(r.key, r.value) for r in G.metadata(p).collect()} == {("Title", "x"), ("Date", "y")}


def test_fixed_width(spark):
    text = "  1 A   one two        \n  2 B   three          \n  3 A   four           \n"
    lines = G.read_lines(spark.createDataFrame([("d", text)], "doc string, text string"))
    assert G.looks_fixed_width(lines).first().fixed
    g = G.build("f", [], [sample("  1 A   one two        ", turn="1", speaker="A", text="one two        ")], fixed_width=True, has_header=False)
    p = G.parse(lines, g)
    assert [(r.fields["turn"], r.fields["speaker"], r.text) for r in G.turns(p).orderBy("line_no").collect()] == [("1", "A", "one two"), ("2", "B", "three"), ("3", "A", "four")]


def test_validation_and_helpers(spark):
    g = make()
    assert G.validate(g) == [] and G.validate(None) == ["not a grammar object"] and len(G.fingerprint(g)) == 8 and G.fingerprint(g) != G.fingerprint(make(join_repeats=True))
    bad = {**g, "version": 9, "turnRow": {"pattern": "(", "customFields": [{"key": "x", "label": ""}]}, "dropColumns": [{"tab": 0}]}
    assert len(G.validate(bad)) == 5
    row = spark.createDataFrame([("a\tb\tc  XX d",)], "line string")
    assert row.select(G.drop_columns(row.line, [{"tab": 2}]).alias("v")).first().v == "a\tc  XX d"
    assert row.select(G.strip_all(row.line, ["X+"]).alias("v")).first().v == "a\tb\tc d"
    assert row.select(G.drop_columns(row.line, [{"from": 0, "to": 2}]).alias("v")).first().v == "b\tc  XX d"
    with pytest.raises(ValueError):
        G.row_pattern([sample("a b", speaker="a", text="b"), sample("a b", text="a", speaker="b")], G.TURN_FIELDS)
    with pytest.raises(KeyError):
        G.resolve("none", {})
    assert G.resolve(None, {}) is None and G.resolve("t", {"t": g}) is g
    assert [r for r, _ in G.suggest_regions(["T: x", "Speakers:", "A: b", "", "MAIN", "hi", "END OF TRANSCRIPT"])] == ["header", "speakers", "speakers", "speakers", "main", "main", "ignore"]
    assert G.suggest_regions(["", "EARLY CAPS", "speaker", "END OF TRANSCRIPT x", "", "SPEAKERS"]) == [(None, False), ("header", False), ("speakers", True), ("ignore", False), ("speakers", False), ("main", True)]
    assert G.suggest_regions([]) == []
    assert G.custom_key("Pitch Höhe", ("c_pitch_ho_he",)) == "c_pitch_ho_he_2" and G.custom_key("!") == "c_field"


@pytest.mark.parametrize("text", ["a\n\nb\n\nc", "a\n\n\nb", "a\n\n\n\nb\nc", "\n\nx", "a\nb\n", ""])
def test_paragraph_numbers(spark, text):
    want = [k for k, p in enumerate(text.split("\n\n"), 1) for _ in [*p.split("\n"), *[0] * (k < len(text.split("\n\n")))]]
    lines = spark.createDataFrame([("d", n, x) for n, x in enumerate(text.split("\n"), 1)], "doc string, line_no int, raw string")
    assert [r.paragraph for r in T.paragraph_numbers(lines).orderBy("line_no").collect()] == want
