"""Queries on small tables with the rows that the given ones don't have."""

from __future__ import annotations

from collections import Counter

import pytest
import regex

from verbarium import registry
from verbarium.operators.names import HONORIFICS


@pytest.fixture
def folder(spark, tmp_path):
    def f(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return f


def brute_names(text):
    t = regex.sub(r"(\p{L})['’]s\b", r"\1", text or "")
    t = regex.sub(rf"\b(?:{'|'.join(HONORIFICS)})\.?\s+(?=\p{{Lu}})", "", t)
    return {m for m in regex.findall(r"\p{Lu}[\p{L}\p{M}'’-]*(?:[ \t]+\p{Lu}[\p{L}\p{M}'’-]*)*", t) if len(regex.sub(r"\P{L}", "", m)) >= 4}


def test_candidate_names_of_texts_with_possessives_and_titles(spark, folder):
    texts = ["Mrs. Mary Grant's home, Palm Island. Dr M. at Ayr", "it’s Élodie Brun’s boat and Sir John O'Neil\tSmith", "Fr Tom, Rev. Anna-Lena", "no name", "Plain Name here", None]
    d = folder("documents", list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc, r.name) for r in registry.QUERIES["candidate_names"](spark, d).collect())
    assert got == sorted((k, n) for k, t in enumerate(texts) for n in brute_names(t))
    assert (0, "Mary Grant") in got and (1, "Élodie Brun") in got and (2, "Anna-Lena") in got


TURNS = ["Plain", "a (aside) b", "(all of it)", "open ( only", "one) closed", "((inner) outer)", "two (x) and (y)", " spaced  (out) ", None, ""]


def brute_turn(role, text):
    """role, speaker_id, text of the turn; where the strip rule leaves nothing, the row "role:" lacks the blank that the pattern wants."""
    said = regex.sub(r"\s+", " ", text or "").strip(" ")
    left = regex.sub(r" +", " ", regex.sub(r"[(][^()]*[)]", "", said)).strip()
    return ("main", f"#{role}", f"{left} tail") if left else ("main:malformed", "", f"{role}: tail")


def test_grammar_queries_keep_turns_with_parentheses(spark, folder):
    given = [(k % 2, k, "user" if k % 3 else "assistant", t) for k, t in enumerate(TURNS)]
    d = folder("conversations", given, "conv_id long, turn long, role string, text string")
    want = {k: (str(c), brute_turn(role, t)) for c, k, role, t in given}
    got = {int(r.turn_number): (r.doc, r.speaker_id, r.text, r.section) for r in registry.QUERIES["grammar_turns"](spark, d).collect()}
    assert got == {k: (c, who, text, "== A") for k, (c, (_, who, text)) in want.items()}
    assert got[1][2] == "a b tail" and got[3][2] == "open ( only tail" and got[5][2] == "( outer) tail"
    roles = {r.role: r.n for r in registry.QUERIES["grammar_roles"](spark, d).collect()}
    assert roles == {**Counter(x for _, (x, _, _) in want.values()), "ignore": len(TURNS), "main:continuation": len(TURNS), "main:marker": 2}
