"""Licence scans of whole texts.

A text's words are laid out with a blank before and after each, in one pass over its bytes, and an Aho-Corasick automaton over notice phrases and identifier tags
reads them once; what it finds stands on whole words. Behind a tag (`SPDX-License-Identifier:`, or `License:` and `license =` as manifests have it) the original text holds an expression, which a
shunting-yard parser reads: WITH binds a licence to an exception, AND before OR, brackets before all. An expression is evaluated as it is parsed: its licences (each a label), and
whether it can be met by permitted licences alone (AND needs both sides, OR one; an exception only widens its licence).

Rules are a parameter: phrases with a label, a strength and whether they are base rules. The score of a text is 1 minus the product of (1 - strength) over its labels, each with its
strongest evidence.

Defined cases: a null text is empty; a text without words has no matches, an empty label list and score 0; phrases may overlap and count each; a tag without a licence behind it gives
nothing; of an expression the longest valid beginning counts (`MIT, see` is `MIT`, `MIT OR (` is `MIT`); the plain tag `license` counts only where all
licences are known ones; texts of any length are read whole, in some six times their bytes; each row is judged by itself, so null or repeated doc_ids keep their rows; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, id_type, ship

#: Texts of an Arrow batch that a worker turns into results at once.
ROWS = 500


@dataclass(frozen=True)
class Rule:
    phrase: str
    label: str
    strength: float = 0.9
    base: bool = False


BASE = (Rule("under the mit license", "mit", base=True), Rule("apache license version 2", "apache-2", base=True), Rule("cc by nc", "cc-by-nc", base=True))

#: Notices, and names that alone say less.
RULES = BASE + (
    Rule("permission is hereby granted free of charge to any person obtaining a copy", "mit"), Rule("the mit license", "mit", 0.6), Rule("mit licensed", "mit", 0.6),
    Rule("apache software license version 2", "apache-2"), Rule("apache 2 0 license", "apache-2", 0.6),
    Rule("gnu general public license version 3", "gpl-3"), Rule("gnu general public license version 2", "gpl-2"), Rule("gnu gpl version 3", "gpl-3"), Rule("gnu gpl version 2", "gpl-2"),
    Rule("gnu lesser general public license version 3", "lgpl-3"), Rule("gnu lesser general public license version 2 1", "lgpl-2.1"),
    Rule("gnu affero general public license version 3", "agpl-3"), Rule("gnu affero general public license", "agpl", 0.6), Rule("gnu general public license", "gpl", 0.6),
    Rule("mozilla public license version 2 0", "mpl-2"), Rule("mozilla public license v 2 0", "mpl-2"), Rule("eclipse public license", "epl", 0.6),
    Rule("redistribution and use in source and binary forms with or without modification are permitted", "bsd"), Rule("3 clause bsd license", "bsd-3-clause"), Rule("2 clause bsd license", "bsd-2-clause"),
    Rule("boost software license version 1 0", "bsl-1"), Rule("isc license", "isc", 0.6), Rule("free and unencumbered software released into the public domain", "unlicense"),
    Rule("creative commons attribution noncommercial", "cc-by-nc"), Rule("creative commons attribution sharealike", "cc-by-sa"), Rule("cc by sa", "cc-by-sa"), Rule("cc by nd", "cc-by-nd"), Rule("cc by nc sa", "cc-by-nc-sa"),
    Rule("cc by nc nd", "cc-by-nc-nd"), Rule("cc0 1 0 universal", "cc0"), Rule("licensed under cc by 4 0", "cc-by"), Rule("creative commons attribution 4 0", "cc-by"),
)

TAG, PLAIN_TAG = "spdx license identifier", "license"

#: Labels that ask for little more than to be named.
PERMISSIVE = frozenset("0bsd apache-2 bsd bsd-2-clause bsd-3-clause bsl-1 cc-by cc0 isc mit unlicense zlib".split())

#: Families of licence identifiers that are known without a tag of their own.
KNOWN = re.compile(r"(0bsd|agpl|apache|artistic|bsd|bsl|cc|cc0|cddl|epl|eupl|gpl|isc|lgpl|mit|mpl|ms-pl|ms-rl|ofl|python|unlicense|wtfpl|zlib|zpl)(-.*)?")

WORD, GAP = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 0x20

#: Bytes to bytes: A-Z to a-z, digits, a-z and all of UTF-8's other bytes stay, the rest ends a word.
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else GAP for b in range(256))


def spaced(text: bytes) -> tuple[bytes, np.ndarray]:
    """The words with single blanks around them, and where each of these bytes stands in the text (from 1; the outer blanks: its ends)."""
    plain = np.frombuffer(b" " + text.translate(_PLAIN) + b" ", dtype=np.uint8)
    keep = plain != GAP
    keep[1:] |= plain[:-1] != GAP
    keep[0] = True
    at = np.flatnonzero(keep)
    return plain[at].tobytes(), at


# -- expressions ----------------------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.:+-]*))")
_BINDS = {"or": 1, "and": 2, "with": 3}


def label_of(identifier: str) -> str:
    """An identifier without what says `only` or `or later`, a final `.0` and the versions of Creative Commons: GPL-3.0-or-later is gpl-3."""
    out = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    if out.startswith("cc"):
        return re.sub(r"-[0-9.]+(-[a-z]+)?$", "", out)
    return re.sub(r"\.0$", "", out)


@dataclass(frozen=True)
class Expression:
    text: str  # operators in capitals, brackets where the parser needs them
    labels: frozenset[str]
    permitted: bool


#: A value of the parser: its text (a string, or texts to be joined), whether permitted licences meet it, how strongly its operator binds.
_Value = tuple[object, bool, int]
_OPERAND = 4


def _joined(operator: str, left: _Value, right: _Value) -> _Value:
    binds = _BINDS[operator]
    shown = [x[0] if x[2] >= binds else ("(", x[0], ")") for x in (left, right)]
    permitted = left[1] if operator == "with" else left[1] or right[1] if operator == "or" else left[1] and right[1]
    return (shown[0], f" {operator.upper()} ", shown[1]), permitted, binds


def _text(tree: object) -> str:
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo.extend(reversed(x))
    return "".join(out)


def parse(text: str, permitted: Iterable[str] = PERMISSIVE) -> Expression | None:
    """The expression at the start of `text`, as far as it is valid: two stacks, one of values and one of operators."""
    allowed, values, operators, labels = frozenset(permitted), [], [], set()

    def reduce_to(binds: int) -> None:
        while operators and operators[-1] != "(" and _BINDS[operators[-1]] >= binds:
            right = values.pop()
            values.append(_joined(operators.pop(), values.pop(), right))

    at, operand, depth, valid = 0, True, 0, 0  # operand: one is due; valid: where the longest valid beginning ends
    while found := _TOKEN.match(text, at):
        bracket, word = found.groups()
        low, end, after_with = word.lower() if word else bracket, found.end(), operators[-1:] == ["with"]
        if bracket == "(":
            if not operand or after_with:
                break
            operators.append("(")
            depth += 1
        elif bracket == ")":
            if operand or not depth:
                break
            reduce_to(0)
            operators.pop()
            depth -= 1
        elif low in _BINDS:
            if operand or (low == "with" and (after_with or values[-1][2] != _OPERAND)):
                break
            reduce_to(_BINDS[low])
            operators.append(low)
            operand = True
        elif operand:
            name = word.rstrip(".:")
            if not after_with:
                labels.add(label_of(name))
            values.append((name, label_of(name) in allowed, _OPERAND))
            operand, end = False, found.start(2) + len(name)
        else:
            break
        at = end
        if not operand and not depth:
            valid = at
        if word and end < found.end():
            break
    if not valid:
        return None
    if at != valid:
        return parse(text[:valid], allowed)
    reduce_to(0)
    return Expression(_text(values[0][0]), frozenset(labels), values[0][1])


# -- texts ------------------------------------------------------------------------------------------------------------------------------

_SPDX_HEAD, _PLAIN_HEAD = re.compile(rb"[ \t]*:[ \t]*[\"']?"), re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"']?")


def automaton(rules: Iterable[Rule] = RULES):
    """Aho-Corasick over the phrases and tags, each between blanks."""
    import ahocorasick

    held: dict[str, list[Rule | str]] = {}
    for x in [*rules, TAG, PLAIN_TAG]:
        held.setdefault(f" {x if isinstance(x, str) else x.phrase} ", []).append(x)
    out = ahocorasick.Automaton()
    for phrase, own in held.items():
        out.add_word(phrase, (phrase.count(" ") - 1, own))
    out.make_automaton()
    return out


def scan_text(text: bytes, machine, permitted: frozenset[str] = PERMISSIVE) -> tuple[int, list[tuple], list[tuple]]:
    """The number of words; matches (first word, words, label, strength, base); expressions (first word of the tag, text, labels, permitted)."""
    words, at = spaced(text)
    matches, expressions, blanks, seen = [], [], 0, 0
    for end, (size, own) in machine.iter(words.decode("latin-1")):
        blanks += words.count(b" ", seen, end + 1)
        seen, first = end + 1, blanks - 1 - size
        for x in own:
            if isinstance(x, Rule):
                matches.append((first, size, x.label, x.strength, x.base))
            elif found := _behind(text, int(at[end]) - 1, x, permitted):
                expressions.append((first, found.text, sorted(found.labels), found.permitted))
    return words.count(b" ") - 1, matches, expressions


def _behind(text: bytes, at: int, tag: str, permitted: frozenset[str]) -> Expression | None:
    """The expression behind a tag that ends at a place of the text."""
    head = (_SPDX_HEAD if tag == TAG else _PLAIN_HEAD).match(text, at)
    if not head:
        return None
    stop = text.find(b"\n", head.end())
    found = parse(text[head.end() : stop if stop >= 0 else len(text)].decode("latin-1"), permitted)
    return found if found and (tag == TAG or all(KNOWN.fullmatch(x) for x in found.labels)) else None


MATCH = "struct<word: long, words: int, label: string, strength: double, base: boolean>"
EXPRESSION = "struct<word: long, text: string, labels: array<string>, permitted: boolean>"


def scan(docs: DataFrame, rules: Iterable[Rule] = RULES, permitted: Iterable[str] = PERMISSIVE) -> DataFrame:
    """doc_id, n_words, matches, expressions: all places of all phrases, and all expressions behind tags."""
    rules, allowed = tuple(rules), frozenset(permitted)
    match = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int32()), ("label", pa.string()), ("strength", pa.float64()), ("base", pa.bool_())]))
    expression = pa.list_(pa.struct([("word", pa.int64()), ("text", pa.string()), ("labels", pa.list_(pa.string())), ("permitted", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(rules)
        names = [[f.name for f in t.value_type] for t in (match, expression)]
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                found = [scan_text(t, machine, allowed) for t in as_bytes(part.column("text"))]
                lists = [[[dict(zip(n, x)) for x in f[i]] for f in found] for i, n in ((1, names[0]), (2, names[1]))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([f[0] for f in found], pa.int64()), pa.array(lists[0], match), pa.array(lists[1], expression)], ["doc_id", "n_words", "matches", "expressions"])

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, n_words long, matches array<{MATCH}>, expressions array<{EXPRESSION}>")


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions (canonical, joined by `; `), permitted (all expressions are; null
    without any)."""
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base = F.filter("matches", lambda m: m["base"])
    said = F.flatten(F.transform("expressions", lambda e: F.transform(e["labels"], lambda x: F.struct(x.alias("label"), F.lit(1.0).alias("strength")))))
    evidence = F.concat(F.transform("matches", lambda m: F.struct(m["label"].alias("label"), m["strength"].alias("strength"))), said)
    labels = F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["label"])))
    strongest = lambda x: F.array_max(F.transform(F.filter("evidence", lambda e: e["label"] == x), lambda e: e["strength"]))
    score = F.lit(1.0) - F.aggregate("all", F.lit(1.0), lambda left, x: left * (F.lit(1.0) - strongest(x)))
    out = scanned.withColumns({"base": base, "evidence": F.array_distinct(evidence)}).withColumn("all", labels)
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(F.col("base.word")).alias("first_word"), F.array_max(F.col("base.word")).alias("last_word"),
        listed(F.col("base.label")).alias("base_labels"), F.array_join("all", ",").alias("labels"), score.alias("score"), F.array_join(F.col("expressions.text"), "; ").alias("expressions"),
        F.when(F.size("expressions") > 0, F.forall("expressions", lambda e: e["permitted"])).alias("permitted"),
    )


def op12_license_scan(spark, sf_dir: str) -> DataFrame:
    return summary(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
