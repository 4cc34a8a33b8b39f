"""Row patterns induced from marked samples: aligned by anti-unification, tried over all lines at once, chosen by description length.

The samples are a few lines that a user has marked, so they are worked on in the driver; the lines they are tried on may be any number.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grammar import compile_row, exact, field_order, gaps_before

#: kind of characters: its pattern, how many there are of them, its height in the lattice (a mark is one character that is no letter, digit or blank)
KINDS = {"blank": (r"[\t ]", 2, 1), "digit": (r"\d", 10, 1), "upper": (r"\p{Lu}", 26, 1), "lower": (r"\p{Ll}", 26, 1), "mark": (r"[^\p{L}\d\s]", 33, 1), "letter": (r"\p{L}", 52, 2), "word": (r"[\p{L}\d]", 62, 3), "black": (r"\S", 95, 4)}
ANY, SKIP, LENGTHS, OPEN, MOST = log2(97), 2.5, 0.5, 3.0, 243


@dataclass(frozen=True)
class Part:
    """A run of one kind: its text where all samples share it, the least and most characters; `may` miss."""

    kind: str
    text: str | None
    low: int
    high: int
    may: bool = False


def parts(text: str) -> list[Part]:
    """The runs of a text; marks stand alone."""
    kind = lambda c: "blank" if c.isspace() else "digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.islower() else "letter" if c.isalpha() else "mark"
    out: list[Part] = []
    for c in text:
        k = kind(c)
        if out and k == out[-1].kind != "mark":
            out[-1] = Part(k, out[-1].text + c, out[-1].low + 1, out[-1].high + 1)
        else:
            out.append(Part(k, c, 1, 1))
    return out


def joined(a: str, b: str) -> str | None:
    """The least kind that holds both; blanks and others have none."""
    if a == b:
        return a
    kinds = {a, b}
    if "blank" in kinds:
        return None
    return "letter" if kinds <= {"upper", "lower", "letter"} else "word" if kinds <= {"upper", "lower", "letter", "digit", "word"} else "black"


def generalised(a: Part, b: Part) -> tuple[Part, float] | None:
    """The least part that covers both, and what it costs."""
    kind = joined(a.kind, b.kind)
    if kind is None:
        return None
    same = a.text is not None and a.text == b.text
    out = Part(kind, a.text if same else None, min(a.low, b.low), max(a.high, b.high), a.may or b.may)
    return out, 0.0 if same else KINDS[kind][2] + LENGTHS * (out.low != out.high)


def unified(a: list[Part], b: list[Part]) -> tuple[list[Part], float]:
    """Two sequences aligned at the least cost; what only one has may miss."""
    best: dict[tuple[int, int], tuple[float, tuple[int, int] | None, Part | None]] = {(0, 0): (0.0, None, None)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = []
            if i:
                ways.append((best[i - 1, j][0] + SKIP * (not a[i - 1].may), (i - 1, j), replace(a[i - 1], may=True)))
            if j:
                ways.append((best[i, j - 1][0] + SKIP, (i, j - 1), replace(b[j - 1], may=True)))
            if i and j and (both := generalised(a[i - 1], b[j - 1])):
                ways.append((best[i - 1, j - 1][0] + both[1], (i - 1, j - 1), both[0]))
            if ways:
                best[i, j] = min(ways, key=lambda w: w[0])
    at, out = (len(a), len(b)), []
    while best[at][1] is not None:
        _, before, part = best[at]
        out.append(part)
        at = before
    return out[::-1], best[len(a), len(b)][0]


def anti_unify(texts: list[str]) -> list[Part]:
    """The parts that cover all texts, longest first."""
    return reduce(lambda one, text: unified(one, parts(text))[0], sorted(texts[1:], key=len, reverse=True), parts(texts[0]))


def pattern_of(ps: list[Part], lifted: bool = False) -> str:
    """The pattern of parts; lifted, lengths are open and shared letters and digits stand for their kind. Blanks are never counted."""
    out = ""
    for p in ps:
        if p.kind == "blank":
            one = r"[\t ]+"
        elif p.text is not None and (not lifted or p.kind == "mark"):
            one = exact(p.text)
        else:
            chars = KINDS[p.kind][0]
            one = f"{chars}+" if lifted or p.low != p.high else chars if p.low == 1 else f"{chars}{{{p.low}}}"
        out += f"(?:{one})?" if p.may else one
    return out


def bits(ps: list[Part], lifted: bool = False) -> float:
    """Bits for each character of a text that the parts describe."""
    size = sum(p.high for p in ps)
    known = lambda p: p.text is not None and (not lifted or p.kind == "mark")
    return sum(p.high * log2(KINDS[p.kind][1]) for p in ps if not known(p)) / size if size else 0.0


def open_lengths(ps: list[Part], lifted: bool = False) -> float:
    """Bits for the lengths that a pattern of these parts leaves open."""
    return OPEN * sum(p.may or p.low != p.high or (lifted and p.kind != "mark") for p in ps)


def candidates(samples: list[dict]) -> list[dict]:
    """Row patterns from samples {line, spans: [{field, start, end}]}, the most special first: {row, bits (of each field a character), open (bits a row for its lengths), cost}.

    Every field but the last is as the samples have it, or with open lengths, or any word; text between fields is as the samples have it, or with blanks that may miss.
    Where fields are so many that their products are over 243, levels go with all fields at once or with one alone.
    """
    order, missing = field_order(samples)
    value = lambda f: [x["line"][s["start"] : s["end"]] for x in samples for s in x["spans"] if s["field"] == f]
    choices = []
    for f in order[:-1]:
        ps = anti_unify(value(f))
        word = r"\d+" if f == "turn" and all(v.isdigit() for v in value(f)) else r"\S+" if f in ("turn", "code", "id", "speaker") or not any(p.kind == "blank" for p in ps) else ".*?"
        choices.append([(pattern_of(ps), bits(ps), open_lengths(ps)), (pattern_of(ps, True), bits(ps, True), open_lengths(ps, True)), (word, log2(10) if word == r"\d+" else ANY, OPEN)])
    between = []
    for f in order:
        ps = anti_unify(gaps_before(samples, f))
        strict = pattern_of(ps)
        between.append([strict, strict.replace(r"[\t ]+", r"[\t ]*")])
    if len(choices) and 3 ** len(choices) * 2 > MOST:
        levels = [[k] * len(choices) for k in range(3)] + [[m if i == j else 0 for i in range(len(choices))] for j in range(len(choices)) for m in (1, 2)]
    else:
        levels = [list(x) for x in product(range(3), repeat=len(choices))]
    out, seen = [], set()
    for loose in (0, 1):
        for level in levels:
            pattern, rate, start, spare = "^", {}, None, 0.0
            for k, f in enumerate(order):
                body, rate[f], more = choices[k][level[k]] if k < len(choices) else (".*", ANY, OPEN)
                spare += more
                one = f"{between[k][loose]}(?<{f}>{body})"
                pattern += f"(?:{one})?" if f in missing else one
                if k == 0 and f == "turn":
                    start = f"^{one}"
            pattern += r"[\t ]*$"
            if pattern not in seen:
                seen.add(pattern)
                out.append({"row": {"pattern": pattern, "flags": "u", "fields": order, **({"rowStart": start + r"(?=[\t .]|$)"} if start else {})}, "bits": rate, "open": spare, "cost": sum(level) + loose})
    return sorted(out, key=lambda c: c["cost"])


def tried(lines: DataFrame, found: list[dict]) -> list[dict]:
    """The candidates with `n` (lines that match) and `length` (bits for all lines): one pass over the lines for all of them.

    A line that matches costs the characters of its fields at their rates, and the lengths that are open; one that doesn't costs any characters. Blank lines cost nothing. A pattern costs its own characters too.
    """
    said = F.coalesce(F.col("line"), F.lit(""))
    size = F.length(said)
    told = []
    for k, c in enumerate(found):
        row = compile_row(c["row"])
        cost = reduce(lambda a, b: a + b, [F.length(F.regexp_extract(said, row.pattern, g)) * F.lit(c["bits"][f]) for f, g in row.fields.items()])
        match = row.matches(said)
        told += [F.sum(F.when(match, 1).otherwise(0)).alias(f"n{k}"), F.sum(F.when(match, cost + F.lit(c["open"])).otherwise(size * F.lit(ANY))).alias(f"l{k}")]
    got = lines.where(said.rlike(r"\S")).agg(*told).first()
    return [{**c, "n": int(got[f"n{k}"] or 0), "length": float(got[f"l{k}"] or 0) + len(c["row"]["pattern"]) * ANY} for k, c in enumerate(found)]


def induce(lines: DataFrame, samples: list[dict]) -> dict:
    """The row whose pattern describes all lines (doc, line_no, line) and itself in the fewest bits; of equals the most special. Without lines it is the samples' own."""
    if not samples:
        raise ValueError("no samples")
    every = tried(lines, candidates(samples))
    return min(every, key=lambda c: (c["length"], c["cost"]))["row"]


def regions(parsed: DataFrame) -> DataFrame:
    """doc, line_no, region, marker: what a saved grammar takes each line for, from grammar.parse; where it has no pattern the region alone is known."""
    return parsed.select("doc", "line_no", F.substring_index("role", ":", 1).alias("region"), F.col("role").endswith(":marker").alias("marker"))
