"""Keyword in context."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PatternError, check_pattern, java_pattern, literal_pattern
from ..plans.staging import ship

#: Pairs of code points that are no characters. While a row is taken apart a pair that its text doesn't hold marks the matches, so no text is altered.
MARKS = [(chr(c), chr(c + 1)) for c in range(0xFDD0, 0xFDF0, 2)]


def query_pattern(query: str, match: str = "fixed", whole_word: bool = False, case_sensitive: bool = False) -> str:
    """The Java pattern of a query: fixed text, a glob (`*` anything, `?` one character) or a regular expression."""
    if match == "fixed":
        body = literal_pattern(query)
        if whole_word and query:
            body = _edge(query[0], True) + body + _edge(query[-1], False)
    elif match == "glob":
        body = "".join("(?s:.*)" if c == "*" else "(?s:.)" if c == "?" else literal_pattern(c) for c in query)
    elif match == "regex":
        body = java_pattern(query)[0]
    else:
        raise ValueError(f"unknown match type: {match}")
    return body if case_sensitive else "(?iu)" + body


def _edge(c: str, before: bool) -> str:
    """An ASCII word boundary beside a known character."""
    inner = c.isascii() and (c.isalnum() or c == "_")
    look = "<" if before else ""
    return f"(?{look}{'!' if inner else '='}[A-Za-z0-9_])"


def search(docs: DataFrame, query: str, match: str = "fixed", whole_word: bool = False, case_sensitive: bool = False, window: int = 5) -> DataFrame:
    """source, line_no, match_no, speaker, left, keyword, right of every match; only rows with a match are taken apart.

    The engine finds and marks the matches; a worker finds a marked text's words once and cuts each window from it, so a text with many matches costs as much as what it returns. A pattern that
    doesn't compile raises PatternError before anything runs.
    """
    pattern = query_pattern(query, match, whole_word, case_sensitive)
    if problem := check_pattern(docs.sparkSession, pattern):
        raise PatternError(problem)
    if query == "":
        pattern = "(?!)"
    rows = docs.select("source", "line_no", "speaker", F.coalesce("text", F.lit("")).alias("text")).where(F.col("text").rlike(pattern))
    free = [F.when(~F.contains("text", F.lit(a)) & ~F.contains("text", F.lit(b)), F.lit(a + b)) for a, b in MARKS]
    rows = rows.withColumn("marks", F.coalesce(*free, F.raise_error(F.lit("a text holds one of each pair of marks")).cast("string")))
    marked = F.regexp_replace("text", F.lit(pattern), F.concat(F.left("marks", F.lit(1)), F.lit("$0"), F.right("marks", F.lit(1))))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = f"source {kinds['source']}, line_no {kinds['line_no']}, match_no int, speaker {kinds['speaker']}, left string, keyword string, right string"
    ship(docs.sparkSession)
    return rows.select("source", "line_no", "speaker", "marks", marked.alias("marked")).mapInArrow(_cut(window or 5), out)


#: Characters of results that a worker holds at once; a text without white space gives whole texts as windows.
HELD = 1 << 22

_WORD = re.compile("[^\t\n\x0b\x0c\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")


def windows(marked: str, marks: str, count: int) -> Iterator[tuple[int, str, str, str]]:
    """match_no, left, keyword, right of each marked match that isn't empty: up to `count` words on either side, those that the match cuts included."""
    first, *parts = marked.split(marks[0])
    plain, spans = [first], []
    at = len(first)
    for part in parts:
        keyword, rest = part.split(marks[1], 1)
        spans.append((at, at + len(keyword)))
        plain += (keyword, rest)
        at += len(keyword) + len(rest)
    text = "".join(plain)
    bounds = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [b[0] for b in bounds], [b[1] for b in bounds]
    for k, (start, end) in enumerate(spans, 1):
        if start < end:
            last, after = bisect_left(starts, start), bisect_right(ends, end)
            left = " ".join(text[starts[i] : min(ends[i], start)] for i in range(max(0, last - count), last))
            right = " ".join(text[max(starts[i], end) : ends[i]] for i in range(after, min(after + count, len(starts))))
            yield k, left, text[start:end], right


def _cut(count: int):
    names = ["source", "line_no", "speaker"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found, held = [], [], 0

            def filled() -> pa.RecordBatch:
                source, line_no, speaker = (batch.column(c).take(pa.array(row, pa.int32())) for c in names)
                no, left, keyword, right = (pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.string(), pa.string(), pa.string())))
                return pa.RecordBatch.from_arrays([source, line_no, no, speaker, left, keyword, right], ["source", "line_no", "match_no", "speaker", "left", "keyword", "right"])

            for k in range(batch.num_rows):
                for one in windows(batch.column("marked")[k].as_py(), batch.column("marks")[k].as_py(), count):
                    row.append(k)
                    found.append(one)
                    held += len(one[1]) + len(one[2]) + len(one[3]) + 64
                    if held > HELD:
                        yield filled()
                        row, found, held = [], [], 0
            if found:
                yield filled()

    return run


def sort_rows(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Document and match order, or the locale order of one side."""
    keys = ["source", "line_no", "match_no"]
    return rows.orderBy(*([F.expr(f"collate(`{by}`, 'UNICODE')")] if by else []), *keys)

