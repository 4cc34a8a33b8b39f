from __future__ import annotations

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verbarium.operators import concordance, text_index

SCHEMA = "source string, line_no long, speaker string, text string"


def plain(text, spans, count):
    """Windows by splitting the whole text at each match."""
    space = "[\t\n\x0b\x0c\r \xa0  -     　﻿]+"
    cut = lambda s: [w for w in re.split(space, s) if w]
    return [(k, " ".join(cut(text[:a])[-count:]), text[a:b], " ".join(cut(text[b:])[:count])) for k, (a, b) in enumerate(spans, 1) if a < b]


@settings(max_examples=300, deadline=None)
@given(st.text("ab é\n　\xa0x", max_size=40), st.sampled_from(["a", "ab", "b|", " a", "x*", "[ab]+", " ", "é"]), st.integers(1, 4))
def test_windows_against_plain_splitting(text, pattern, count):
    spans = [m.span() for m in re.finditer(pattern, text)]
    marked = re.sub(pattern, lambda m: f"﷐{m.group()}﷑", text)
    assert list(concordance.windows(marked, "﷐﷑", count)) == plain(text, spans, count)


def test_dense_matches_take_little_time(spark):
    docs = spark.createDataFrame([("s", 1, None, "ab" * 8000), ("s", 2, "x", "ab " * 100_000), ("s", 3, "x", "none")], SCHEMA)
    concordance.search(docs.where("line_no = 3"), "n").count()  # workers are up
    began = time.time()
    text = "ab" * 8000
    rows = concordance.search(docs.where("line_no = 1"), "a").selectExpr("match_no", "length(left) AS l", "length(right) AS r").collect()
    assert [(r.match_no, r.l, r.r) for r in rows] == [(k + 1, 2 * k, len(text) - 2 * k - 1) for k in range(8000)]
    assert concordance.search(docs, "a").count() == 108_000
    assert time.time() - began < 20  # some seconds on a busy machine; it was minutes


def rows(df):
    return sorted(tuple(r) for r in df.select("source", "line_no", "match_no", "left", "keyword", "right").collect())


@pytest.fixture(scope="module")
def corpus(spark, data):
    odd = [(None, 1, None, None), ("s", 2, "x", ""), ("s", 3, None, "The cat, the CAT; the café-cat cat_2 ẋy"), ("s", 3, None, "The cat, the CAT; the café-cat cat_2 ẋy"), ("s", 4, "y", "ſea and sea and İstanbul istanbul straße STRASSE Kelvin kelvin"),
           ("s", 5, "y", "w" * 500 + " cat"), ("s", 6, "y", "one two " * 5000 + "three"), ("s", 7, "y", "a--b ... !!"), ("s", 8, "y", "cat\nthe * end?")]
    docs = spark.read.parquet(f"{data}/documents.parquet").selectExpr("source", "doc_id AS line_no", "'' AS speaker", "text")
    return spark.createDataFrame(odd, SCHEMA).unionByName(docs).cache()


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    return text_index.build(corpus, f"file://{tmp_path_factory.mktemp('index')}/x", folders=16)


QUERIES = [
    ("cat", {}), ("the cat", {}), ("at, the", {}), ("sea", {}), ("istanbul", {}), ("straße", {}), ("kelvin", {}), ("wwwww cat", {}), ("o three", {}), ("two one", {}), (" cat ", {}), ("ẋy", {}), ("nowhere", {}), ("!!", {}), ("", {}), ("--b", {}), ("ouen", {}),
    ("cat", {"whole_word": True}), ("caf", {"whole_word": True}), ("Cat", {"case_sensitive": True}), ("c?t", {"match": "glob"}), ("the*end", {"match": "glob"}), ("*", {"match": "glob"}), ("th?n*an", {"match": "glob"}), ("t.e c", {"match": "regex"}), ("e", {}),
]


@pytest.mark.parametrize(("query", "options"), QUERIES)
def test_index_gives_the_rows_of_a_scan(corpus, index, query, options):
    assert rows(index.search(query, **options)) == rows(concordance.search(corpus, query, **options))


def pruned(df, column):
    """What Spark reads of a table's folders, by the scan's own filters."""
    return [f for f in re.findall(r"PartitionFilters: \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString()) if f"{column}#" in f]


def test_only_matching_folders_are_read(index):
    texts = index.texts("istanbul")  # a text of ours alone
    assert texts.count() == 1
    assert len(pruned(texts, "part")) == 1
    for query in ("istanbul", " istanbul "):
        terms = index.terms(index.pieces(query, "fixed")[0])
        assert pruned(terms, "folder") and [r.term for r in terms.collect()] == ["istanbul"]
    assert index.candidates("!!") is None and index.candidates("a.b", "regex") is None


def test_positions_in_blocks(index):
    found = {(r.block, len(r.offsets)) for r in index.table("postings").where("term = 'one' AND folder >= 0").join(index.table("texts").where("line_no = 6 AND source = 's'").select("place"), "place").collect()}
    assert found == {(0, 2048), (1, 2048), (2, 904)}
