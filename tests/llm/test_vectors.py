from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbarium.llm import code_compression as C
from verbarium.llm import vector_file as V
from verbarium.llm.vectors import LIMIT, integer_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, place long, x string, cells string, w int, score double, code string, error long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "c", 2, 0.5, "d", 3) for r in rows], SCHEMA)


def odd_rows():
    r = random.Random(5)
    rows = [(k, [r.gauss(0, 0.2) for _ in range(8)], r.randrange(3)) for k in range(0, 900, 3)]
    rows += [(1, [0.5] * 8, 1)] * 30 + [(k, [0.25, -0.25] * 4, k % 3) for k in range(400, 460)]  # a common vector
    rows += [(100, rows[0][1], 0), (200, [0.1] * 8, 2), (200, [0.1] * 8, 2), (300, [0.0] * 8, 0)]  # repeated ids, a zero vector
    rows += [(None, [0.3] * 8, 1), (None, [0.3] * 8, 2), (500, [0.3] * 8, None), (600, None, 1), (700, [0.1, None] * 4, 1), (800, [float("nan")] * 8, 1), (901, [math.inf] * 8, 0)]
    rows += [(1000, [], 1), (1100, [0.5, 0.5], 1), (1200, [-1.0] * 5, 2), (1300, [1e30] + [0.0] * 7, 0)]
    return rows


def integers(rows, scale, width):
    out = []
    for k, v, label in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            x = [max(-LIMIT, min(LIMIT, math.floor(scale * float(np.float32(c))))) for c in v]
            out.append((k, label, x + [0] * (width - len(x))))
    return out


def brute_negatives(rows):
    rows = [(k, (label + 1) % 10 if k is not None and k % 7 == 0 else label, x) for k, label, x in rows if label is not None]
    out, key = [], lambda s: (-s[0], s[1] is None, s[1] or 0)
    for i, (a, label, x) in enumerate(rows):
        if a is None or a % 100:
            continue
        scored = [(sum(p * q for p, q in zip(x, y)), k, other == label) for j, (k, other, y) in enumerate(rows) if j != i]
        for score, positive, _ in sorted((s for s in scored if s[2]), key=key)[:5]:
            inside = sorted((s for s in scored if not s[2] and 30 * score <= 100 * s[0] <= 90 * score), key=key)[:10]
            out += [(a, positive, n + 1, s[1], score, s[0]) for n, s in enumerate(inside)]
    return sorted(out, key=str)


def mined(df, **more):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = V.mine(integer_vectors(df, 256, label), F.col("vec_id") % 100 == 0, **more)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r[n] for n in names) for r in out.collect()), key=str)


def test_negatives_of_odd_rows(spark):
    rows = odd_rows()
    want = brute_negatives(integers(rows, 256, 8))
    assert len(want) > 200
    assert mined(table(spark, rows).repartition(5)) == want
    assert mined(table(spark, rows), cells=3) == want  # loose bounds lose nothing


def test_bounds_enclose_every_score(spark):
    rows = [r for r in odd_rows() if r[0] != 1300]
    vectors = integer_vectors(table(spark, rows), 256).where("label IS NOT NULL")
    edges = V.cell_edges(vectors, 16)
    index = V.approximations(vectors, edges).collect()
    cells, x = (np.array([np.frombuffer(r[c], dtype=k) for r in index]) for c, k in (("cells", np.uint8), ("x", np.int32)))
    anchors = x[::11]
    low, high = V.bounds(V.bound_tables(anchors, edges, np.int64), np.ascontiguousarray(cells.T))
    exact = x.astype(np.int64) @ anchors.T.astype(np.int64)
    assert (low <= exact).all() and (exact <= high).all() and (high - low).mean() < abs(exact).max()


def test_chunks_and_blocks_lose_nothing(spark):
    rows = [r for r in odd_rows() if r[0] != 1300] * 2
    vectors = integer_vectors(table(spark, rows), 256).where("label IS NOT NULL")
    edges = V.cell_edges(vectors, 16)
    index = V.approximations(vectors, edges)
    anchors = index.where("vec_id % 3 = 0").withColumns({"lows": F.array(F.lit(-V.NEVER)), "highs": F.array(F.lit(9000).cast("long"))})  # many blocks
    path = V._written(anchors)
    for same in (True, False):
        got = V.first(V.search(index, path, edges, 4, same, chunk_rows=50), 4)
        held = index.select("place", "vec_id", "label", "x").collect()
        x, label = np.array([np.frombuffer(r.x, dtype=np.int32) for r in held]).astype(np.int64), np.array([r.label for r in held])
        score, want = x @ x.T, []
        for i, a in enumerate(held):
            if a.vec_id is not None and a.vec_id % 3 == 0:
                near = sorted((-score[i, j], held[j].vec_id is None, held[j].vec_id or 0) for j in range(len(held)) if j != i and (label[i] == label[j]) == same and score[i, j] <= 9000)[:4]
                want += [(a.place, n + 1, None if none else k, -s) for n, (s, none, k) in enumerate(near)]
        assert sorted(((r.anchor, r["rank"], r.vec_id, r.score) for r in got.collect()), key=str) == sorted(want, key=str)


def test_only_rows_that_may_enter_a_window_are_scored():
    best = V._Best(np.array([[100], [5]]), np.array([[200], [4]]), 2)
    low, high = np.array([[90, 0], [201, 0], [0, 0]]), np.array([[99, 9], [300, 9], [150, 9]])
    row, anchor = best.meets(low, high)
    assert (row.tolist(), anchor.tolist()) == ([2], [0])  # the second anchor's window is empty
    best.add(np.array([1, 2, 3]), np.zeros(3, dtype=int), np.array([150, 120, 150]), np.array([9, 8, 7]))
    assert best.held[:, 1:3].tolist() == [[150, 7], [150, 9]] and best.least[0, 0] == 150


def test_no_vectors(spark):
    for rows in ([], [(0, None, 1)], [(0, [1.0], None)]):
        assert mined(table(spark, rows)) == []
    assert mined(table(spark, [(0, [], 0), (1, [], 1), (2, [], 2)])) == [(0, 1, 1, 2, 0, 0)]


def brute_codes(rows, entries, rounds, parts=4):
    width = len(rows[0][2])
    each = -(-width // parts)
    rows = [(k, label, x + [0] * (parts * each - width)) for k, label, x in rows]
    pieces = [[tuple(x[p * each : (p + 1) * each]) for p in range(parts)] for _, _, x in rows]
    at = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, [bytes([p]) + np.array(pieces[i][p], dtype="<i4").tobytes() for p in range(parts)]))[:entries]
    books = [[pieces[i][p] for i in at] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        sums = [defaultdict(list) for _ in range(parts)]
        for own in pieces:
            for p in range(parts):
                sums[p][near(p, own[p])[1]].append(own[p])
        books = [[tuple(sum(c) // len(c) for c in zip(*sums[p][j])) if j in sums[p] else e for j, e in enumerate(books[p])] for p in range(parts)]
    coded = [[near(p, own[p]) for p in range(parts)] for own in pieces]
    errors = defaultdict(int)
    for (_, label, _), c in zip(rows, coded):
        errors[label] += sum(d for d, _ in c)
    text = ",".join(str(c) for book in books for e in book for c in e)
    return sorted(((r[0], r[1], tuple(j for _, j in c), sum(d for d, _ in c), errors[r[1]]) for r, c in zip(rows, coded)), key=str), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(("entries", "rounds"), [(16, 4), (1000, 2), (1, 1)])
def test_codes_of_odd_rows(spark, entries, rounds):
    rows = odd_rows()
    out, books = C.compress(integer_vectors(table(spark, rows).repartition(3), 1024), entries=entries, rounds=rounds)
    got = sorted(((r.vec_id, r.label, tuple(r.codes), r.error, r.label_error) for r in out.collect()), key=str)
    assert (got, C.digest(books)) == brute_codes(integers(rows, 1024, 8), entries, rounds)


def test_parts_that_do_not_divide_the_vector(spark):
    rows = [(k, [k / 100, -k / 70, 0.5], k % 2) for k in range(40)]
    out, books = C.compress(integer_vectors(table(spark, rows), 1024), entries=4)
    assert sorted(((r.vec_id, r.label, tuple(r.codes), r.error, r.label_error) for r in out.collect()), key=str) == brute_codes(integers(rows, 1024, 3), 4, 4)[0]
    assert books.shape == (4, 4, 1)


def test_no_codes(spark):
    out, books = C.compress(integer_vectors(table(spark, [(0, None, 1)]), 1024))
    assert out.count() == 0 and C.digest(books) == hashlib.sha256(b"").hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-LIMIT, LIMIT) | st.integers(-3, 3), min_size=2, max_size=2), min_size=1, max_size=9), st.lists(st.lists(st.integers(-LIMIT, LIMIT) | st.integers(-3, 3), min_size=2, max_size=2), min_size=1, max_size=6))
def test_nearest_is_exact(rows, book):
    entry, error = C.nearest(np.array(rows), np.array(book))
    want = [min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book)) for x in rows]
    assert [(int(d), int(j)) for d, j in zip(error, entry)] == want


def test_a_common_part_is_one_row(spark):
    rows = [(k, [0.5] * 8 if k % 3 else [k / 900] * 8, 0) for k in range(300)]
    pieces = C.distinct_pieces(C.cut(integer_vectors(table(spark, rows), 1024)))
    assert pieces.count() == 4 * 101 and {r.weight for r in pieces.collect()} == {1, 200}
