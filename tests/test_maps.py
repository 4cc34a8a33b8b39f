from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from verbarium.operators import density as D
from verbarium.plans import ranking


def test_kernel_is_a_box_three_times():
    for r in range(5):
        want = Counter()
        for a in range(-r, r + 1):
            for b in range(-r, r + 1):
                for c in range(-r, r + 1):
                    want[a + b + c] += 1
        assert D.kernel(r) == [want[k] for k in range(-3 * r, 3 * r + 1)]
    assert [D.box_radius(math.sqrt(r * (r + 1))) for r in range(6)] == list(range(6)) and D.box_radius(0) == 0


def test_density_against_brute_force(spark):
    r = random.Random(3)
    points = [(r.uniform(-5, 70), r.uniform(0, 50), r.choice([1, 2, 3])) for _ in range(200)] + [(20.0, 20.0, 50)] * 40
    cells = D.binned(spark.createDataFrame(points, "x double, y double, w int"), F.col("x"), F.col("y"), F.col("w"), size=(64, 48), cell=4)
    inside = [(int(x // 4), int(y // 4), w) for x, y, w in points if 0 <= x < 64 and 0 <= y < 48]
    want = defaultdict(float)
    kx, ky = D.kernel(2), D.kernel(1)
    for cx, cy, w in inside:
        for a, n in enumerate(kx):
            for b, m in enumerate(ky):
                want[cx + a - 6, cy + b - 3] += w * n * m / (5**3 * 3**3)
    got = {(q.cell_x, q.cell_y): q.density for q in D.density(cells, 2, 1, counts=True).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    assert math.isclose(D.density(cells, 2, 1).agg(F.sum("density")).first()[0], 1)
    assert D.density(cells, 0, 0, counts=True).count() == len({p[:2] for p in inside})


def test_bandwidth_of_the_reference_rule(spark):
    values = [float(k % 17) for k in range(500)]
    mean = sum(values) / 500
    dev = math.sqrt(sum((v - mean) ** 2 for v in values) / 499)
    q = sorted(values)
    assert math.isclose(D.bandwidth(spark.createDataFrame([(v,) for v in values], "v double"), "v"), 1.06 * min(dev, (q[375] - q[124]) / 1.34) * 500**-0.2, rel_tol=1e-9)
    one = spark.createDataFrame([(3.0,)], "v double")
    assert D.bandwidth(one, "v") == 1.06 * 3 and D.bandwidth(one.limit(0), "v") == 0


def brute_rings(values, level):
    """Rings by walking from square to square, in plain Python."""
    v = defaultdict(float, values)
    links, place = {}, {}
    corner = [(0, 0), (1, 0), (1, 1), (0, 1)]
    for x, y in {(cx - dx, cy - dy) for cx, cy in values for dx, dy in corner}:
        at = [(x + dx, y + dy) for dx, dy in corner]
        inside = [v[p] >= level for p in at]
        for k in range(4):
            if inside[k] and not inside[(k + 1) % 4]:
                back = k
                while inside[back]:
                    back = (back - 1) % 4
                ends = []
                for side in (k, back):
                    p, q = sorted([at[side], at[(side + 1) % 4]])
                    t = (level - v[p]) / (v[q] - v[p])
                    key = (p[0] + q[0], p[1] + q[1])
                    place[key] = (p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1]))
                    ends.append(key)
                links[ends[0]] = ends[1]
    rings, left = [], set(links)
    while left:
        start = min(left)
        ring, node = [], start
        while node in left:
            left.remove(node)
            ring.append(place[node])
            node = links[node]
        assert node == start
        rings.append((start, ring))
    return rings


def test_contours_against_brute_force(spark):
    r = random.Random(8)
    values = {(x, y): float(r.randrange(6)) for x in range(12) for y in range(9) if r.random() < 0.8}  # many saddles, holes and borders
    grid = spark.createDataFrame([(x, y, d) for (x, y), d in values.items()], "cell_x long, cell_y long, density double")
    levels = [1.5, 3.0, 4.2]
    got = defaultdict(list)
    for q in D.contours(grid, levels).collect():
        got[q.level, q.ring].append((q.seq, q.x, q.y))
    want = {(level, f"{k[0]},{k[1]}"): ring for level in levels for k, ring in brute_rings(values, level)}
    assert got.keys() == want.keys() and len(want) > 10
    for key, ring in want.items():
        own = sorted(got[key])
        assert [s for s, _, _ in own] == list(range(len(ring)))
        assert all(math.isclose(a, c) and math.isclose(b, d) for (_, a, b), (c, d) in zip(own, ring))


def test_rings_and_holes(spark):
    disc = lambda x, y: float(6 <= (x - 10) ** 2 + (y - 10) ** 2 < 30)
    grid = spark.createDataFrame([(x, y, disc(x, y)) for x in range(20) for y in range(20)], "cell_x long, cell_y long, density double")
    rows = sorted((p.area, p.corners) for p in D.polygons(D.contours(grid, [0.5])).collect())
    assert len(rows) == 2 and rows[0][0] < 0 < rows[1][0]  # a hole is walked the other way
    assert D.contours(grid.limit(0), [0.5]).count() == 0 and D.contours(grid, []).count() == 0
    assert D.levels(grid, 3) == [0.25, 0.5, 0.75] and D.levels(grid.limit(0)) == [] == D.levels(grid.where("density = 0"))


def test_chains(spark):
    chains = [list(range(0, 700)), [1000], [2000, 2001], list(range(5000, 5033))]
    links = [(n, c[k + 1] if k + 1 < len(c) else None, n % 3) for c in chains for k, n in enumerate(c)]
    df = spark.createDataFrame(links, "node long, next long, w long").repartition(3)
    want = {n: (len(c) - 1 - k, sum(m % 3 for m in c[k + 1 :]), c[-1]) for c in chains for k, n in enumerate(c)}
    assert {r.node: (r.after, r.last) for r in ranking.list_rank(df).collect()} == {n: (a, e) for n, (a, _, e) in want.items()}
    assert {r.node: r.after for r in ranking.list_rank(df, "w").collect()} == {n: s for n, (_, s, _) in want.items()}
    assert ranking.list_rank(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ranking.list_rank(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, next long"))


def test_rings(spark):
    r = random.Random(2)
    names = r.sample(range(1000), 150)
    rings = [names[:1], names[1:3], names[3:20], names[20:84], names[84:150]]
    df = spark.createDataFrame([(c[k], c[(k + 1) % len(c)]) for c in rings for k in range(len(c))], "node long, next long")
    got = {q.node: (q.head, q.seq) for q in ranking.ring_order(df).collect()}
    assert got == {n: (min(c), (k - c.index(min(c))) % len(c)) for c in rings for k, n in enumerate(c)}
