"""Densities over a map's pixels and their contours.

Points are counted into cells first (one row for each cell and task moves), so all that follows is as large as the image, not as the table. The kernel is a box applied three times along each axis,
that is a piecewise quadratic close to a Gaussian; being separable it is two stencils, each an explode of a cell's weight over the kernel's offsets and a sum. Contours are marching squares: a row for
each square of four cells and level, its segments by case, and segments joined to rings where one ends and the next begins, by pointer jumping.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import ring_order

CELL, LEVELS = 4, 10


def kernel(radius: int) -> list[int]:
    """How often three boxes of 2 * radius + 1 cells reach each offset from -3 * radius to 3 * radius."""
    out = [1]
    for _ in range(3):
        out = [sum(out[max(0, k - 2 * radius) : k + 1]) for k in range(len(out) + 2 * radius)]
    return out


def box_radius(bandwidth: float) -> int:
    """The radius of the box whose variance, taken three times, comes closest to a bandwidth's: r (r + 1) is its square."""
    return math.floor((math.sqrt(4 * bandwidth * bandwidth + 1) - 1) / 2 + 0.5)


def bandwidth(points: DataFrame, column: str) -> float:
    """The normal reference rule: 1.06 times the lesser of deviation and quartile range / 1.34, over the fifth root of the number of points."""
    r = points.agg(F.stddev_samp(column).alias("dev"), F.percentile_approx(column, [0.25, 0.75], F.lit(10_000)).alias("q"), F.count(column).alias("n"), F.first(column, True).alias("one")).first()
    if not r.n:
        return 0.0
    spread = min(r.dev or 0.0, (r.q[1] - r.q[0]) / 1.34) or r.dev or abs(r.one) or 1.0
    return 1.06 * spread * r.n**-0.2


def binned(points: DataFrame, x: Column, y: Column, weight: Column, size: tuple[int, int] | None = None, cell: int = CELL) -> DataFrame:
    """cell_x, cell_y, weight of the cells that have points; inside an image of `size` pixels, if given."""
    named = points.select(x.alias("x"), y.alias("y"), weight.cast("double").alias("weight"))
    if size:
        named = named.where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < size[0]) & (F.col("y") < size[1]))
    return named.groupBy(F.floor(F.col("x") / cell).alias("cell_x"), F.floor(F.col("y") / cell).alias("cell_y")).agg(F.sum("weight").alias("weight"))


def _along(cells: DataFrame, axis: str, radius: int) -> DataFrame:
    if not radius:
        return cells
    other = "cell_y" if axis == "cell_x" else "cell_x"
    offsets = F.array(*[F.struct(F.lit(k - 3 * radius).alias("by"), F.lit(n).cast("double").alias("n")) for k, n in enumerate(kernel(radius))])
    spread = cells.select(F.col(axis).alias("at"), other, "weight", F.explode(offsets).alias("o"))
    return spread.groupBy((F.col("at") + F.col("o.by")).alias(axis), other).agg(F.sum(F.col("weight") * F.col("o.n")).alias("weight"))


def density(cells: DataFrame, radius_x: int, radius_y: int, counts: bool = False) -> DataFrame:
    """cell_x, cell_y, density of all cells that the kernel reaches. The densities add up to one, or to the sum of weights with `counts`. Weights that are whole numbers are
    added exactly before they are scaled."""
    smooth = _along(_along(cells, "cell_x", radius_x), "cell_y", radius_y)
    scale = F.lit(float((2 * radius_x + 1) ** 3 * (2 * radius_y + 1) ** 3))
    if counts:
        return smooth.select("cell_x", "cell_y", (F.col("weight") / scale).alias("density"))
    total = cells.agg(F.sum("weight").alias("total"))
    return smooth.join(F.broadcast(total)).select("cell_x", "cell_y", (F.col("weight") / (scale * F.col("total"))).alias("density"))


def levels(grid: DataFrame, count: int = LEVELS) -> list[float]:
    """Equally spaced levels between zero (or the least density, if below) and the greatest, both left out."""
    r = grid.agg(F.min("density").alias("low"), F.max("density").alias("high")).first()
    if r.high is None:
        return []
    low = min(r.low, 0.0)
    return [low + (r.high - low) * (k + 1) / (count + 1) for k in range(count)] if r.high > low else []


#: Sides of a square: (twice the crossing's place relative to its first corner, corner, corner). Corners: 0 at (0, 0), 1 at (1, 0), 2 at (1, 1), 3 at (0, 1).
_SIDES = {"top": ((1, 0), 0, 1), "right": ((2, 1), 1, 2), "bottom": ((1, 2), 3, 2), "left": ((0, 1), 0, 3)}


def _case_segments() -> dict[int, list[tuple[str, str]]]:
    """From the corners that reach a level (bit k: corner k) to segments, what reaches it on the right as y grows downwards. They follow from walking around the square: where a walk leaves
    the corners that reach the level a segment begins, and it ends where the walk came to them; opposite corners are kept apart."""
    around = ["top", "right", "bottom", "left"]  # side k lies between corners k and k + 1
    out = {}
    for case in range(1, 15):
        inside = [bool(case >> k & 1) for k in range(4)]
        leaving = [k for k in range(4) if inside[k] and not inside[(k + 1) % 4]]
        found = []
        for k in leaving:
            back = k
            while inside[back]:
                back = (back - 1) % 4
            found.append((around[k], around[back]))
        out[case] = found
    return out


def segments(grid: DataFrame, at: list[float]) -> DataFrame:
    """level, from_x, from_y, x0, y0, to_x, to_y, x1, y1: directed pieces of contours. from and to name the crossed sides (twice their places, whole numbers), x and y
    are interpolated places in cells. Beyond the given cells the density is zero, so all contours close."""
    corner = [(0, 0), (1, 0), (1, 1), (0, 1)]
    squares = F.array(*[F.struct((F.col("cell_x") - dx).alias("x"), (F.col("cell_y") - dy).alias("y"), F.lit(k).alias("c")) for k, (dx, dy) in enumerate(corner)])
    four = grid.select("density", F.explode(squares).alias("s")).groupBy("s.x", "s.y").agg(*[F.coalesce(F.max(F.when(F.col("s.c") == k, F.col("density"))), F.lit(0.0)).alias(f"v{k}") for k in range(4)])
    rows = four.withColumn("level", F.explode(F.array(*map(F.lit, at)).cast("array<double>"))).where("level > 0")
    case = sum((F.when(F.col(f"v{k}") >= F.col("level"), 1 << k).otherwise(0) for k in range(1, 4)), F.when(F.col("v0") >= F.col("level"), 1).otherwise(0))
    rows = rows.withColumn("case", case).where("case BETWEEN 1 AND 14")

    def crossing(side: str) -> Column:
        (ex, ey), a, b = _SIDES[side]
        t = (F.col("level") - F.col(f"v{a}")) / (F.col(f"v{b}") - F.col(f"v{a}"))
        (ax, ay), (bx, by) = corner[a], corner[b]
        x, y = F.col("x") + (F.lit(float(ax)) + t * float(bx - ax)), F.col("y") + (F.lit(float(ay)) + t * float(by - ay))
        return F.struct((2 * F.col("x") + ex).alias("ex"), (2 * F.col("y") + ey).alias("ey"), x.alias("x"), y.alias("y"))

    found = F.lit(None)
    for k, pairs in _case_segments().items():
        found = F.when(F.col("case") == k, F.array(*[F.struct(crossing(a).alias("a"), crossing(b).alias("b")) for a, b in pairs])).otherwise(found)
    return rows.select("level", F.explode(found).alias("s")).select(
        "level", F.col("s.a.ex").alias("from_x"), F.col("s.a.ey").alias("from_y"), F.col("s.a.x").alias("x0"), F.col("s.a.y").alias("y0"), F.col("s.b.ex").alias("to_x"), F.col("s.b.ey").alias("to_y"), F.col("s.b.x").alias("x1"), F.col("s.b.y").alias("y1")
    )


def contours(grid: DataFrame, at: list[float]) -> DataFrame:
    """level, ring, seq, x, y: the corners of closed rings in order, a ring named by the least side that it crosses."""
    cut = segments(grid, at)
    node = lambda p: F.struct("level", F.col(f"{p}_x").alias("ex"), F.col(f"{p}_y").alias("ey"))
    placed = ring_order(cut.select(node("from").alias("node"), node("to").alias("next")))
    places = cut.select(node("from").alias("node"), "x0", "y0")
    ring = F.concat_ws(",", F.col("head.ex").cast("string"), F.col("head.ey").cast("string"))
    return placed.join(places, "node").select(F.col("node.level").alias("level"), ring.alias("ring"), "seq", F.col("x0").alias("x"), F.col("y0").alias("y"))


def polygons(rings: DataFrame) -> DataFrame:
    """level, ring, corners, area (twice the signed area halved: holes are negative, as they are walked the other way)."""
    ahead = rings.select("level", "ring", (F.col("seq") - 1).alias("seq"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    size = rings.groupBy("level", "ring").agg(F.max("seq").alias("most"))
    first = rings.where("seq = 0").join(size, ["level", "ring"]).select("level", "ring", F.col("most").alias("seq"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    pairs = rings.join(ahead.where("seq >= 0").unionByName(first), ["level", "ring", "seq"])
    return pairs.groupBy("level", "ring").agg(F.count(F.lit(1)).alias("corners"), (F.sum(F.col("x") * F.col("y1") - F.col("x1") * F.col("y")) / 2).alias("area"))
