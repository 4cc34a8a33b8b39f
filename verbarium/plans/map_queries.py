"""Registered queries over maps: densities and contours, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts, density
from .staging import stage

QUERIES: dict = {}
SQL: dict[str, str] = {}

ZOOM, RADIUS = 3, 2

_DENSITY = f"""
p AS (SELECT c_acctbal / 120 - 30 AS la, CAST(c_custkey * 37 % 170 AS DOUBLE) AS lo, CAST(CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE c_custkey % 4 END AS DOUBLE) AS weight FROM customer WHERE c_custkey % 7 <> 0),
m AS (SELECT weight, floor((lo + 180) / 360 * 2048 * 100 + 0.5) / 100 AS x, floor((1 - ln(tan(radians(la)) + 1 / cos(radians(la))) / pi()) / 2 * 2048 * 100 + 0.5) / 100 AS y FROM p),
c AS (SELECT CAST(floor(x / 32) AS BIGINT) AS cx, CAST(floor(y / 32) AS BIGINT) AS cy, sum(weight) AS weight FROM m GROUP BY ALL),
k1 AS (SELECT unnest([-2, -1, 0, 1, 2]) AS o),
k AS (SELECT a.o + b.o + c.o AS o, count(*) AS n FROM k1 a, k1 b, k1 c GROUP BY ALL),
d AS (
  SELECT cx + a.o AS cell_x, cy + b.o AS cell_y, sum(weight * a.n * b.n) / (125.0 * 125.0 * (SELECT sum(weight) FROM c)) AS density FROM c, k a, k b GROUP BY ALL)"""

#: Marching squares by cases, in SQL. A side is named by twice its place.
_SEGMENTS = """
l AS (SELECT max(density) * (unnest(range(10)) + 1) / 11 AS level FROM d),
s AS (SELECT x, y, max(CASE WHEN k = 0 THEN density ELSE 0 END) AS a, max(CASE WHEN k = 1 THEN density ELSE 0 END) AS b, max(CASE WHEN k = 2 THEN density ELSE 0 END) AS c, max(CASE WHEN k = 3 THEN density ELSE 0 END) AS e
  FROM (SELECT cell_x - dx AS x, cell_y - dy AS y, k, density FROM d, (VALUES (0, 0, 0), (1, 0, 1), (1, 1, 2), (0, 1, 3)) t(dx, dy, k)) GROUP BY x, y),
q AS (
  SELECT *, (a >= level)::INT + 2 * (b >= level)::INT + 4 * (c >= level)::INT + 8 * (e >= level)::INT AS shape,
         [{ex: 2 * x + 1, ey: 2 * y, px: x + (0.0 + (level - a) / (b - a)), py: y + 0.0}, {ex: 2 * x + 2, ey: 2 * y + 1, px: x + 1.0, py: y + (0.0 + (level - b) / (c - b))},
          {ex: 2 * x + 1, ey: 2 * y + 2, px: x + (0.0 + (level - e) / (c - e)), py: y + 1.0}, {ex: 2 * x, ey: 2 * y + 1, px: x + 0.0, py: y + (0.0 + (level - a) / (e - a))}] AS side
  FROM s, l),
g AS (
  SELECT level, side[f] AS f, side[t] AS t FROM q JOIN (VALUES (1, 1, 4), (2, 2, 1), (3, 2, 4), (4, 3, 2), (5, 1, 4), (5, 3, 2), (6, 3, 1), (7, 3, 4), (8, 4, 3), (9, 1, 3), (10, 2, 1), (10, 4, 3), (11, 2, 3), (12, 4, 2), (13, 1, 2), (14, 4, 1)) w(shape, f, t) USING (shape))"""


def _grid(spark, d):
    """Customers placed by their keys and balances; some have no place, some no weight."""
    key = F.col("c_custkey")
    places = spark.read.parquet(f"{d}/customer.parquet").select(F.when(key % 7 != 0, F.col("c_acctbal") / 120 - 30).alias("lat"), (key * 37 % 170).alias("lon"), (key % 4).alias("w"))
    points, _ = charts.map_points(places, "lat", "lon", "w")
    x, y = charts.mercator(F.col("latitude"), F.col("longitude"), ZOOM)
    return density.density(density.binned(points, x, y, F.col("weight"), cell=32), RADIUS, RADIUS)


def map_density(spark, d):
    return _grid(spark, d).withColumn("density", F.round("density", 12))


def map_contours(spark, d):
    grid = stage(_grid(spark, d), "grid")  # read by the levels, the squares and the rings
    rings = density.polygons(density.contours(grid, density.levels(grid)))
    return rings.select(F.round("level", 12).alias("level"), "ring", "corners", F.round("area", 6).alias("area"))


QUERIES |= {"map_density": map_density, "map_contours": map_contours}
SQL |= {
    "map_density": f"WITH {_DENSITY} SELECT cell_x, cell_y, round(density, 12) AS density FROM d",
    "map_contours": f"""
WITH RECURSIVE {_DENSITY},{_SEGMENTS},
n AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY level) AS lv, level, f.ex AS fx, f.ey AS fy, t.ex AS tx, t.ey AS ty, f.px AS x0, f.py AS y0, t.px AS x1, t.py AS y1 FROM g),
w AS (
  SELECT lv, fx AS sx, fy AS sy, tx AS nx, ty AS ny FROM n
  UNION SELECT w.lv, sx, sy, n.tx, n.ty FROM w JOIN n ON w.lv = n.lv AND w.nx = n.fx AND w.ny = n.fy WHERE NOT (nx = sx AND ny = sy)),
h AS (SELECT lv, sx, sy, min({{a: nx, b: ny}}) AS head FROM w GROUP BY ALL)
SELECT round(any_value(level), 12) AS level, head.a || ',' || head.b AS ring, count(*) AS corners, round(sum(x0 * y1 - x1 * y0) / 2, 6) AS area
FROM n JOIN h ON n.lv = h.lv AND fx = sx AND fy = sy GROUP BY n.lv, head""",
}
