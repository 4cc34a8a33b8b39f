"""Hard-negative mining over a vector-approximation file.

Every dimension is divided into cells that hold about equally many components (quantiles over all rows; the outer cells reach to the least and
the greatest component). The file has a byte a dimension for each row, its cell. For a block of anchors a table gives, for every dimension and cell, the
least and the greatest product that a component of the cell can have with the anchor's; sums of looked-up values bound a row's score from below and
above, and only rows whose bounds meet a window of scores are scored exactly.

Anchors are a set of queries that grows with the table. They are written to the shared folder, sorted by label; each task holds a chunk of the approximation
file (bounded rows) and reads the anchors a block at a time, so memory is bounded whatever their number. Two searches are made: the first positives among rows of
the anchor's label, then the negatives inside the windows that the positives' scores open. Each search is made over the anchors alone first. Their best scores are bounds from
below for the best of all rows: about a row in a hundred of what is wanted passes them, so what tasks emit grows with the rows, not with rows times tasks.

Defined cases: as in `vectors`; rows with a null label take no part; a null vec_id is no anchor, keeps its label and comes last among ties; rows that share a
vec_id are rows like any other (each an anchor, if divisible); equal scores and ids are interchangeable; anchors without positives, or positives without
negatives, give no rows; a window whose ends cross is empty; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_dir, ship, stage
from .vectors import binaries, dense, integer_vectors, matrix

#: Cells of a dimension, at most 256; rows of the approximation file that a task holds; rows looked up at once; anchors of a block.
CELLS, CHUNK_ROWS, ROWS, ANCHORS = 64, 1 << 17, 2048, 64

FOUND = "anchor long, w int, vec_id long, score long"
NEVER = np.iinfo(np.int64).max


def cell_edges(vectors: DataFrame, cells: int = CELLS) -> np.ndarray:
    """Edges by dimension, `cells` + 1 each: cell c holds the integers from edge c to edge c + 1, the latter excluded. Their number follows from the dimensions alone."""
    quantiles = F.percentile_approx("c", [k / cells for k in range(1, cells)], F.lit(20 * cells))
    each = vectors.select(F.posexplode("x").alias("d", "c")).groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high"), quantiles.alias("q"))
    found = sorted(each.collect(), key=lambda r: r.d)
    edges = np.ones((max(1, len(found)), cells + 1), dtype=np.int64)  # without any component, all rows are zero
    edges[:, 0] = 0
    for r in found:
        low, high = (r.low, r.high) if r.n == found[0].n else (min(r.low, 0), max(r.high, 0))
        inner = np.unique([q for q in r.q if low < q <= high])
        edges[r.d] = high + 1
        edges[r.d, : len(inner) + 1] = [low, *inner]
    return edges


def approximations(vectors: DataFrame, edges: np.ndarray) -> DataFrame:
    """The approximation file, staged: place (a number for the row), vec_id, label, cells (a byte for each dimension), x."""
    dims = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense(batch.column("x"), dims)
            cells = np.empty(x.shape, dtype=np.uint8)
            for d in range(dims):
                cells[:, d] = np.searchsorted(edges[d, 1:-1], x[:, d], side="right")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("place", "vec_id", "label")), binaries(cells), binaries(x)], ["place", "vec_id", "label", "cells", "x"])

    ship(vectors.sparkSession)
    rows = vectors.select(F.monotonically_increasing_id().alias("place"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "x")
    return stage(rows.mapInArrow(run, "place long, vec_id long, label long, cells binary, x binary"), "approximations")


def _blocks(uri: str, rows: int = ANCHORS) -> Iterator[list[pa.Array]]:
    """The anchors of the shared folder, a block at a time."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, root = pafs.FileSystem.from_uri(uri)
    for file in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet")):
        with fs.open_input_file(file) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=rows, columns=["place", "label", "x", "lows", "highs"]):
                yield [batch.column(c) for c in ("place", "label", "x", "lows", "highs")]


def bound_tables(anchors: np.ndarray, edges: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """By dimension, cell and anchor: the least and the greatest product of the anchor's component with one of the cell."""
    low, high = edges[:, :-1, None], np.maximum(edges[:, 1:, None] - 1, edges[:, :-1, None])
    a = anchors.T[:, None, :].astype(np.int64)
    return np.where(a >= 0, a * low, a * high).astype(kind), np.where(a >= 0, a * high, a * low).astype(kind)


def bounds(tables: tuple[np.ndarray, np.ndarray], cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of all rows (cells: dimensions by rows) with all anchors of the tables."""
    at = cells.astype(np.intp)
    out = []
    for table in tables:
        total = np.zeros((at.shape[1], table.shape[2]), dtype=table.dtype)
        looked = np.empty_like(total)
        for d in range(len(table)):
            np.take(table[d], at[d], axis=0, out=looked, mode="clip")
            total += looked
        out.append(total)
    return out[0], out[1]


class _Best:
    """The k best rows of every window of a block of anchors, with what the k-th of them scores at least."""

    def __init__(self, lows: np.ndarray, highs: np.ndarray, k: int):
        self.least, self.highs, self.k = lows.copy(), highs, k
        self.held = np.zeros((0, 4), dtype=np.int64)  # anchor and window as one number, score, vec_id, row

    def meets(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and anchors whose bounds meet what the anchor's windows leave open."""
        some = self.least <= self.highs
        first, last = np.where(some, self.least, NEVER).min(axis=1), np.where(some, self.highs, -NEVER).max(axis=1)
        return np.nonzero((high >= first) & (low <= last))

    def add(self, row: np.ndarray, anchor: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        windows = self.least.shape[1]
        new = [self.held]
        for w in range(windows):
            on = (score >= self.least[anchor, w]) & (score <= self.highs[anchor, w])
            new.append(np.stack([anchor[on] * windows + w, score[on], vec_id[on], row[on]], axis=1))
        held = np.concatenate(new)
        held = held[np.lexsort((held[:, 2], -held[:, 1], held[:, 0]))]
        start = np.searchsorted(held[:, 0], held[:, 0])
        rank = np.arange(len(held)) - start
        self.held = held[rank < self.k]
        full = held[rank == self.k - 1]
        flat = self.least.reshape(-1)
        flat[full[:, 0]] = np.maximum(flat[full[:, 0]], full[:, 1])


def search(index: DataFrame, anchors: str, edges: np.ndarray, k: int, same: bool, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """anchor (place), w, vec_id, score: the `k` best rows of each window, out of each task's rows. `same`: of the anchor's label, else of others."""
    reach = int(max(abs(edges).max(), 1)) ** 2 * len(edges)
    kind = np.int32 if reach < 1 << 31 else np.int64

    def meet(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        label = table["label"].to_numpy()
        order = np.argsort(label, kind="stable")
        label, place = label[order], table["place"].to_numpy()[order]
        known, vec_id = table["vec_id"].is_valid().to_numpy()[order], table["vec_id"].fill_null(NEVER).to_numpy()[order]
        cells = np.ascontiguousarray(matrix(table["cells"], np.uint8)[order].T)
        x = matrix(table["x"], np.int32)[order]
        for block in _blocks(anchors):
            a_place, a_label, a_x = block[0].to_numpy(), block[1].to_numpy(), matrix(block[2], np.int32)
            lows, highs = (np.array(c.to_pylist(), dtype=np.int64) for c in block[3:])
            for one in np.unique(a_label):
                mine = a_label == one
                start, stop = np.searchsorted(label, one), np.searchsorted(label, one, side="right")
                tables, own, here = bound_tables(a_x[mine], edges, kind), a_x[mine].astype(np.int64), a_place[mine]
                best = _Best(lows[mine], highs[mine], k)
                for low, high in [(start, stop)] if same else [(0, start), (stop, len(label))]:
                    for at in range(low, high, ROWS):
                        end = min(at + ROWS, high)
                        row, anchor = best.meets(*bounds(tables, cells[:, at:end]))
                        row += at
                        if same:
                            other = place[row] != here[anchor]
                            row, anchor = row[other], anchor[other]
                        score = np.einsum("nd,nd->n", x[row], own[anchor], dtype=np.int64)
                        best.add(row, anchor, score, vec_id[row])
                if len(best.held):
                    key, score, vid, row = best.held.T
                    windows = lows.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(here[key // windows]), pa.array((key % windows).astype(np.int32)), pa.array(vid, mask=~known[row]), pa.array(score)], ["anchor", "w", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, chunk_rows):
                held.append(batch.slice(at, chunk_rows))
                rows += held[-1].num_rows
                if rows >= chunk_rows:
                    yield from meet(held)
                    held, rows = [], 0
        if rows:
            yield from meet(held)

    return index.select("place", "vec_id", "label", "cells", "x").mapInArrow(run, FOUND)


def first(found: DataFrame, k: int) -> DataFrame:
    """anchor, w, rank, vec_id, score: the `k` best of what all tasks found, ties by smaller vec_id. Spark cuts each task's rows to `k` before they move."""
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("anchor", "w", "rank", "vec_id", "score")


def _written(anchors: DataFrame) -> str:
    path = fresh_dir(anchors.sparkSession, "anchors")
    anchors.select("place", "label", "x", "lows", "highs").sort("label", "place").write.parquet(path)
    return path


def best_in_windows(index: DataFrame, anchors: DataFrame, edges: np.ndarray, k: int, same: bool) -> DataFrame:
    """anchor, w, rank, vec_id, score. `anchors`: rows of the index with arrays lows and highs, the windows of scores."""
    chosen = stage(anchors.select(*index.columns, "lows", "highs"), "chosen")
    near = first(search(chosen, _written(chosen), edges, k, same), k).where(F.col("rank") == k)
    bars = near.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("bars"))  # an entry for each window
    raised = F.transform("lows", lambda low, w: F.greatest(low, F.try_element_at("bars", w)))
    barred = chosen.join(bars, chosen["place"] == bars["anchor"], "left").withColumn("lows", raised)
    return first(search(index, _written(barred), edges, k, same), k)


def _floor(value: Column, by: int) -> Column:
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, share: tuple[int, int] = (30, 90), cells: int = CELLS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. `vectors`: vec_id, label, x (integers). Negatives are rows of other labels
    with share[0] * positive_score <= 100 * negative_score <= share[1] * positive_score."""
    vectors = vectors.where(F.col("label").isNotNull())
    edges = cell_edges(vectors, cells)
    index = approximations(vectors, edges)
    long = lambda n: F.lit(n).cast("long")
    anchors = index.where(is_anchor).withColumns({"lows": F.array(long(-NEVER)), "highs": F.array(long(NEVER))})
    near = best_in_windows(index, anchors, edges, positives, True)
    ids = index.where(is_anchor).select("place", F.col("vec_id").alias("anchor_id"))
    near = near.join(ids, F.col("anchor") == F.col("place")).select("anchor", "anchor_id", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = stage(near, "positives")
    window = F.struct("w", (-_floor(-share[0] * F.col("positive_score"), 100)).alias("low"), _floor(share[1] * F.col("positive_score"), 100).alias("high"))
    open_ = near.groupBy("anchor").agg(F.array_sort(F.collect_list(window)).alias("windows"))  # `positives` entries at most
    some = lambda f, empty: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda w: F.coalesce(F.get("windows", w)[f], long(empty)))
    asked = index.join(open_, F.col("place") == F.col("anchor")).withColumns({"lows": some("low", 1), "highs": some("high", 0)})
    far = best_in_windows(index, asked, edges, negatives, False)
    return far.join(near, ["anchor", "w"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_va_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 256, label)
    return mine(vectors, F.col("vec_id") % 100 == 0)


SQL = {
    "op11_va_negatives": """
WITH r AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM r a, r b WHERE a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT anchor, anchor_id, vec_id AS positive_id, r AS positive, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY anchor, positive ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
}
