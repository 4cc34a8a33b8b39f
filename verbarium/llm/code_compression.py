"""Vector codes by weighted Lloyd rounds over distinct parts.

Integer vectors are cut into equal consecutive parts. Equal parts of a position become one row with a weight, counted in the map tasks first, so a part that a third of all
vectors share is one row from then on. Each round sends the codebooks (a bounded model: parts * entries integer rows) to all tasks; a task assigns its distinct
parts and returns weighted sums for each entry, at most one row for each part, entry and component. In the end the distinct parts with their entry and squared distance are
joined back to the vectors on the part itself: parts of over a two-hundredth of all rows by broadcast, others by an ordinary join.

Defined cases: as in `vectors`; vectors are continued by zeros to a whole number of parts; a null vec_id comes last where the smallest are taken, rows that share one are
ordered by their parts; with fewer vectors than entries the codebooks are smaller; entries that repeat lose to the first of them and stay; a null label is a label of its own; a label's
error that doesn't fit a long is null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, ship, stage
from .vectors import binaries, dense, integer_vectors

PARTS, ENTRIES, ROUNDS = 4, 256, 4

#: Parts that are compared with a codebook at once.
ROWS = 4096


def cut(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """place (a number for the row), vec_id, label, pieces: for each part its position in a byte and its integers."""
    longest = vectors.agg(F.max(F.size("x"))).first()[0] or 1
    each = -(-max(longest, 1) // parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense(batch.column("x"), parts * each).astype("<i4").view(np.uint8).reshape(-1, parts, 4 * each)
            position = np.broadcast_to(np.arange(parts, dtype=np.uint8)[None, :, None], (len(x), parts, 1))
            pieces = binaries(np.concatenate([position, x], axis=2).reshape(-1, 1 + 4 * each))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * parts), pieces)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("place", "vec_id", "label")), lists], ["place", "vec_id", "label", "pieces"])

    ship(vectors.sparkSession)
    rows = vectors.select(F.monotonically_increasing_id().alias("place"), "vec_id", "label", "x")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return stage(rows.mapInArrow(run, f"place long, vec_id {kinds['vec_id']}, label {kinds['label']}, pieces array<binary>"), "vectors")


def distinct_pieces(rows: DataFrame) -> DataFrame:
    """piece, weight: the distinct parts of all positions."""
    return stage(rows.select(F.explode("pieces").alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("weight")), "pieces")


def _split(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Positions and integers of pieces."""
    held = column.to_pylist()
    flat = np.frombuffer(b"".join(held), dtype=np.uint8).reshape(len(held), -1)
    return flat[:, 0], np.ascontiguousarray(flat[:, 1:]).view("<i4").astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the first of equals, and its squared distance; exact. In doubles, all sums are whole numbers below 2^53, else in longs."""
    top = int(max(abs(x).max(initial=1), abs(book).max(initial=1)))
    if 4 * x.shape[1] * top * top < 1 << 53:
        xf, bf = x.astype(np.float64), book.astype(np.float64)
        entry = np.argmin((bf * bf).sum(axis=1)[None, :] - 2 * (xf @ bf.T), axis=1)
    else:
        entry = np.argmin(np.stack([((x - b) ** 2).sum(axis=1) for b in book], axis=1), axis=1)
    return entry, ((x - book[entry]) ** 2).sum(axis=1)


def _assigned(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple]:
    """For some rows at a time and one position: position, rows (their numbers in the batch), integers, entries, squared distances."""
    for at in range(0, batch.num_rows, ROWS):
        position, x = _split(batch.column("piece").slice(at, ROWS))
        for p in np.unique(position):
            on = np.flatnonzero(position == p)
            yield p, at + on, x[on], *nearest(x[on], books[p])


def improved(pieces: DataFrame, books: np.ndarray) -> np.ndarray:
    """A Lloyd round: every entry becomes the floor of the weighted mean of its parts; entries without any stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64)
        for batch in batches:
            weight = batch.column("weight").to_numpy()
            for p, rows, x, entry, _ in _assigned(batch, books):
                np.add.at(sums[p], entry, x * weight[rows, None])
                np.add.at(counts[p], entry, weight[rows])
        p, e = np.nonzero(counts)
        sizes = np.arange(len(p) + 1, dtype=np.int32) * books.shape[2]
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), pa.ListArray.from_arrays(pa.array(sizes), pa.array(sums[p, e].ravel()))], ["p", "e", "n", "s"])

    done = pieces.mapInArrow(run, "p int, e int, n long, s array<long>")
    each = done.select("p", "e", "n", F.posexplode("s").alias("d", "s")).groupBy("p", "e", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = books.copy()
    for r in each.collect():  # a row for each component of the codebooks at most
        out[r.p, r.e, r.d] = r.s // r.n
    return out


def learn(rows: DataFrame, pieces: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) after `rounds` rounds from the parts of the vectors with the smallest ids."""
    start = rows.orderBy(F.asc_nulls_last("vec_id"), "pieces").select("pieces").limit(entries).collect()
    books = np.array([[np.frombuffer(p[1:], dtype="<i4") for p in r.pieces] for r in start], dtype=np.int64).transpose(1, 0, 2)
    for _ in range(rounds):
        books = improved(pieces, books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """place, vec_id, label, codes (an entry for each part), error, label_error for each vector; and the codebooks."""
    rows = cut(vectors, parts)
    if rows.isEmpty():
        return rows.selectExpr("place", "vec_id", "label", "array(0) AS codes", "0L AS error", "0L AS label_error"), np.zeros((parts, 0, 1), dtype=np.int64)
    pieces = distinct_pieces(rows)
    books = learn(rows, pieces, entries, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries, errors = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows, dtype=np.int64)
            for _, on, _, entry, error in _assigned(batch, books):
                entries[on], errors[on] = entry, error
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("weight"), pa.array(entries), pa.array(errors)], ["piece", "weight", "entry", "error"])

    coded = stage(pieces.mapInArrow(run, "piece binary, weight long, entry int, error long"), "coded")
    each = rows.select("place", "vec_id", "label", F.posexplode("pieces").alias("p", "piece"))
    met = join_groups(each, coded, "piece", "weight").groupBy("place").agg(
        F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), F.array_sort(F.collect_list(F.struct("p", "entry"))).alias("codes"), F.sum("error").alias("error")
    )
    met = stage(met.select("place", "vec_id", F.struct("label").alias("of"), F.col("codes.entry").alias("codes"), "error"), "errors")
    label_error = F.expr("try_cast(sum(cast(error AS decimal(38, 0))) AS long)")
    labels = stage(met.groupBy("of").agg(label_error.alias("label_error"), F.count(F.lit(1)).alias("size")), "labels")
    out = join_groups(met, labels, "of", "size")
    return out.select("place", "vec_id", F.col("of.label").alias("label"), "codes", "error", "label_error"), books


def op13_weighted_lloyd(spark, sf_dir: str) -> DataFrame:
    codes, books = compress(integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 1024))
    shown = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return codes.select("vec_id", shown.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    """The same in SQL, a pair of tables for each round."""
    distance = "list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    assign = "a{0} AS MATERIALIZED (SELECT v.p, v.x, any_value(n) AS n, min(row({1}, b.e)) AS best FROM vals v JOIN b{0} b ON v.p = b.p GROUP BY v.p, v.x)"
    update = """b{1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(any_value(s.x), any_value(b.x)) AS x FROM b{0} b LEFT JOIN (
    SELECT p, e, list(m ORDER BY d) AS x FROM (
      SELECT p, best[2] AS e, d, floor(sum(n * x[d]) / sum(n))::BIGINT AS m FROM a{0}, range(1, 17) t(d) GROUP BY p, best[2], d) GROUP BY p, e) s ON b.p = s.p AND b.e = s.e GROUP BY b.p, b.e)"""
    steps = [assign.format(k, distance) + (",\n" + update.format(k, k + 1) if k < rounds else "") for k in range(rounds + 1)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * 16 + 1 : p * 16 + 16] AS x FROM kept, range(4) t(p)),
vals AS MATERIALIZED (SELECT p, x, count(*) AS n FROM parts GROUP BY p, x),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)),
{",\n".join(steps)},
c AS (SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM parts JOIN a{rounds} USING (p, x) GROUP BY vec_id),
h AS (SELECT sha256(string_agg(x[d]::VARCHAR, ',' ORDER BY p, e, d)) AS codebooks_sha256 FROM b{rounds}, range(1, 17) t(d))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN kept USING (vec_id), h
"""


SQL = {"op13_weighted_lloyd": _sql()}
