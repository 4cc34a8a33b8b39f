"""What the training-data operators share: the cluster's shared folder, staged tables, Arrow batches, row selection."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.staging import fresh_dir, running, shared_dir, ship, stage  # noqa: F401

#: ASCII white space, the complement of the word rule `[^\x20\x09-\x0D]+`.
SPACE_BYTES = b" \t\n\x0b\x0c\r"

#: Rows of an Arrow batch. Whole texts travel in batches, so the bound on rows is what keeps a Python worker small.
BATCH_ROWS = 500

def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch for this session; whole texts of some 100 kB then need tens of MB at most in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    ship(spark)


def text_col(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column without decoding; null: empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return df.mapInArrow(run, schema)


def where_text(docs: DataFrame, keep: Callable[[pa.Array], list[bool]]) -> DataFrame:
    """The rows of `docs` whose text `keep` accepts, each judged by itself in one pass: whole rows in, kept rows out. No key is needed."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(keep(batch.column("text")), pa.bool_()))

    return map_batches(docs, run, docs.schema)


def rows_kept(docs: DataFrame, choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of `docs` that `choose` keeps, with all their columns. It gets text and, as doc_id, a struct that orders as the row's doc_id does
    (nulls last), then by the row's place in a staged table; so rows without a doc_id, or with the same one, are rows like any other. What is
    kept goes back as lists of places, one for each partition in which they were given out; the rows themselves are not exchanged."""
    row = F.struct(*[F.col(_q(c)) for c in docs.columns]).alias("row")
    placed = stage(docs.select(row, F.monotonically_increasing_id().alias("place")), "placed")
    key = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("id"), "place").alias("doc_id")
    keep = choose(placed.select(key, F.col("row.text").alias("text"))).select(F.col("doc_id.place").alias("place"))
    lists = write_parts(keep.withColumn("part", F.shiftright("place", 33)), "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mine = -1, np.zeros(0, dtype=np.int64)
        for batch in batches:
            place = batch.column("place").to_numpy()
            on = np.zeros(len(place), dtype=bool)
            for p in np.unique(place >> 33).tolist():
                if p != part:
                    part, mine = p, np.array(listed(lists, p, "place"), dtype=np.int64)
                on |= np.isin(place, mine)
            yield batch.filter(pa.array(on))

    small_batches(docs.sparkSession)
    return placed.mapInArrow(run, placed.schema).select("row.*")


def write_parts(df: DataFrame, name: str) -> str:
    """Write `df` to the shared folder, a folder for each value of its column `part`; the URI."""
    path = fresh_dir(df.sparkSession, name)
    df.repartition("part").write.partitionBy("part").parquet(path)
    return path


def listed(uri: str, part: int, column: str) -> list:
    """A column of what write_parts() wrote for one part; read in a worker."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, root = pafs.FileSystem.from_uri(f"{uri}/part={part}")
    found: list = []
    for file in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if file.path.endswith(".parquet"):
            with fs.open_input_file(file.path) as f:
                found += pq.read_table(f, columns=[column]).column(0).to_pylist()
    return found


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, most: int = 200, small: Column | None = None) -> DataFrame:
    """`rows` joined with `groups`, which have one row for each key and count the key's rows in `size`. Keys with more than 1 / `most` of all rows,
    fewer than `most` of them, are broadcast and meet their rows where these are; the others go by an ordinary join, in which none is hot. `small`
    says of which keys the bytes are bounded, where their type doesn't. Both tables are read more than once, so they should be staged."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = (F.col(size) > total / most) & (F.lit(True) if small is None else small)
    hot = groups.where(is_hot)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(~is_hot), key)
    return rows.join(F.broadcast(hot), key).unionByName(far)


def id_type(docs: DataFrame) -> str:
    return "long" if (t := docs.schema["doc_id"].dataType.simpleString()) in ("int", "bigint") else t


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# -- what a worker process holds --------------------------------------------------------------------------------------------------

_resident: dict = {}


def resident(key: tuple, make: Callable):
    """The one large object (a model, an encoder with what it remembers) that this process holds. Spark uses workers again for later stages, so
    another key replaces the object instead of adding to it."""
    if key not in _resident:
        _resident.clear()
        gc.collect()
        _resident[key] = make()
    return _resident[key]


# -- artifacts of bounded size ---------------------------------------------------------------------------------------------------


def publish(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a model file (of bounded size) to the shared folder; its URI."""
    import pyarrow.fs as pafs

    uri = fresh_dir(spark, name)
    fs, root = pafs.FileSystem.from_uri(uri)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}") as f:
        f.write(data)
    return f"{uri}/{name}"


def open_mapped(uri: str) -> memoryview:
    """The bytes of a published file: memory-mapped where the shared folder is mounted, else read into an anonymous map."""
    import mmap

    import pyarrow.fs as pafs

    fs, path = pafs.FileSystem.from_uri(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        with open(path, "rb") as f:
            return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    with fs.open_input_stream(path) as f:
        data = f.read()
    held = mmap.mmap(-1, max(1, len(data)))
    held.write(data)
    return memoryview(held)[: len(data)]
