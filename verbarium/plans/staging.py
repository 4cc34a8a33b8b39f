"""The cluster's shared folder, tables staged in it, and ordered running sums over it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """URI of a folder that driver and executors share: spark.checkpoint.dir, or where it is unset a temporary one, if all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="verbarium-"))
    return _fallback[0]


def fresh_dir(spark: SparkSession, name: str) -> str:
    """URI of a folder in the shared one that no other call uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors, fixes anything that a
    recomputation could order differently. The files stay until the folder is cleaned, as the result may be read late."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish(spark: SparkSession, name: str, array: object) -> str:
    """Write a numpy array of bounded size to the shared folder; its URI."""
    import io

    import numpy as np
    import pyarrow.fs as pafs

    out = io.BytesIO()
    np.save(out, array)
    uri = fresh_dir(spark, name)
    fs, root = pafs.FileSystem.from_uri(uri)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}.npy") as f:
        f.write(out.getvalue())
    return f"{uri}/{name}.npy"


def published(uri: str):
    """What publish() wrote; read in a worker."""
    import io

    import numpy as np
    import pyarrow.fs as pafs

    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as f:
        return np.load(io.BytesIO(f.read()))


def discard(uri: str) -> None:
    """Delete a folder of the shared one that an iteration has left behind; nothing may refer to it any more."""
    import pyarrow.fs as pafs

    fs, root = pafs.FileSystem.from_uri(uri)
    fs.delete_dir(root)


def running(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """`df` with `before` (sum of `value` over the earlier rows of the group) and `seq` (their number).

    Rows are dealt by ranges of (group, order), so large groups span several ranges. Inside a range a window sums; of groups that
    span ranges (two for each range at most) the sums of the earlier ranges are added.
    """
    placed = stage(df.repartitionByRange(*group, *order).withColumn("range_no", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(*group, "range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    local = placed.withColumn("before", F.coalesce(F.sum(value).over(inside), zero)).withColumn("seq", F.count(F.lit(1)).over(inside))
    totals = placed.groupBy(*group, "range_no").agg(F.sum(value).alias("v"), F.count(F.lit(1)).alias("c"))
    over = Window.partitionBy(*group).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.withColumn("v0", F.sum("v").over(over)).withColumn("c0", F.sum("c").over(over)).where("c0 > 0")
    shifts = shifts.select(*[F.col(g).alias(f"s_{g}") for g in group], F.col("range_no").alias("s_range"), "v0", "c0")
    same = F.col("range_no") == F.col("s_range")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"s_{g}"))
    out = local.join(shifts, same, "left")
    return out.select(*df.columns, (F.col("before") + F.coalesce("v0", zero)).alias("before"), (F.col("seq") + F.coalesce("c0", zero)).alias("seq"))


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where the session was started elsewhere. On a cluster the package is to be shipped
    (--py-files); a path that isn't there does no harm."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where its files give fewer partitions than that, as a small file of one row group does; else unchanged. What is dealt out
    is then less than one full partition for each core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
