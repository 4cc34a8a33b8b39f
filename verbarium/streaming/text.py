"""Streams of documents: cleaning and tokenising are stateless, counts take windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, ngrams


def read_documents(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def cleaned(stream: DataFrame, options: cleaning.Options) -> DataFrame:
    return cleaning.clean_documents(stream, options)


def token_counts(stream: DataFrame, time: str, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """window, token, n: counts by event time; rows later than the watermark are dropped by Spark."""
    tokens = stream.select(time, F.explode(ngrams.tokenize("text")).alias("token")).withWatermark(time, late)
    return tokens.groupBy(F.window(time, window, slide), "token").agg(F.count(F.lit(1)).alias("n"))


def bigram_counts(stream: DataFrame, time: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    grams = F.expr("if(size(t) >= 2, transform(sequence(0, size(t) - 2), i -> array_join(slice(t, i + 1, 2), ' ')), cast(array() as array<string>))")
    t = stream.select(time, ngrams.tokenize("text").alias("t")).select(time, F.explode(grams).alias("ngram")).withWatermark(time, late)
    return t.groupBy(F.window(time, window), "ngram").agg(F.count(F.lit(1)).alias("n"))


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Starts a query to Parquet that ends when the input is used up."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
