"""Token counts behind a digest cache.

The cache is a Parquet table in a shared folder, one folder for each tokenizer version (digest of the tokenizer file), one run folder for
each append: content_digest, n_tokens. A call joins the digests of its texts to the cache, encodes one text for each distinct miss and
appends the counts; a later call over the same texts encodes nothing. Content is normalised as far as counts allow: null becomes empty. The
tokenizer has no normaliser, so any other change could alter a count.

Texts never leave the partition that reads them. One pass makes digests; the join of digests finds the misses, each with one partition that
holds it; these go to the shared folder, a file for each partition, and a second pass encodes what its own file lists. Should a partition
read other rows in the second pass (an input without a fixed order), the digests that it lacks are found by a join that moves their texts.

Defined cases: a null text is an empty one (0 tokens); repeated rows and texts are encoded once and all get the count; null doc_ids
keep their row; texts of any length are encoded whole; an empty table gives no rows and appends nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_texts, fresh_dir, join_groups, listed, map_batches, resident, small_batches, stage, text_col, write_parts

LIMIT = 1024
COUNTS = "content_digest binary, n_tokens long"

#: Characters on which the two engines for this vocabulary agree one by one (checked exhaustively by the tests): here the quick one counts.
#: All other texts go to the reference library.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ſ‐-‧‰-⁞₠-₿]*")


class Counter:
    """Counts tokens as the tokenizers library does for `json_name`, special strings in texts being special tokens, as is its default.

    Where `ranks_name` names the same vocabulary for the quick engine, texts in plain characters are counted by that one.
    """

    def __init__(self, json_name: str, ranks_name: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(json_name))
        self.library.no_truncation()
        self.library.no_padding()
        self.quick = None
        if ranks_name:
            import base64

            import tiktoken

            with open(public_tokenizers.path(ranks_name), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
            self.quick = tiktoken.Encoding(ranks_name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def count(self, texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            if self.quick is not None and PLAIN.fullmatch(text):
                out.append(len(self.quick.encode(text, allowed_special="all")))
            else:
                out.append(len(self.library.encode(text, add_special_tokens=False)))
        return out


def counter(json_name: str, ranks_name: str | None) -> Counter:
    return resident(("counter", json_name, ranks_name), lambda: Counter(json_name, ranks_name))


@lru_cache(maxsize=8)
def tokenizer_digest(json_name: str) -> str:
    import public_tokenizers

    with open(public_tokenizers.path(json_name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """content_digest, n_tokens of one tokenizer version; each digest once, also after two calls appended the same miss."""
    path = f"{cache}/{version}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], COUNTS)
    rows = spark.read.schema(COUNTS).option("recursiveFileLookup", "true").parquet(path)
    return rows.groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache: str, json_name: str = "byte_bpe_50k.json", ranks_name: str | None = "byte_bpe_50k.tiktoken", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of `docs`; appends the counts of texts unknown to `cache`.

    The joins are on digests, between exchanges of a few dozen bytes a row; a text with very many copies is met by broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    version = tokenizer_digest(json_name)
    known = read_cache(spark, cache, version)
    texts = docs.select("doc_id", text_col().alias("text")).withColumn("content_digest", F.unhex(F.sha2(F.col("text"), 256))).withColumn("part", F.spark_partition_id())
    rows = stage(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content_digest", "part"), "digests")
    wanted = rows.groupBy("content_digest").agg(F.min("part").alias("part"), F.count(F.lit(1)).alias("n"))
    misses = write_parts(wanted.join(known, "content_digest", "left_anti").select("content_digest", "part"), "misses")
    unknown = spark.read.schema("content_digest binary, part int").parquet(misses)
    new = spark.createDataFrame([], COUNTS)
    if not unknown.isEmpty():
        run = f"{cache}/{version}/run={uuid.uuid4().hex}"
        counts = encode_listed(texts, misses, json_name, ranks_name)
        # a digest is listed for one partition, and only a task that runs twice at once gives it twice; then the counts are equal
        counts.write.parquet(f"{run}/from=listed")
        new = spark.read.schema(COUNTS).option("recursiveFileLookup", "true").parquet(run)
        lacking = unknown.join(new, "content_digest", "left_anti")
        if not lacking.isEmpty():
            rest = texts.select("content_digest", "text").join(lacking.select("content_digest"), "content_digest").groupBy("content_digest").agg(F.first("text").alias("text"))
            map_batches(rest, encoding(json_name, ranks_name), COUNTS).write.parquet(f"{run}/from=moved")
            new = spark.read.schema(COUNTS).option("recursiveFileLookup", "true").parquet(run)
    counts = stage(wanted.select("content_digest", "n").join(known.union(new), "content_digest"), "counts")
    return join_groups(rows, counts, "content_digest", "n").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def encode_listed(texts: DataFrame, misses: str, json_name: str, ranks_name: str | None) -> DataFrame:
    """content_digest, n_tokens of the texts that `misses` lists for their partition, each once."""
    encode = encoding(json_name, ranks_name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: set[bytes] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if left is None:
                left = set(listed(misses, batch.column("part")[0].as_py(), "content_digest"))
            mine = []
            for i, d in enumerate(batch.column("content_digest").to_pylist()):
                if d in left:
                    left.discard(d)
                    mine.append(i)
            if mine:
                yield encode(batch.select(["content_digest", "text"]).take(pa.array(mine)))

    return texts.select("content_digest", "text", "part").mapInArrow(run, COUNTS)


def encoding(json_name: str, ranks_name: str | None) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = counter(json_name, ranks_name).count(as_texts(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("content_digest"), pa.array(counts, pa.int64())], ["content_digest", "n_tokens"])

    return encode


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that each call counts every distinct text."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_dir(spark, "token-cache"))
