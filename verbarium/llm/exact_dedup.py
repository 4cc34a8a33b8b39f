"""Exact dedup by content-defined chunk recipes.

Each normalised text (white space `[\\x20\\x09-\\x0D]` deleted) is cut where a rolling gear hash of its last 32 bytes hits a mask, so equal
passages give equal chunks wherever they stand. A chunk's identifier is a 128-bit digest that is *verified*: the chunk contents are
deduplicated by their bytes, and if one identifier ever stands for two contents the whole run moves on to the next digest. After that two
texts are equal exactly if their ordered identifier lists (16 bytes for about 1 kB of text) are, and only these lists are shuffled, grouped
and joined; the texts themselves are moved once, as deduplicated chunks, for the verification.

Defined cases: null and empty texts are equal to each other and to texts of white space only; rows that repeat a doc_id and its text
count as members and exactly one of them is kept; of equal texts that tie in length the smallest doc_id stays, a null one sorts last; texts of any
length are cut whole, a slab at a time; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, as_bytes, id_type, join_groups, rows_kept, small_batches, stage

#: Chunk sizes in bytes; a cut needs 10 zero bits of the gear hash, so chunks are about MIN + 1 kB long.
MIN_CHUNK, MAX_CHUNK, MASK = 256, 8192, np.uint32(0x3FF << 22)
GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Bytes for which the gear hash is computed at once, and that it looks back.
SLAB, LOOK = 1 << 21, 32
#: Recipes of very large groups are broadcast up to this size (texts of some 4 MB).
KEY_BYTES = 1 << 16

#: Chunk digests, tried in turn until one is verified on the data.
DIGESTS: tuple[Callable[[bytes], bytes], ...] = (
    lambda b: xxhash.xxh3_128_digest(b, 0),
    lambda b: xxhash.xxh3_128_digest(b, 0x9E3779B97F4A7C15),
    lambda b: hashlib.blake2b(b, digest_size=16).digest(),
    lambda b: hashlib.sha256(b).digest(),
)


def cut(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The chunks of each text. Cuts depend only on the bytes of the text itself."""
    slab: list[bytes] = []
    size = 0
    for text in texts:
        slab.append(text)
        size += len(text)
        if size >= SLAB:
            yield from _cut_slab(slab)
            slab, size = [], 0
    if slab:
        yield from _cut_slab(slab)


def _cut_slab(slab: list[bytes]) -> Iterator[list[bytes]]:
    marks = _marks(b"".join(slab))
    start, at = 0, 0
    for text in slab:
        end, out, low = start + len(text), [], start
        while low < end:
            least = low + MIN_CHUNK  # over 32, so the hash at a cut has only seen this text
            while at < len(marks) and marks[at] < least:
                at += 1
            high = min(marks[at] if at < len(marks) else end, low + MAX_CHUNK, end)
            out.append(text[low - start : high - start])
            low = high
        yield out
        start = end


def _marks(data: bytes) -> list[int]:
    """Where the hash hits the mask; computed slab by slab, so that a very long text needs no more than the slab beside itself."""
    found: list[int] = []
    for low in range(0, len(data), SLAB):
        back = min(low, LOOK)
        h = GEAR[np.frombuffer(data[low - back : low + SLAB], dtype=np.uint8)]
        for step in (1, 2, 4, 8, 16):  # h[i] = sum of GEAR[data[i - k]] << k over k < 32
            h[step:] += h[:-step] << np.uint32(step)
        found += (np.flatnonzero((h[back:] & MASK) == 0) + low + 1).tolist()
    return found


def _normal(batch: pa.RecordBatch) -> list[bytes]:
    return [b.translate(None, SPACE_BYTES) for b in as_bytes(batch.column("text"))]


def _chunks(digest: Callable[[bytes], bytes]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list({c for chunks in cut(_normal(batch)) for c in chunks})
            yield pa.RecordBatch.from_arrays([pa.array([digest(c) for c in found], pa.binary()), pa.array(found, pa.binary())], ["id", "content"])

    return run


def _recipes(digest: Callable[[bytes], bytes]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _normal(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pc.fill_null(pc.cast(pc.utf8_length(batch.column("text")), pa.int64()), 0),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                    pa.array([b"".join(map(digest, chunks)) for chunks in cut(texts)], pa.binary()),
                ],
                ["doc_id", "n_points", "text_sha256", "recipe"],
            )

    return run


def verified(texts: DataFrame, digest: Callable[[bytes], bytes]) -> bool:
    """True if no identifier stands for two chunk contents: contents are deduplicated by bytes (combined in each map task first), then
    identifiers are counted."""
    contents = texts.mapInArrow(_chunks(digest), "id binary, content binary").groupBy("id", "content").agg(F.lit(1).alias("one"))
    return not contents.groupBy("id").count().where("count > 1").limit(1).count()


def recipes(docs: DataFrame, digests: tuple[Callable[[bytes], bytes], ...] = DIGESTS) -> DataFrame:
    """doc_id, n_points, text_sha256, recipe (identifiers of the text's chunks in order, verified on all of `docs`)."""
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    for digest in digests:
        if verified(texts, digest):
            return texts.mapInArrow(_recipes(digest), f"doc_id {id_type(docs)}, n_points long, text_sha256 string, recipe binary")
    raise ValueError("no digest gives each chunk content an identifier of its own")


def exact_dedup(docs: DataFrame, digests: tuple[Callable[[bytes], bytes], ...] = DIGESTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_points: one row for each row of `docs`.

    The row with the most code points, then the smallest doc_id, stays. Groups are reduced in the map tasks first; very large groups
    meet their rows by broadcast (at most 200 recipes of at most KEY_BYTES), others by a join on the recipe.
    """
    lists = recipes(docs, digests)
    rows = lists.groupBy("recipe", "n_points", "doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("copies"))
    rows = stage(rows, "recipes")
    order = F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"))
    groups = rows.groupBy("recipe").agg(F.min(order).alias("best"), F.sum("copies").alias("group_size"))
    groups = stage(groups.select("recipe", F.col("best.c").alias("keep_id"), (-F.col("best.a")).alias("keep_points"), "group_size"), "groups")
    joined = join_groups(rows, groups, "recipe", "group_size", small=F.octet_length("recipe") <= KEY_BYTES).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points")) & (F.col("copy") == 1)
    return joined.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256", "n_points")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    return rows_kept(docs, lambda rows: exact_dedup(rows).where("kept"))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_points")


SQL = {
    "op9_exact_dedup": r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
h AS (SELECT doc_id, n_points, sha256(t) AS text_sha256 FROM n)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
}
