"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments, and each, filled up to 23 bits, is decoded with the binary Golay code [23, 12, 7]. The
code is perfect: every word lies within distance 3 of exactly one codeword, and `near()` lists the (1 or 6) codewords within distance 4.
Two words at distance 2 or less share a codeword there (the one that the word between them decodes to); of two words at distance 1, the one's
decoded codeword is among those near the other.

If two fingerprints differ in 4 bits at most, the errors fall into three pigeonholes in one of two ways:

* a segment is free of errors; then another one has 2 at most. Keys: the exact segment with a codeword near another segment.
* no segment is free; then two have exactly one error and the third has 2 at most, so that one of its three blocks of 7 bits is free. The
  parities of the two differ, so the fingerprint with even parity gives its decoded codeword, the one with odd parity all those near it.
  Keys: the codewords of two segments and a block of the third, with sides by parity.

That is about 120 keys a fingerprint, of 32 bits and more, so that chance meetings stay rare. Fingerprints with a key in common are
verified by their distance; each bucket returns a spanning forest of its links, never all its pairs, and buckets of very many
fingerprints are dealt out in pairs of blocks.

Defined cases: a null text is an empty one; texts without words have fingerprint 0 and link like any other; repeated rows link to each
other; null doc_ids are members but never a component's name, unless it has no other; texts of any length are hashed whole, a stretch of shingles at a
time; an empty table gives no rows; extra columns are ignored. A bucket of n distinct fingerprints over BUCKET is searched in pairs of blocks, so its
rows are dealt 2n / BUCKET times each: exact, but work grows with n squared there. Such a bucket needs that many distinct texts which agree in the
key's 32 bits or more and yet are no exact copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, id_type, join_groups, map_batches, rows_kept, small_batches, stage
from .components import components

SEED, SHINGLE, DISTANCE = 42, 4, 4
#: First bit and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of a bucket above which it is dealt out in blocks of half as many.
BUCKET = 8192


# -- fingerprints ------------------------------------------------------------------------------------------------------------------


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text: A-Z lower-cased, words divided by ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(line, SEED)
    at = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) + 1 for w in words], out=at[1:])
    total, n = np.zeros(64, dtype=np.int64), len(words) - size + 1
    for low in range(0, n, 1 << 15):
        high = min(n, low + (1 << 15))
        hashes = [digest(line[a:b], SEED) for a, b in zip(at[low:high].tolist(), (at[low + size : high + size] - 1).tolist())]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in as_bytes(batch.column("text"))], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {id_type(docs)}, fp long")


# -- the Golay code ----------------------------------------------------------------------------------------------------------------


class Golay:
    """[23, 12, 7]: cyclic, with generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1. A codeword's index is its upper 12 bits."""

    GENERATOR = 0b110001110101

    def __init__(self) -> None:
        self.low = self._remainders(np.arange(1 << 11, dtype=np.int64))
        self.high = self._remainders(np.arange(1 << 12, dtype=np.int64) << 11)
        # error patterns of weight 4 at most, by syndrome
        by: list[list[int]] = [[] for _ in range(1 << 11)]
        for weight in range(5):
            for bits in combinations(range(23), weight):
                e = sum(1 << b for b in bits)
                by[int(self.syndrome(np.array([e]))[0])].append(e)
        self.leader = np.array([x[0] for x in by], dtype=np.int64)
        self.n_near = np.array([len(x) for x in by])
        self.patterns = np.array([x + [-1] * (max(map(len, by)) - len(x)) for x in by], dtype=np.int64)

    def _remainders(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(22, 10, -1):
            x = np.where(x >> bit & 1, x ^ (self.GENERATOR << (bit - 11)), x)
        return x

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.low[x & 0x7FF] ^ self.high[x >> 11]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Index of the one codeword within distance 3."""
        return (x ^ self.leader[self.syndrome(x)]) >> 11

    def near(self, x: np.ndarray) -> np.ndarray:
        """Indices of the codewords within distance 4, a row for each word, filled up with -1."""
        e = self.patterns[self.syndrome(x)]
        return np.where(e < 0, -1, (x[:, None] ^ np.maximum(e, 0)) >> 11)


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of `fps`, key, side) for all keys. Sides meet if they differ, or are 0."""
    code = golay()
    part = [(fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    near = [code.near(p) for p in part]
    out = []

    def add(kind: int, key: np.ndarray, side: np.ndarray, ok: np.ndarray) -> None:
        row = np.broadcast_to(np.arange(len(fps)).reshape(-1, *[1] * (key.ndim - 1)), key.shape)[ok]
        out.append((row, key[ok] | kind << 58, np.broadcast_to(side, key.shape)[ok]))

    for kind, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        add(kind, part[i][:, None] << 12 | near[j], np.int8(0), near[j] >= 0)
    for number, (i, j) in enumerate(combinations(range(3), 2)):
        odd_i, odd_j = (np.bitwise_count(part[k]) & 1 for k in (i, j))
        mine = []
        for k, odd in ((i, odd_i), (j, odd_j)):
            decoded = np.full_like(near[k], -1)
            decoded[:, 0] = code.decode(part[k])
            mine.append(np.where(odd[:, None] == 1, near[k], decoded))
        pair = mine[0][:, :, None] << 12 | mine[1][:, None, :]
        ok = (mine[0][:, :, None] >= 0) & (mine[1][:, None, :] >= 0)
        mixed = (odd_i ^ odd_j).astype(np.int64)[:, None, None]
        third = part[3 - i - j]
        for block in range(3):  # the last block of 22 bits has 8
            free = (third >> 7 * block & (0x7F if block < 2 else 0xFF))[:, None, None]
            add(6 + 3 * number + block, pair | mixed << 24 | free << 25, (1 + odd_i).astype(np.int8)[:, None, None], ok)
    rows, found, sides = (np.concatenate(x) for x in zip(*out))
    return rows, found, sides


# -- buckets -----------------------------------------------------------------------------------------------------------------------


def forest(fps: np.ndarray, sides: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links of a spanning forest of the bucket's verified links. Searches from each fingerprint among those that no search has
    reached, so that a dense bucket is done after a few searches and memory is that of the bucket."""
    left, left_side = fps, sides
    out: list[tuple[int, int]] = []
    while len(left) > 1:
        queue = [(left[0], left_side[0])]
        left, left_side = left[1:], left_side[1:]
        while queue and len(left):
            x, side = queue.pop()
            hit = np.bitwise_count(left ^ x) <= distance
            if side:
                hit &= left_side != side
            if hit.any():
                out += [(int(x), int(y)) for y in left[hit]]
                queue += list(zip(left[hit], left_side[hit]))
                left, left_side = left[~hit], left_side[~hit]
    return out


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for low in range(0, len(fps), 2000):
            part = fps[low : low + 2000]
            rows, found, sides = keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(part[rows].view(np.int64)), pa.array(sides)], ["key", "fp", "side"])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, block): each run of equal ones is a bucket; the last of a batch waits for the next batch."""
    held: list[tuple[np.ndarray, ...]] = []

    def links(keys_: np.ndarray, blocks: np.ndarray, fps: np.ndarray, sides: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero((np.diff(keys_) != 0) | (np.diff(blocks) != 0)) + 1
        starts, ends = np.append(0, cut), np.append(cut, len(keys_))
        found: set[tuple[int, int]] = set()
        two = ends - starts == 2
        a, b = starts[two], starts[two] + 1
        ok = (np.bitwise_count(fps[a] ^ fps[b]) <= DISTANCE) & ((sides[a] == 0) | (sides[a] != sides[b]))
        found.update(zip(fps[a[ok]].tolist(), fps[b[ok]].tolist()))
        for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
            found.update(forest(fps[s:e], sides[s:e]))
        both = np.array([(min(p), max(p)) for p in found], dtype=np.uint64).reshape(-1, 2)
        both = np.unique(both, axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].view(np.int64)), pa.array(both[:, 1].view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = tuple(batch.column(c).to_numpy() for c in ("key", "block", "fp", "side"))
        last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        cut = last[-1] + 1 if len(last) else 0
        if cut or (held and (held[0][0][0], held[0][1][0]) != (now[0][0], now[1][0])):
            done = [np.concatenate(c) for c in zip(*held, tuple(c[:cut] for c in now))]
            yield links(done[0], done[1], done[2].view(np.uint64), done[3])
            held = []
        held.append(tuple(c[cut:] for c in now))
    if held:
        done = [np.concatenate(c) for c in zip(*held)]
        yield links(done[0], done[1], done[2].view(np.uint64), done[3])


def near_links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all that differ in 4 bits at most, directly or through others."""
    spark = fps.sparkSession
    # a fingerprint becomes a hundred rows, so even few of them are dealt to all tasks
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = stage(fps.select("fp").distinct(), "fingerprints").repartition(tasks, "fp")
    emitted = distinct.mapInArrow(_emit, "key long, fp long, side byte")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")  # rows of three numbers
    # buckets of one fingerprint or one side link nothing; those of very many are cut into blocks, and each pair of blocks is a bucket
    sizes = emitted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("s0"), F.max("side").alias("s1"))
    sizes = sizes.where("n > 1 and (s1 = 0 or s0 <> s1)").select("key", "n")
    # Spark sizes both sides as a few rows a fingerprint and would broadcast a hundred times what it expects
    rows = emitted.hint("merge").join(sizes, "key")
    parts = F.ceil(F.col("n") * 2 / bucket).cast("long")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), parts)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda other: F.least(mine, other) * parts + F.greatest(mine, other))
    blocks = F.when(F.col("n") <= bucket, F.array(F.lit(0).cast("long"))).otherwise(pairs)
    dealt = rows.select("key", F.explode(blocks).alias("block"), "fp", "side").repartition("key", "block").sortWithinPartitions("key", "block", "fp")
    return dealt.mapInArrow(_link, "a long, b long").distinct()


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id, fp: one row for each row of `docs`."""
    mine = stage(fingerprints(docs), "doc-fingerprints")
    roots = stage(components(near_links(mine)), "components")
    found = mine.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    named = stage(found.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "named")
    names = stage(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "names")
    table = stage(join_groups(named, names, "root", "members").select("fp", "n", "component_id"), "named-fingerprints")
    out = join_groups(mine, table, "fp", "n")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component, that of its smallest doc_id, with all its columns."""
    return rows_kept(docs, lambda rows: near_dedup(rows).where("doc_id = component_id"))


def op1_simhash_golay(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("fp")
