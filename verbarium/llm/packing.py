"""Bulk-synchronous best-fit packing of tokenised documents into sequences of fixed capacity.

Documents longer than a sequence are cut; the pieces are sorted by length in ranges over the cluster and ranked inside their length. A
sequence is a bin; its free space is a gap. Lengths and gaps are whole numbers up to the capacity, so sorted documents and sorted gaps are
runs of equals: a run of documents is (length, number, next rank), a run of gaps (size, number, first bin). A superstep, see `superstep`, sorts both by size, finds
every length's successor among the gaps (the smallest gap that holds it), resolves conflicts by rank (longer documents first; those that lose a gap take the next one up, or
wait), and updates the gaps. Supersteps repeat until all are placed; bins are opened for documents that no gap holds, as many as they need at least. There are a few thousand runs and some tens of
supersteps however large the corpus is, so they are one task of one job; all that has a row for each document (lengths, ranks, places) is distributed, and each piece finds its run, thus its
bin and offset, by length and rank.

Defined cases: a null text is an empty one, whose only token is the end mark; repeated rows are packed each; pieces that tie in length are ranked by
doc_id, piece and digest; null doc_ids keep their rows; texts of any length are encoded whole and cut after that; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_lexicon import VOCABULARY, encoder
from .common import as_texts, map_batches, open_mapped, publish, running, small_batches, stage

CAPACITY = 4096
END_ID = 1


def pieces(docs: DataFrame, capacity: int = CAPACITY, json_name: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document's ids, each document's end mark included."""
    small_batches(docs.sparkSession, 1000)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end = encoder(json_name), pack("<I", end_id)
        for batch in batches:
            flat, counts = e.encode_batch(batch.column("text"))
            view, stops = memoryview(flat).cast("B"), (4 * np.cumsum(counts)).tolist()
            rows: list[tuple] = []
            for doc_id, low, high in zip(batch.column("doc_id").to_pylist(), [0, *stops], stops):
                size = high - low + 4
                for k, at in enumerate(range(0, size, 4 * capacity)):
                    cut = view[low + at : min(low + at + 4 * capacity, high)]
                    check, n = zlib.crc32(cut), len(cut)
                    if at + 4 * capacity >= size:  # the end mark belongs to the last piece
                        check, n = zlib.crc32(end, check), n + 4
                    rows.append((doc_id, k, at // 4, n // 4, check))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length int, ids_crc32 long")


def superstep(gaps: np.ndarray, docs: np.ndarray, capacity: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round over the runs. gaps: size, number, first bin; docs: length, number left, next rank. Returns both as they are afterwards, and who went where
    (length, first rank, number, pieces a bin, first bin, offset). Lengths of `least` and less wait.

    Sorted by size, the gaps are slots 0, 1, ... A run of documents may use the slots from its successor up, `each` pieces a slot. Going down from the
    longest, a run gets the slots that it needs or, if fewer are left above its successor, those: with N slots needed and A slots existing from a
    run up, the slots used by it and all longer ones are N + min(0, least A - N so far). Going up from the shortest, each run then starts at its successor
    or where the one before it ends. Laying the runs over the gaps gives segments of equal documents in equal gaps.
    """
    gaps, docs = gaps[np.lexsort((gaps[:, 2], gaps[:, 0]))], docs[np.argsort(docs[:, 0])]
    stops = np.cumsum(gaps[:, 1])
    begins, total = stops - gaps[:, 1], int(gaps[:, 1].sum())
    fits = np.searchsorted(gaps[:, 0], docs[:, 0])  # the first gap that holds a length
    held = (fits < len(gaps)) & (docs[:, 0] > least)
    at = np.minimum(fits, len(gaps) - 1)
    first = np.where(fits < len(gaps), begins[at], total) if len(gaps) else np.full(len(docs), total)
    each = np.where(held, gaps[at, 0] // docs[:, 0], 0) if len(gaps) else np.zeros(len(docs), dtype=np.int64)
    wanted = np.where(held, -(-docs[:, 1] // np.maximum(each, 1)), 0)
    needed = np.cumsum(wanted[::-1])
    used = needed + np.minimum(0, np.minimum.accumulate((total - first)[::-1] - needed))
    take = np.diff(np.maximum.accumulate(used), prepend=0)[::-1]
    on = np.flatnonzero(take > 0)
    before = np.cumsum(take[on]) - take[on]
    start = before + np.maximum.accumulate(first[on] - before)
    placed = np.minimum(docs[on, 1], take[on] * each[on])
    left = docs.copy()
    left[on, 1] -= placed
    left[on, 2] += placed
    marks = np.unique(np.concatenate([begins, start, start + take[on], [total]]))
    pos, width = marks[:-1], np.diff(marks)
    gap = gaps[np.searchsorted(begins, pos, side="right") - 1]
    bins = gap[:, 2] + pos - begins[np.searchsorted(begins, pos, side="right") - 1]
    run = np.searchsorted(start, pos, side="right") - 1
    inside = (run >= 0) & (pos < (start + take[on])[run]) if len(on) else np.zeros(len(pos), dtype=bool)
    untouched = np.stack([gap[:, 0], width, bins], axis=1)[~inside]
    run, gap, bins, width, pos = run[inside], gap[inside], bins[inside], width[inside], pos[inside]
    doc, per = docs[on[run]], each[on[run]]
    done = (pos - start[run]) * per
    copies = np.minimum(width * per, placed[run] - done)
    went = np.stack([doc[:, 0], doc[:, 2] + done, copies, per, bins, capacity - gap[:, 0]], axis=1)
    full = np.stack([gap[:, 0] - per * doc[:, 0], copies // per, bins], axis=1)
    last = np.stack([gap[:, 0] - copies % per * doc[:, 0], (copies % per > 0).astype(np.int64), bins + copies // per], axis=1)
    after = np.concatenate([untouched, full, last])
    return after[(after[:, 0] > 0) & (after[:, 1] > 0)], left[left[:, 1] > 0], went[went[:, 2] > 0]


def rounds(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """`lengths`: length, number. Returns who went where over all supersteps, and the number of bins.

    First come pieces over half the capacity, then those over a quarter, then all, so that short ones don't take what longer ones need. Bins are opened
    for what no gap holds: one for each piece over half the capacity, for others as many as their tokens fill.
    """
    docs, gaps, bins, went = np.column_stack([lengths, np.zeros(len(lengths), dtype=np.int64)]).astype(np.int64), np.zeros((0, 3), dtype=np.int64), 0, []
    while len(docs):
        longest, largest = docs[:, 0].max(), gaps[:, 0].max(initial=0)
        least = next(x for x in (capacity // 2, capacity // 4, 0) if longest > x)
        homeless = docs[:, 0] > max(least, largest)
        alone = docs[docs[:, 0] > max(capacity // 2, largest), 1].sum()
        if more := max(alone, -(-(docs[homeless, 0] * docs[homeless, 1]).sum() // capacity)):
            gaps, bins = np.concatenate([gaps, [[capacity, more, bins]]]), bins + int(more)
        gaps, docs, placed = superstep(gaps, docs, capacity, least)
        went.append(placed)
    return (np.concatenate(went) if went else np.zeros((0, 6), dtype=np.int64)), bins


PLACED = ["s", "at", "n", "each", "bin", "offset"]


def best_fit(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`lengths`: length, n. Who went where, from all supersteps: a job of one task, as the runs are `capacity` rows at most. It depends on the lengths alone, so a lost executor
    costs this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.column_stack([b.column(c).to_numpy().astype(np.int64) for c in ("length", "n")]) for b in batches if b.num_rows]
        went, _ = rounds(np.concatenate(held) if held else np.zeros((0, 2), dtype=np.int64), capacity)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in went.T], PLACED)

    return lengths.select("length", "n").coalesce(1).mapInArrow(run, ", ".join(f"{c} long" for c in PLACED))


@lru_cache(maxsize=2)
def _plan(uri: str) -> tuple[np.ndarray, np.ndarray]:
    """The runs, and (length, first rank) of each as one number: ranks stay below 2^48."""
    runs = np.load(io.BytesIO(open_mapped(uri)))
    return runs, runs[:, 0] << 48 | runs[:, 1]


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to the rows of pieces()."""
    spark = cut.sparkSession
    held = stage(cut.withColumn("one", F.lit(1).cast("long")), "pieces")
    ranked = running(held, ["length"], ["doc_id", "piece", "ids_crc32"], "one").drop("one", "before")
    went = best_fit(held.groupBy("length").agg(F.count(F.lit(1)).alias("n")), capacity).collect()
    runs = np.array([tuple(r) for r in went], dtype=np.int64).reshape(-1, 6)
    out = io.BytesIO()
    np.save(out, runs[np.lexsort((runs[:, 1], runs[:, 0]))])
    uri = publish(spark, "plan", out.getvalue())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        plan, order = _plan(uri)
        length, rank = batch.column("length").to_numpy().astype(np.int64), batch.column("seq").to_numpy()
        row = plan[np.searchsorted(order, length << 48 | rank, side="right") - 1]
        k = rank - row[:, 1]
        bin_no, offset = row[:, 4] + k // row[:, 3], row[:, 5] + (k % row[:, 3]) * length
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(bin_no), pa.array(offset)], [*names, "sequence_id", "offset"])

    return map_batches(ranked, run, "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, json_name: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    out = place(pieces(docs, capacity, json_name, end_id), capacity)
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
