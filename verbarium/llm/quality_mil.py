"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is described by frequencies of pairs of character classes, by how varied
its words are and by how often lines and words repeat; a learned layer encodes that. Gated attention, learned from document labels alone, weighs the
passages of a document, and a logistic layer scores the weighted representation. Training takes place on the driver, on a
bounded sample of labelled documents; scoring takes whole texts, each passage of them.

Defined cases: null and empty texts are one empty passage and get a score; labels repeated for a doc_id count once, as their minimum;
null labels, null texts and null doc_ids don't train, and a null doc_id isn't held out; without labels of both kinds every score is the share of label
1 (1 if there are none); equal texts get equal scores, whatever stands beside them; texts over LONG are scored slice by slice, whole; of a labelled
doc_id with several texts all train; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_batches, open_mapped, publish, resident, small_batches, where_text

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
PASSAGE = 64
#: Labelled documents to train on: about this many of each label, none over SAMPLE_CHARS.
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 100_000
HIDDEN, ATTENTION, EPOCHS = 24, 12, 200
#: Bytes above which a text is taken in slices of SLICE passages, so that memory is that of the text and a slice.
LONG, SLICE = 4 << 20, 2048

#: Character classes, by byte.
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:", b"!?", b"'\"()-", b"#*$%&", b"|<>", b"/\\_=+~^`@[]{}"]
N_CLASSES = len(CLASSES) + 1
CLASS_OF = np.full(256, N_CLASSES - 1, dtype=np.uint8)  # the last class: other bytes, those of letters beyond ASCII
for _k, _members in enumerate(CLASSES):
    CLASS_OF[list(_members)] = _k
SPACE = np.zeros(256, dtype=bool)
SPACE[list(b" \t\n\r\x0b\x0c")] = True
FEATURES = N_CLASSES * N_CLASSES + 5
WORD, LINE = re.compile(rb"[^ \t\n\r\x0b\x0c]+"), re.compile(rb"[^\n]+")


def passages(texts: list[bytes], follow: list[bytes] | None = None, traits: list[tuple[float, float]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and the number of passages of each text. `follow`: the byte after each text, where these are slices of
    a longer one; `traits`: repeated lines and variety of words of the whole one."""
    data = np.frombuffer(b"".join(x for pair in zip(texts, follow or [b"\n"] * len(texts)) for x in pair), dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = ends - np.array([len(t) + 1 for t in texts])
    solid = ~SPACE[data]
    solid[ends - 1] = False
    word_at = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    doc_of = np.searchsorted(ends, word_at, side="right")
    n_words = np.bincount(doc_of, minlength=len(texts))
    first_word = np.cumsum(n_words) - n_words
    cut_at = word_at[(np.arange(len(word_at)) - first_word[doc_of]) % PASSAGE == 0]
    per_doc = np.maximum(1, -(-n_words // PASSAGE))
    opening = np.cumsum(per_doc) - per_doc
    bounds = np.empty(per_doc.sum(), dtype=np.int64)
    inner = np.ones(len(bounds), dtype=bool)
    inner[opening] = False
    bounds[opening] = starts
    later = np.ones(len(cut_at), dtype=bool)  # a text's first passage begins with the text itself
    filled = np.flatnonzero(n_words)
    later[(np.cumsum(-(-n_words // PASSAGE)) - -(-n_words // PASSAGE))[filled]] = False
    bounds[inner] = cut_at[later]
    sizes = np.diff(np.append(bounds, len(data)))
    kinds = CLASS_OF[data]
    code = kinds[:-1].astype(np.int64) * N_CLASSES + kinds[1:] + np.repeat(np.arange(len(bounds)) * N_CLASSES**2, sizes)[:-1]
    own = np.ones(len(code), dtype=bool)
    own[ends[:-1] - 1] = False  # what follows a text is the second of a pair, never the first
    pairs = np.bincount(code[own], minlength=len(bounds) * N_CLASSES**2).reshape(len(bounds), -1)
    sizes[opening + per_doc - 1] -= 1
    out = np.zeros((len(bounds), FEATURES), dtype=np.float32)
    out[:, :-5] = np.sqrt(pairs / np.maximum(1, sizes)[:, None])
    k = 0
    for d, text in enumerate(texts):
        words = text.split()
        if traits is None:
            lines = [x for x in text.split(b"\n") if x]
            repeated, varied = _traits(len(lines), len(set(lines)), len(words), len(set(words)))
        else:
            repeated, varied = traits[d]
        for i in range(0, max(1, len(words)), PASSAGE):
            part = words[i : i + PASSAGE]
            n = max(1, len(part))
            out[k, -5:] = (len(set(part)) / n, sum(map(eq, part, part[1:])) / n, sum(map(len, part)) / n / 10, repeated, varied)
            k += 1
    return out, per_doc


def _traits(n_lines: int, distinct_lines: int, n_words: int, distinct_words: int) -> tuple[float, float]:
    return 1 - distinct_lines / max(1, n_lines), distinct_words / max(1.0, n_words**0.75)


def _distinct(parts: Iterator[bytes], block: int = 1 << 20) -> tuple[int, int]:
    """How many, and how many different, by 64-bit digest."""
    n, seen = 0, np.zeros(0, dtype=np.uint64)
    while len(now := np.fromiter(map(xxhash.xxh3_64_intdigest, islice(parts, block)), dtype=np.uint64)):
        n, seen = n + len(now), np.union1d(seen, now)
    return n, len(seen)


def slices(text: bytes, passages_each: int = SLICE) -> Iterator[tuple[bytes, bytes]]:
    """A text in parts that begin where passages do, each with the byte after it."""
    low = 0
    for k, word in enumerate(WORD.finditer(text)):
        if k and k % (PASSAGE * passages_each) == 0:
            yield text[low : word.start()], text[word.start() : word.start() + 1]
            low = word.start()
    yield text[low:], b"\n"


# -- the network -------------------------------------------------------------------------------------------------------------------


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def encode(m: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, ...]:
    """What a passage is (h), the two halves of its gate, and how strongly it asks for attention."""
    h = np.tanh(((x - m["mean"]) / m["dev"]) @ m["W"] + m["b"])
    t, g = np.tanh(h @ m["V"]), _logistic(h @ m["U"])
    return h, t, g, (t * g) @ m["w"]


def forward(m: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    starts = np.cumsum(counts) - counts
    h, t, g, e = encode(m, x)
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
    a = e / np.repeat(_sums(e, starts), counts)
    z = _sums(h * a[:, None], starts)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _logistic(z @ m["c"] + m["c0"]), "starts": starts}


def score_long(m: dict[str, np.ndarray], text: bytes, passages_each: int = SLICE) -> float:
    """forward() of one text, a slice at a time: sums of attention and of weighted passages, rescaled to the largest exponent so far."""
    n_lines, distinct_lines = _distinct(x.group() for x in LINE.finditer(text))
    n_words, distinct_words = _distinct(x.group() for x in WORD.finditer(text))
    traits = _traits(n_lines, distinct_lines, n_words, distinct_words)
    top, total, z = -np.inf, 0.0, 0.0
    for part, after in slices(text, passages_each):
        h, _, _, e = encode(m, passages([part], [after], [traits])[0])
        high = max(top, float(e.max()))
        w = np.exp(e - high)
        keep = np.exp(top - high)
        total, z, top = total * keep + w.sum(), z * keep + w @ h, high
    return float(_logistic((z / total) @ m["c"] + m["c0"]))


def train(x: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """Gradient descent (Adam) on the weighted log-loss of whole documents."""
    r = np.random.default_rng(seed)
    d = x.shape[1]
    share = float((weight * y).sum() / weight.sum())
    m = {
        "W": r.normal(0, d**-0.5, (d, HIDDEN)), "b": np.zeros(HIDDEN), "V": r.normal(0, 0.2, (HIDDEN, ATTENTION)), "U": r.normal(0, 0.2, (HIDDEN, ATTENTION)),
        "w": np.zeros(ATTENTION) + 0.1, "c": r.normal(0, 0.2, HIDDEN), "c0": np.array(np.log(share / (1 - share))),
    }
    fixed = {"mean": x.mean(axis=0), "dev": np.maximum(x.std(axis=0), 0.02)}
    x = (x - fixed["mean"]) / fixed["dev"]
    unit = {"mean": np.float32(0), "dev": np.float32(1)}
    first, second = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    doc = np.repeat(np.arange(len(counts)), counts)
    weight = weight / weight.sum()
    for step in range(1, epochs + 1):
        f = forward(m | unit, x, counts)
        h, t, g, a, starts = f["h"], f["t"], f["g"], f["a"], f["starts"]
        dlogit = weight * (f["p"] - y)
        dz = dlogit[:, None] * m["c"]
        dh = a[:, None] * dz[doc]
        da = (h * dz[doc]).sum(axis=1)
        de = a * (da - _sums(a * da, starts)[doc])
        dt, dg = de[:, None] * m["w"] * g * (1 - t * t), de[:, None] * m["w"] * t * g * (1 - g)
        dh += dt @ m["V"].T + dg @ m["U"].T
        du = dh * (1 - h * h)
        grad = {"W": x.T @ du, "b": du.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": f["z"].T @ dlogit, "c0": dlogit.sum()}
        for k in m:
            grad[k] = grad[k] + 1e-5 * m[k] * (k != "c0")
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
            m[k] = m[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-9)
    return m | fixed


def constant(share: float) -> dict[str, np.ndarray]:
    """The model that gives every text the same score."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    zero = np.zeros
    return {"W": zero((FEATURES, 1)), "b": zero(1), "V": zero((1, 1)), "U": zero((1, 1)), "w": zero(1), "c": zero(1), "c0": np.array(np.log(share / (1 - share))), "mean": zero(FEATURES), "dev": zero(FEATURES) + 1}


# -- DataFrames --------------------------------------------------------------------------------------------------------------------


def fold(df: DataFrame) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, np.ndarray]:
    """Labels outside the held-out fold are counted on all rows and picked by hash at each label's rate; the few thousand ids picked
    (8 bytes each) are broadcast to the documents, of which only passage features come to the driver."""
    rows = fold(labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")))
    rows = rows.where(F.col("fold") != HELD_OUT)
    sizes = {r.quality: r.n for r in rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return constant(float(next(iter(sizes), 1)))
    rate = F.lit(0)
    for value, n in sizes.items():
        rate = F.when(F.col("quality") == value, int(min(1.0, sample_docs / n) * (1 << 30))).otherwise(rate)
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rate).select("doc_id", "quality")
    texts = docs.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, counts = passages(as_bytes(batch.column("text")))
        cuts = np.split(x, np.cumsum(counts)[:-1])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([c.astype(np.float16).tobytes() for c in cuts], pa.binary())], ["doc_id", "quality", "x"])

    found = sorted({(r.doc_id, r.quality, bytes(r.x)) for r in map_batches(texts, run, "doc_id long, quality int, x binary").collect()})
    y = np.array([float(q) for _, q, _ in found])
    if len(set(y)) < 2:
        return constant(y.mean() if len(y) else 1.0)
    cuts = [np.frombuffer(b, dtype=np.float16).reshape(-1, FEATURES) for _, _, b in found]
    taken = {q: float((y == q).sum()) for q in sizes}
    weight = np.array([sizes[int(q)] / taken[int(q)] for q in y])
    return train(np.concatenate(cuts).astype(np.float32), np.array([len(c) for c in cuts]), y, weight)


def _load(uri: str) -> dict[str, np.ndarray]:
    return resident(("quality", uri), lambda: {k: v.astype(np.float32) for k, v in np.load(io.BytesIO(open_mapped(uri))).items()})


def score_texts(m: dict[str, np.ndarray], texts: list[bytes], slab: int = 1 << 20) -> list[float]:
    """Scores of whole texts, some MB of text at a time."""
    out: list[float] = []
    group: list[bytes] = []
    size = 0
    for text in texts:
        if group and (size + len(text) > slab or len(text) > LONG):
            out += forward(m, *passages(group))["p"].tolist()
            group, size = [], 0
        if len(text) > LONG:
            out.append(score_long(m, text))
        else:
            group.append(text)
            size += len(text)
    return out + (forward(m, *passages(group))["p"].tolist() if group else [])


def published(docs: DataFrame, labels: DataFrame) -> str:
    """URI of the model fitted on `docs`."""
    spark = docs.sparkSession
    small_batches(spark)
    out = io.BytesIO()
    np.savez(out, **fit(docs, labels))
    return publish(spark, "quality", out.getvalue())


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs`; only the text decides."""
    uri = published(docs, labels)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = np.array(score_texts(_load(uri), as_bytes(batch.column("text"))))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(F.col("fold") == HELD_OUT, F.lit(False)).alias("held_out")
    return map_batches(fold(docs.select("doc_id", "text")).select("doc_id", "text", held_out), run, "doc_id long, held_out boolean, score double, predicted int")


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that are predicted to be good, with all their columns. Each row is judged by its own text, whatever its doc_id."""
    uri = published(docs, labels)
    return where_text(docs, lambda texts: [s >= threshold for s in score_texts(_load(uri), as_bytes(texts))])


def op5_quality_mil(spark, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
