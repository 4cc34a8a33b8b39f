"""Latent Dirichlet allocation at scale, with or without seed words: variational updates as supersteps over all documents.

A document is a row: its terms with their counts and its topic weights (gamma). A superstep sends the model (lambda: a number for each topic and term, so `most_terms` bounds it) to all tasks. These
improve every document's gamma from where it was, and the rows are staged; a second pass over the staged rows adds up, task by task and then by term, how much of each term each topic takes,
and that plus the prior is the next model. The prior may differ for each topic and term, which is what seeds are: their words weigh `boost` times more in their topic, and a residual topic takes what
matches no seed. Each half of a step can only raise the objective (a bound of the corpus's likelihood), which is returned for every step. Tables of earlier steps are deleted.

Defined cases: documents without any term of the vocabulary are left out, as are terms beyond `most_terms` (the most frequent stay, ties in vocabulary order); seed words outside the vocabulary have no
effect; an empty corpus gives an empty model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import discard, fresh_dir, publish, published, ship, spread
from . import topics
from .topics import RESIDUAL, SEED_BOOST

#: Terms that a model takes at most: 1.6 MB of weights a topic.
MOST_TERMS = 200_000

#: Rounds over a document in a superstep, and the mean change of gamma that ends them.
ROUNDS, ENOUGH = 50, 1e-3

#: Numbers of a block of documents that are improved together, four megabytes.
CELLS = 1 << 19


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence to arguments over 6, then the asymptotic series."""
    x = np.asarray(x, dtype=float)
    below = (1 / np.add.outer(np.arange(6.0), x)).sum(axis=0)
    i = 1 / (x + 6)
    j = i * i
    return np.log(x + 6) - i / 2 - j * (1 / 12 - j * (1 / 120 - j * (1 / 252 - j * (1 / 240 - j / 132)))) - below


def log_gamma(x: np.ndarray) -> np.ndarray:
    x, product = np.array(x, dtype=float), np.ones(np.shape(x))
    for _ in range(7):
        product *= x
        x += 1
    i = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i / 1680))) / x - np.log(product)


def expected_log(weights: np.ndarray) -> np.ndarray:
    """The expected logarithms under a Dirichlet distribution, by rows."""
    both = digamma(np.concatenate([weights, weights.sum(axis=-1, keepdims=True)], axis=-1))
    return both[..., :-1] - both[..., -1:]


def improved(gamma: np.ndarray, counts: np.ndarray, beta: np.ndarray, alpha: float) -> np.ndarray:
    """Topic weights of some documents (a row each), from `gamma` on, each until its own are at rest; beta: exponents of the expected logarithms of their terms, topics by documents by terms."""
    gamma, rows, moving, ratio = gamma.copy(), np.arange(len(gamma)), np.ones(len(gamma), dtype=bool), np.empty(counts.shape)
    for _ in range(ROUNDS):
        now = gamma[rows]
        theta = np.exp(expected_log(now))
        np.einsum("dk,kdn->dn", theta, beta, out=ratio)  # too small for a linear algebra library's threads, and fresh memory costs more than the sums
        np.add(ratio, 1e-300, out=ratio)
        np.divide(counts, ratio, out=ratio)
        after = alpha + theta * np.einsum("kdn,dn->dk", beta, ratio)
        gamma[rows[moving]] = after[moving]
        moving &= np.abs(after - now).mean(axis=1) >= ENOUGH
        if not moving.any():
            break
        if moving.mean() < 0.75:
            rows, counts, beta = rows[moving], counts[moving], beta[:, moving]
            moving, ratio = np.ones(len(rows), dtype=bool), np.empty(counts.shape)
    return gamma


def share(gamma: np.ndarray, counts: np.ndarray, beta: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The documents' exponents, how often each term is said for each unit of its weight there, and their part of the objective. The two multiplied, with beta, are what a topic takes of a term."""
    logs = expected_log(gamma)
    theta = np.exp(logs)
    norm = np.einsum("dk,kdn->dn", theta, beta) + 1e-300
    n, k = gamma.shape
    part = (counts * np.log(norm)).sum() + ((alpha - gamma) * logs).sum() + log_gamma(gamma).sum() - n * k * log_gamma(np.array(alpha)) + n * log_gamma(np.array(k * alpha)) - log_gamma(gamma.sum(axis=1)).sum()
    return theta, counts / norm, float(part)


def model_part(model: np.ndarray, prior: np.ndarray) -> float:
    """The topics' part of the objective."""
    logs = expected_log(model)
    each = ((prior - model) * logs).sum(axis=1) + log_gamma(model).sum(axis=1) - log_gamma(prior).sum(axis=1) + log_gamma(prior.sum(axis=1)) - log_gamma(model.sum(axis=1))
    return float(each.sum())


@dataclass
class Model:
    names: list[str]
    terms: DataFrame  # topic, name, term, term_id, weight
    documents: DataFrame  # id, topic, name, weight
    objective: list[float]  # after each superstep


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The borders of the rows, and the 32-bit integers that a binary column holds, as Spark passes bytes on as they are and lists number by number."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1] // 4
    return ends - ends[0], np.frombuffer(column.buffers()[2] or b"", dtype="<i4")[ends[0] : ends[-1]]


def _bytes(numbers: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 4).astype(np.int32).tobytes()), pa.py_buffer(numbers.astype("<i4").tobytes())])


def _blocks(batch: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of about the same length together: their rows in the batch, terms and counts (filled up with counts of 0), gammas, and what isn't filling."""
    ends, flat = _numbers(batch.column("terms"))
    counts, gammas = _numbers(batch.column("counts"))[1], batch.column("gamma").flatten().to_numpy().reshape(-1, k)
    starts, lengths = ends[:-1], np.diff(ends)
    order = np.argsort(-lengths, kind="stable")
    low = 0
    while low < len(order):
        longest = max(int(lengths[order[low]]), 1)
        high = min(len(order), low + max(1, CELLS // (longest * k)))
        high = low + int(np.searchsorted(-lengths[order[low:high]], -0.8 * longest + 4, side="right"))
        rows = order[low:max(high, low + 1)]
        inside = np.arange(longest) < lengths[rows][:, None]
        at = np.where(inside, starts[rows][:, None] + np.arange(longest), 0)
        yield rows, flat[at], np.where(inside, counts[at], 0.0), gammas[rows], inside
        low += len(rows)


def _step(docs: DataFrame, uri: str, alpha: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta = published(uri)
        for batch in batches:
            gammas = np.empty((batch.num_rows, len(beta)))
            for rows, terms, counts, gamma, _ in _blocks(batch, len(beta)):
                gammas[rows] = improved(gamma, counts, beta[:, terms], alpha)
            columns = {c: batch.column(c) for c in batch.schema.names} | {"gamma": pa.array(list(gammas), pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, docs.schema)


def _statistics(docs: DataFrame, uri: str, alpha: float, k: int) -> DataFrame:
    """term, s0, s1, ...: what each topic takes of each term; as term -1 the documents' part of the objective. A task for each core, as each may send a row for every term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta = published(uri)
        size = beta.shape[1]
        sums, seen, objective = np.zeros(beta.shape), np.zeros(size, dtype=bool), 0.0
        for batch in batches:
            held, cells = [], 0
            for rows, terms, counts, gamma, inside in _blocks(batch, k):
                theta, ratio, part = share(gamma, counts, beta[:, terms], alpha)
                held.append((terms[inside], ratio[inside], np.repeat(theta, inside.sum(axis=1), axis=0)))
                objective += part
                cells += inside.sum()
                if cells > 1 << 20:
                    _take(sums, seen, held)
                    held, cells = [], 0
            _take(sums, seen, held)
        sums *= beta
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), *(pa.array(np.append(row[at], objective if t == 0 else 0.0)) for t, row in enumerate(sums))], ["term", *(f"s{t}" for t in range(k))])

    few = docs.select("terms", "counts", "gamma").coalesce(docs.sparkSession.sparkContext.defaultParallelism)
    each = few.mapInArrow(run, "term int, " + ", ".join(f"s{t} double" for t in range(k)))
    return each.groupBy("term").agg(*[F.sum(f"s{t}").alias(f"s{t}") for t in range(k)])


def _take(sums: np.ndarray, seen: np.ndarray, held: list) -> None:
    if held:
        terms, ratio, theta = (np.concatenate(x) for x in zip(*held))
        for t in range(len(sums)):
            sums[t] += np.bincount(terms, ratio * theta[:, t], sums.shape[1])
        seen[terms] = True


def fit(encoded: DataFrame, vocab: DataFrame, k: int = 5, seeds: list[tuple[str, list[str]]] | None = None, most_terms: int = MOST_TERMS, **options) -> Model:
    """A model of `encoded` (id, pos, term_id) over `vocab`. With `seeds` (name, words) the topics are these and a residual one, else `k` unnamed ones."""
    spark = encoded.sparkSession
    ship(spark)
    chosen = _chosen(vocab, most_terms)
    numbered = spark.createDataFrame([(r.term_id, n) for n, r in enumerate(chosen)], "term_id int, place int")
    counts = encoded.join(F.broadcast(numbered), "term_id").groupBy("id", "place").agg(F.count(F.lit(1)).cast("int").alias("n"))  # `most_terms` pairs of numbers
    lists = counts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.append(0, np.cumsum(batch.column("terms").value_lengths().to_numpy()))
            made = [_bytes(batch.column(c).flatten().to_numpy(), ends) for c in ("terms", "counts")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made], ["id", "terms", "counts"])

    docs = lists.select("id", F.col("t.place").alias("terms"), F.col("t.n").alias("counts")).mapInArrow(run, f"id {encoded.schema['id'].dataType.simpleString()}, terms binary, counts binary")
    return _supersteps(docs, chosen, k, seeds, **options)


def fit_texts(texts: DataFrame, k: int = 5, seeds: list[tuple[str, list[str]]] | None = None, min_term_freq: int = 2, min_doc_freq: int = 2, most_terms: int = MOST_TERMS, **options) -> Model:
    """The same model from texts (id, text), whose tokens are counted where they are read: only the counts of terms are exchanged, unless rows share an id."""
    ship(texts.sparkSession)
    path = _staged(topics.bags(texts), "bags")
    bags = texts.sparkSession.read.parquet(path)
    chosen = _chosen(topics.vocabulary_of(bags, min_term_freq, min_doc_freq), most_terms)
    words = publish(texts.sparkSession, "words", np.frombuffer("\n".join(r.term for r in chosen).encode(), dtype=np.uint8))  # a term has no line break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(published(words).tobytes().decode().split("\n"), pa.string())
        for batch in batches:
            at = pc.index_in(batch.column("terms").flatten(), value_set=known)
            kept = at.is_valid().to_numpy(zero_copy_only=False)
            place = pc.fill_null(at, -1).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), batch.column("terms").value_lengths().to_numpy())[kept]
            order = np.lexsort((place[kept], row))
            n = np.bincount(row, minlength=batch.num_rows)
            ends = np.append(0, np.cumsum(n[n > 0]))
            made = [_bytes(x[kept][order], ends) for x in (place, batch.column("counts").flatten().to_numpy())]
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(n > 0)), *made], ["id", "terms", "counts"])

    docs = bags.mapInArrow(run, f"id {bags.schema['id'].dataType.simpleString()}, terms binary, counts binary")
    return _supersteps(docs, chosen, k, seeds, path, **options)


def _chosen(vocab: DataFrame, most_terms: int) -> list:
    return sorted(vocab.orderBy(F.desc("n"), "term_id").limit(most_terms).select("term_id", "term").collect())


def _supersteps(counted: DataFrame, chosen: list, k: int, seeds: list[tuple[str, list[str]]] | None, spent: str | None = None, iterations: int = 20, alpha: float | None = None, beta: float = 0.1,
                boost: float = SEED_BOOST, seed: int = 1234) -> Model:
    """counted: id, terms (their places in `chosen`), counts; `spent`: a folder that isn't read after it."""
    spark = counted.sparkSession
    names = [n for n, _ in seeds] + [RESIDUAL] if seeds else [f"Topic{t + 1:02d}" for t in range(k)]
    k, alpha = len(names), (50 / len(names) if seeds else 1 / len(names)) if alpha is None else alpha
    place = {r.term: n for n, r in enumerate(chosen)}
    prior = np.full((k, len(chosen)), float(beta))
    for t, (_, words) in enumerate(seeds or []):
        prior[t, [place[w] for w in words if w in place]] = beta * boost
    model = prior + np.random.default_rng(seed).gamma(100, 1 / 100, prior.shape)  # topics must differ somewhere to come apart
    docs = counted.withColumn("gamma", F.array_repeat(F.lit(1.0), k))
    path, objective = _staged(docs), []
    if spent:
        discard(spent)
    docs = spread(spark.read.parquet(path))
    for n in range(iterations if chosen else 0):
        uri = publish(spark, "model", np.exp(expected_log(model)))
        before, path = path, _staged(_step(docs, uri, alpha))
        docs = spark.read.parquet(path)
        sums = _statistics(docs, uri, alpha, k).toArrow()  # a row for each term of the model
        discard(before)
        at, taken = sums.column("term").to_numpy(), np.array([sums.column(f"s{t}").to_numpy() for t in range(k)])
        after = prior.copy()
        after[:, at[at >= 0]] += taken[:, at >= 0]
        objective.append(float(taken[0, at < 0].sum()) + model_part(model, prior))
        model = after
    weights = model / model.sum(axis=1, keepdims=True) if chosen else model
    one = pa.table({"term": pa.array([r.term for r in chosen], pa.string()), "term_id": pa.array([r.term_id for r in chosen], pa.int32())})
    rows = pa.concat_tables(pa.table({"topic": pa.array([t] * len(chosen), pa.int32()), "name": pa.array([names[t]] * len(chosen), pa.string()), "term": one["term"], "term_id": one["term_id"], "weight": pa.array(weights[t])}) for t in range(k))
    terms = spark.createDataFrame(rows, "topic int, name string, term string, term_id int, weight double")
    topic = F.posexplode("gamma").alias("topic", "g")
    total = F.aggregate("gamma", F.lit(0.0), lambda a, g: a + g)
    named = F.element_at(F.array(*map(F.lit, names)), F.col("topic") + 1)
    documents = docs.select("id", total.alias("total"), topic).select("id", "topic", named.alias("name"), (F.col("g") / F.col("total")).alias("weight"))
    return Model(names, terms, documents, objective)


def _staged(docs: DataFrame, name: str = "documents") -> str:
    path = fresh_dir(docs.sparkSession, name)
    docs.write.parquet(path)
    return path
