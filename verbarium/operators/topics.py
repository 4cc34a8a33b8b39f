"""Topics: vocabulary, a seeded, repeatable sampler for small corpora, and what follows from a model. Models at scale are in `variational`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import running
from .ngrams import is_topic_token, tokenize, topic_tokens

RESIDUAL = "other"
SEED_BOOST = 1000


def tokens(docs: DataFrame, stopwords: list[str] = ()) -> DataFrame:
    """id, pos, term."""
    found = topic_tokens("text")
    if stopwords:
        banned = F.array(*[F.lit(w) for w in stopwords])
        found = F.filter(found, lambda t: ~F.array_contains(banned, t))
    return docs.select("id", F.posexplode(found).alias("pos", "term"))


def vocabulary(terms: DataFrame, min_term_freq: int = 2, min_doc_freq: int = 2, n_docs: int | None = None) -> DataFrame:
    """term_id, term, n, n_docs of the terms that are frequent enough, numbered in code-unit order.

    The numbers are ranks over ranges of terms, so no task sees the whole vocabulary.
    """
    least_docs = min_doc_freq if n_docs is None else min(min_doc_freq, max(1, n_docs))
    by_doc = terms.groupBy("term", "id").agg(F.count(F.lit(1)).alias("n"))
    kept = by_doc.groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs")).where((F.col("n") >= min_term_freq) & (F.col("n_docs") >= least_docs))
    return _numbered(kept)


def _numbered(kept: DataFrame) -> DataFrame:
    return running(kept, [], ["term"], "n").select(F.col("seq").cast("int").alias("term_id"), "term", "n", "n_docs")


def bags(docs: DataFrame) -> DataFrame:
    """id, terms, counts: the different words of each id, terms or not (a word is judged once, by vocabulary_of), with how often it says them, counted where the text is read. Only if rows share
    an id are they exchanged to be added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("t").value_lengths().to_numpy()
            said = batch.column("t").flatten().dictionary_encode()
            size = max(len(said.dictionary), 1)
            pairs, n = np.unique(np.repeat(np.arange(batch.num_rows), lengths) * size + said.indices.to_numpy(), return_counts=True)
            ends = pa.array(np.append(0, np.cumsum(np.bincount(pairs // size, minlength=batch.num_rows))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (said.dictionary.take(pa.array(pairs % size)), pa.array(n.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *lists], ["id", "terms", "counts"])

    kind = docs.schema["id"].dataType.simpleString()
    out = docs.select("id", tokenize("text").alias("t")).mapInArrow(run, f"id {kind}, terms array<string>, counts array<long>")
    if docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return out
    each = out.select("id", F.inline(F.arrays_zip("terms", "counts"))).groupBy("id", "terms").agg(F.sum("counts").alias("counts"))
    return each.groupBy("id").agg(F.collect_list(F.struct("terms", "counts")).alias("t")).select("id", F.col("t.terms").alias("terms"), F.col("t.counts").alias("counts"))


def vocabulary_of(counted: DataFrame, min_term_freq: int = 2, min_doc_freq: int = 2) -> DataFrame:
    """vocabulary() of what bags() gives."""
    each = counted.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("n"))))
    kept = each.groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs")).where((F.col("n") >= min_term_freq) & (F.col("n_docs") >= min_doc_freq) & is_topic_token(F.col("term")))
    return _numbered(kept)


def encode(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """id, pos, term_id."""
    return terms.join(vocab.select("term", "term_id"), "term").select("id", "pos", "term_id")


def dropped(docs: DataFrame, encoded: DataFrame) -> DataFrame:
    """Documents without any term of the vocabulary."""
    return docs.join(encoded.select("id").distinct(), "id", "left_anti")


# -- the repeatable sampler ------------------------------------------------------------------------------------------------------


def random_numbers(seed: int) -> Iterator[float]:
    """Mulberry32: uniform numbers from a 32-bit state (a published generator)."""
    full, state = 0xFFFFFFFF, seed & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & full
        x = ((state ^ state >> 15) * (state | 1)) & full
        x ^= (x + ((x ^ x >> 7) * (x | 61) & full)) & full
        yield (x ^ x >> 14) / 4294967296


def gibbs(documents: list[list[int]], size: int, k: int, beta: list[list[float]], alpha: float, iterations: int, seed: int) -> tuple[list[list[float]], list[list[float]]]:
    """Collapsed Gibbs sampling, token after token: term weights for each topic and topic weights for each document. It is sequential by
    nature, so it is for corpora that fit one task."""
    draw = random_numbers(seed)
    in_doc = [[0] * k for _ in documents]
    in_topic = [[0] * size for _ in range(k)]
    of_topic = [0] * k
    said = []
    for counts, doc in zip(in_doc, documents):
        mine = [int(next(draw) * k) for _ in doc]
        for w, t in zip(doc, mine):
            counts[t] += 1
            in_topic[t][w] += 1
            of_topic[t] += 1
        said.append(mine)
    mass = [sum(row) for row in beta]
    for _ in range(iterations):
        for counts, doc, mine in zip(in_doc, documents, said):
            for at, w in enumerate(doc):
                t = mine[at]
                counts[t] -= 1
                in_topic[t][w] -= 1
                of_topic[t] -= 1
                weights = [(counts[j] + alpha) * ((in_topic[j][w] + beta[j][w]) / (of_topic[j] + mass[j])) for j in range(k)]
                left = next(draw) * _in_order(weights)
                for t, x in enumerate(weights):
                    left -= x
                    if left <= 0:
                        break
                mine[at] = t
                counts[t] += 1
                in_topic[t][w] += 1
                of_topic[t] += 1
    terms = [[(n + b) / (of_topic[t] + mass[t]) for n, b in zip(in_topic[t], beta[t])] for t in range(k)]
    topics = [[(n + alpha) / (len(doc) + k * alpha) for n in counts] for counts, doc in zip(in_doc, documents)]
    return terms, topics


def _in_order(xs: list[float]) -> float:
    """Plain addition from left to right (sum() compensates)."""
    total = 0.0
    for x in xs:
        total += x
    return total


def seed_dictionary(names: list[str], words: list[list[str]]) -> list[tuple[str, list[str]]]:
    """Named topics with their distinct lower-cased seed words; topics without words go; none left is an error."""
    out = []
    for k, name in enumerate(names or [], 1):
        own = list(dict.fromkeys(w.strip().lower() for w in (words[k - 1] if k <= len(words) else []) or [] if w.strip()))
        if own:
            out.append(((name or "").strip() or f"Topic{k:02d}", own))
    if not out:
        raise ValueError("At least one topic must have seed words.")
    return out


def sample_lda(encoded: DataFrame, vocab: DataFrame, k: int = 5, iterations: int = 200, seed: int = 1234, alpha: float | None = None, beta: float = 0.1,
               seeds: list[tuple[str, list[str]]] | None = None, boost: float = SEED_BOOST) -> DataFrame:
    """kind ('term' or 'document'), topic, name, item (term or document), weight: the repeatable sampler as one grouped task. It draws what a sequential sampler draws, to
    check small corpora against one; for others there is variational.fit(), with or without seeds.

    With `seeds` the topics are those named, with raised priors for their words, and a residual one.
    """
    names = [n for n, _ in seeds] + [RESIDUAL] if seeds else [f"Topic{t + 1:02d}" for t in range(k)]
    boosts = [set(w) for _, w in seeds] + [set()] if seeds else [set()] * k
    topics = len(names)
    rows = encoded.join(vocab.select("term_id", "term"), "term_id")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "pos"])
        terms = dict(zip(pdf.term_id, pdf.term))
        ids = sorted(terms)
        place = {t: i for i, t in enumerate(ids)}
        docs = [(d, [place[t] for t in g.term_id]) for d, g in pdf.groupby("id", sort=False)]
        prior = [[beta * boost if terms[t] in own else beta for t in ids] for own in boosts]
        by_term, by_doc = gibbs([d for _, d in docs], len(ids), topics, prior, 50 / topics if alpha is None else alpha, iterations, seed)
        out = [("term", t, names[t], terms[i], by_term[t][place[i]]) for t in range(topics) for i in ids]
        out += [("document", t, names[t], d, w[t]) for (d, _), w in zip(docs, by_doc) for t in range(topics)]
        return pd.DataFrame(out, columns=["kind", "topic", "name", "item", "weight"])

    # one group on purpose: each draw depends on the one before
    return rows.groupBy(F.lit(1).alias("all")).applyInPandas(run, "kind string, topic int, name string, item string, weight double")


def top_terms(weights: DataFrame, n: int = 10) -> DataFrame:
    """topic, rank, term, weight: the heaviest terms of each topic, ties in vocabulary order."""
    w = Window.partitionBy("topic").orderBy(F.desc("weight"), "term_id")
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("topic", "rank", "term", "weight")


def assign(weights: DataFrame) -> DataFrame:
    """id, topic: the heaviest topic of each document, the first of equals."""
    best = F.max(F.struct("weight", (-F.col("topic")).alias("t")))
    return weights.groupBy("id").agg(best.alias("b")).select("id", (-F.col("b.t")).alias("topic"), F.col("b.weight").alias("weight"))


def topic_shares(assigned: DataFrame) -> DataFrame:
    """topic, n, share (percent of documents)."""
    counts = assigned.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") * 100.0 / assigned.agg(F.count(F.lit(1)).alias("all")).scalar())
