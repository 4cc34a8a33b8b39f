"""Language identification with segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability in each language. A word has many segmentations into pieces; its probability in
a language is the sum over all of them, which a forward pass computes, and a text's is the product over its words. The pieces'
probabilities are fitted by expectation-maximisation (forward and backward) on the word counts of a bounded sample of labelled texts.

A text is scored whole. Each worker remembers the log-probabilities of a bounded number of white-space pieces, so the forward pass runs
for new words only. Every lang value is learned; the model takes 8 bytes for each piece and language (256 kB a language).

Defined cases: `und` with score 0 where the text is null or has no letter (or nothing was learned); a null lang, text or doc_id is no training
row, and a null doc_id isn't held out; of languages that tie the first by name is predicted; repeated rows get the same prediction; very long texts and
words are scored whole, but words of over SHORT letters don't train; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import io
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .automaton import Automaton, compile_words
from .common import as_texts, map_batches, open_mapped, publish, resident, small_batches, where_text

VOCABULARY = "piece_bpe_32k.model"
FOLDS, HELD_OUT = 5, 0
#: The sample: about this many texts of each language, and of their words so many distinct ones, the most frequent.
SAMPLE_DOCS, SAMPLE_WORDS = 250, 20_000
ROUNDS = 3
#: Probability of a character that no piece covers, the same in all languages.
UNKNOWN = 1e-8
#: White-space pieces, and words, that a worker remembers at most, and numbers for them.
CACHE, CACHE_CELLS = 200_000, 4_000_000
#: Characters of words that pass together; longer ones are rescaled one by one, as are those whose probability falls below TINY in some language.
SHORT, TINY = 30, 1e-200
LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"


@lru_cache(maxsize=1)
def vocabulary(model_name: str = VOCABULARY) -> list[str]:
    """The ordinary pieces of the vocabulary."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path(model_name))
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def piece_trie(pieces: list[str]) -> tuple[Automaton, list[int]]:
    """The automaton of the pieces, and the piece of each rank."""
    trie = Automaton(memoryview(compile_words([w.encode() for w in pieces], [[i] for i in range(len(pieces))])))
    return trie, sorted(range(len(pieces)), key=lambda i: pieces[i].encode())


class Lattice:
    """All segmentations of many short words: edges (word w, from byte i, to byte j, rank of the piece). The automaton walks from every
    character of every word at once. A character that is no piece gives an edge of its own, whose rank comes after the pieces'."""

    def __init__(self, words: list[str], trie: Automaton):
        texts = [(MARK + w).encode() for w in words]
        self.n, self.size = len(texts), np.array([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        first = np.cumsum(self.size) - self.size
        heads = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of characters
        word = np.repeat(np.arange(self.n), self.size)[heads]
        step = np.diff(np.append(heads, len(data)))
        rank, state, at, end = np.zeros(len(heads), dtype=np.int64), np.full(len(heads), trie.root, dtype=np.int64), heads.copy(), (first + self.size)[word]
        row, single = np.arange(len(heads)), np.zeros(len(heads), dtype=bool)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (head, end, rank)
        while len(row):
            on, arc = trie.step(state, data[at])
            row, at, end, rank = row[on], at[on] + 1, end[on], rank[on] + trie.outs[arc]
            state = trie.targets[arc].astype(np.int64)
            final = trie.finals[state] == 1
            if final.any():
                found.append((row[final], at[final], rank[final]))
                single[row[final]] |= at[final] == heads[row[final]] + step[row[final]]
            more = at < end
            row, at, end, rank, state = row[more], at[more], end[more], rank[more], state[more]
        bare = np.flatnonzero(~single)
        found.append((bare, heads[bare] + step[bare], np.full(len(bare), len(trie))))
        head, stop, rank = (np.concatenate(x) for x in zip(*found))
        w = word[head]
        i, j = heads[head] - first[w], stop - first[w]
        order = np.argsort(j.astype(np.int16), kind="stable")
        self.w, self.i, self.j, self.rank = w[order], i[order], j[order], rank[order]
        self.ends = np.searchsorted(self.j, np.arange(1, self.size.max() + 2))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Sums over the ways to each byte: (byte, word, column) from probabilities (rank, column)."""
        k = p.shape[1]
        alpha, q = np.zeros((self.size.max() + 1, self.n, k)), p[self.rank]
        alpha[0] = 1.0
        for j, (a, b) in enumerate(zip(self.ends, self.ends[1:]), 1):
            if a < b:
                flow = alpha[self.i[a:b], self.w[a:b]] * q[a:b]
                for m in range(k):
                    alpha[j, :, m] = np.bincount(self.w[a:b], flow[:, m], self.n)
        return alpha

    def uses(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each rank over all segmentations of the counted words, from one column of probabilities."""
        alpha, q = self.forward(p[:, None])[:, :, 0], p[self.rank]
        whole = alpha[self.size, np.arange(self.n)]
        beta = np.zeros_like(alpha)
        beta[self.size, np.arange(self.n)] = 1.0
        back = np.argsort(self.i.astype(np.int16), kind="stable")
        w, j, qb = self.w[back], self.j[back], q[back]
        starts = np.searchsorted(self.i[back], np.arange(self.size.max() + 1))
        for i in range(self.size.max() - 1, -1, -1):
            a, b = starts[i], starts[i + 1]
            if a < b:
                beta[i] += np.bincount(w[a:b], qb[a:b] * beta[j[a:b], w[a:b]], self.n)
        share = np.divide(counts, whole, out=np.zeros(self.n), where=whole > 0)
        return np.bincount(self.rank, alpha[self.i, self.w] * q * beta[self.j, self.w] * share[self.w], len(p))


class Unigrams:
    """Piece probabilities in several languages, and the forward pass over all segmentations."""

    def __init__(self, pieces: list[str], table: np.ndarray, languages: list[str], priors: list[float]):
        self.languages, self.priors = languages, np.log(np.asarray(priors)) if priors else np.zeros(0)
        self.k, self.pieces, self.table = len(languages), pieces, table
        self.longest = max(map(len, pieces), default=1)
        self.p = {w: tuple(row) for w, row in zip(pieces, table.tolist())}
        self.zero = np.zeros(self.k)
        self.trie, order = piece_trie(pieces)
        # by rank in the automaton; the last row is that of unknown characters
        self.by_rank = np.concatenate([table[order].reshape(len(order), self.k), np.full((1, self.k), UNKNOWN)])
        self.words, self.known = _Rows(self.k), _Rows(self.k)

    def long_word(self, word: str) -> list[float]:
        """Log-probability of one word of any length in each language: forward pass, rescaled against underflow."""
        text, get, longest, k = MARK + word, self.p.get, self.longest, self.k
        n, span = len(text), range(k)
        alpha: list[list[float] | None] = [[1.0] * k] + [None] * n
        scale = [0.0] * k
        for j in range(1, n + 1):
            total = [0.0] * k
            for i in range(max(0, j - longest), j):
                p = get(text[i:j])
                if p is None:
                    if i < j - 1:
                        continue
                    p = (UNKNOWN,) * k
                a = alpha[i]
                for m in span:
                    total[m] += a[m] * p[m]
            alpha[j] = total
            if min(total) < 1e-200:
                for m in span:
                    s = total[m]
                    scale[m] += math.log(s)
                    for i in range(max(0, j - longest), j + 1):
                        alpha[i][m] /= s
        return [math.log(alpha[n][m]) + scale[m] for m in span]

    def forward(self, words: list[str]) -> np.ndarray:
        """Log-probabilities of many words, a row each. Short words pass together: the automaton of pieces walks from every
        character of every word at once, and what it finds are the edges of the words' lattices, summed up end by end."""
        out = np.empty((len(words), self.k))
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        for i in set(range(len(words))) - set(short):
            out[i] = self.long_word(words[i])
        short.sort(key=lambda i: len(words[i]))
        together = max(50, 16_000 // self.k)
        for low in range(0, len(short), together):
            part = np.array(short[low : low + together])
            lattice = Lattice([words[i] for i in part], self.trie)
            p = lattice.forward(self.by_rank)[lattice.size, np.arange(lattice.n)]
            out[part] = np.log(np.maximum(p, TINY))
            for i in part[(p < TINY).any(axis=1)].tolist():
                out[i] = self.long_word(words[i])
        return out

    def _new_pieces(self, pieces: list[str]) -> np.ndarray:
        """Rows of white-space pieces: sums over their words."""
        split = [[w for w in LETTERS.findall(p.lower()) if any(map(str.isalpha, w))] for p in pieces]
        words = list(dict.fromkeys(w for ws in split for w in ws))
        rows = self.words.rows(words, self.forward)
        place = dict(zip(words, range(len(words))))
        flat = np.array([place[w] for ws in split for w in ws], dtype=np.int64)
        owner = np.repeat(np.arange(len(pieces)), [len(ws) for ws in split])
        return np.stack([np.bincount(owner, rows[flat, m], len(pieces)) for m in range(self.k)], axis=1) if len(flat) else np.zeros((len(pieces), self.k))

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Log-probability of each text in each language, without priors; 0 if it has no letter."""
        split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        rows = self.known.rows(coded.dictionary.to_pylist(), self._new_pieces)
        index = coded.indices.to_numpy()
        owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        return np.stack([np.bincount(owner, rows[index, m], len(texts)) for m in range(self.k)], axis=1) if len(index) else np.zeros((len(texts), self.k))

    def predict(self, texts: pa.Array) -> list[tuple[str, float]]:
        if not self.k:
            return [("und", 0.0)] * len(texts)
        z = self.scores(texts)
        lettered = z.any(axis=1)  # every letter lowers the log-probability
        z = z + self.priors
        e = np.exp(z - z.max(axis=1, keepdims=True))
        best, score = e.argmax(axis=1), e.max(axis=1) / e.sum(axis=1)
        return [(self.languages[b], s) if on else ("und", 0.0) for b, s, on in zip(best.tolist(), score.tolist(), lettered.tolist())]


class _Rows:
    """Remembers the rows of a bounded number of strings."""

    def __init__(self, k: int):
        self.at: dict[str, int] = {}
        self.room = max(1000, min(CACHE, CACHE_CELLS // max(1, k)))
        self.table = np.zeros((1000, k))

    def rows(self, strings: list[str], make) -> np.ndarray:
        get = self.at.get
        place = np.array([get(x, -1) for x in strings], dtype=np.int64)
        new = np.flatnonzero(place < 0)
        out = self.table[place]
        if len(new):
            fresh = [strings[i] for i in new]
            made = out[new] = make(fresh)
            if len(self.at) + len(fresh) > self.room:
                self.at.clear()
            kept = [i for i, x in enumerate(fresh) if len(x) < 64][: self.room]
            low = len(self.at)
            while low + len(kept) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[low : low + len(kept)] = made[kept]
            self.at.update(zip([fresh[i] for i in kept], range(low, low + len(kept))))
        return out


def fit_pieces(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities, a column for each language of `counts` in order, by expectation-maximisation (forward and backward) over words of
    up to SHORT characters; smoothed with the mean over languages."""
    trie, order = piece_trie(pieces)
    found = []
    for known in counts.values():
        words = sorted((w for w in known if len(w) <= SHORT), key=lambda w: (len(w), w))
        parts = [words[low : low + 4000] for low in range(0, len(words), 4000)]
        lattices = [(Lattice(part, trie), np.array([known[w] for w in part], dtype=float)) for part in parts]
        p = np.full(len(pieces) + 1, 1.0 / len(pieces))
        p[-1] = UNKNOWN
        uses = np.zeros(len(pieces) + 1)
        for _ in range(rounds):
            uses = sum((lattice.uses(p, n) for lattice, n in lattices), np.zeros(len(pieces) + 1))
            p[:-1] = np.maximum(uses[:-1] / max(uses[:-1].sum(), 1.0), UNKNOWN)
        by_piece = np.zeros(len(pieces))
        by_piece[order] = uses[:-1]
        found.append(by_piece)
    uses = np.array(found).reshape(len(counts), len(pieces)).T
    mean = uses.sum(axis=1) + 0.01
    mean /= mean.sum()
    weight = 0.01 * uses.sum(axis=0) + 1.0
    return (uses + weight * mean[:, None]) / (uses.sum(axis=0) + weight)


def fold(df: DataFrame, folds: int) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, model_name: str = VOCABULARY) -> Unigrams:
    """Fit on rows outside the held-out fold. Languages are counted on all rows; the sample is then picked by hash at each language's
    rate, its words are counted where the texts are, whole texts of any length, and SAMPLE_WORDS counted words a language come to the driver."""
    spark = docs.sparkSession
    rows = fold(docs.select("doc_id", "text", "lang"), FOLDS).where(F.col("lang").isNotNull() & (F.col("fold") != HELD_OUT) & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Unigrams([], np.zeros((0, 0)), [], [])
    rates = spark.createDataFrame([(lang, int(min(1.0, sample_docs / n) * (1 << 30))) for lang, n in sizes.items()], "lang string, rate long")
    picked = rows.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("rate"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[tuple[str, str]] = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), as_texts(batch.column("text"))):
                counts.update([(lang, w) for w in LETTERS.findall(text.lower()) if len(w) <= SHORT])
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

    words = picked.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    first = words.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("k") <= SAMPLE_WORDS)
    counts: dict[str, dict[str, int]] = {lang: {} for lang in sorted(sizes)}
    for r in first.select("lang", "word", "n").collect():
        counts[r.lang][r.word] = r.n
    pieces = vocabulary(model_name)
    total = sum(sizes.values())
    return Unigrams(pieces, fit_pieces(counts, pieces), list(counts), [sizes[lang] / total for lang in counts])


def _load(uri: str, languages: tuple[str, ...], priors: tuple[float, ...]) -> Unigrams:
    return resident(("language", uri), lambda: Unigrams(vocabulary(), np.load(io.BytesIO(open_mapped(uri))), list(languages), list(priors)))


def predictor(docs: DataFrame) -> Callable[[pa.Array], list[tuple[str, float]]]:
    """What gives language and score of texts in a worker, fitted on `docs`."""
    spark = docs.sparkSession
    small_batches(spark)
    model = fit(docs)
    languages, priors = tuple(model.languages), tuple(np.exp(model.priors).tolist())
    out = io.BytesIO()
    np.save(out, model.table)
    uri = publish(spark, "unigrams", out.getvalue())

    def predict(texts: pa.Array) -> list[tuple[str, float]]:
        m = _load(uri, languages, priors) if languages else Unigrams([], np.zeros((0, 0)), [], [])
        return m.predict(texts)

    return predict


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of `docs`; only the text decides."""
    predict = predictor(docs)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        said = predict(batch.column("text"))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64())],
            ["doc_id", "held_out", "lang_pred", "score"],
        )

    held_out = F.coalesce(F.col("fold") == HELD_OUT, F.lit(False)).alias("held_out")
    return map_batches(fold(docs.select("doc_id", "text"), FOLDS).select("doc_id", "text", held_out), run, "doc_id long, held_out boolean, lang_pred string, score double")


def known_languages(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose language is recognised, whatever the score: the learned languages are a closed set, so a short text may well lie between
    two of them. All columns come back; each row is judged by its own text, whatever its doc_id."""
    predict = predictor(docs)
    return where_text(docs, lambda texts: [lang != "und" for lang, _ in predict(texts)])


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
