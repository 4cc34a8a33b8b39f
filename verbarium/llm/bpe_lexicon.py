"""Byte-pair encoding and decoding with a lexicon transducer.

White-space pieces and words of the whole corpus are counted; the most frequent ones (a bounded number) are compiled, with the ids of
their tokens, into a minimal acyclic transducer, which executors map into memory. Words that are not in it are merged exactly, pair by pair
in the order of the vocabulary's merges: the distinct ones of a batch all at once, as rows of a matrix.

Normalising, splitting and merging are done here for the characters of PLAIN, for which the tests compare them with the library one by one;
a piece with any other character is given to the library.

Defined cases: a null text is an empty one, with no ids; repeated rows are encoded each; null doc_ids keep their row; special strings in
texts become special tokens, as is the library's default; very long words are merged with a heap; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, compile_words
from .common import as_texts, map_batches, open_mapped, publish, resident, small_batches, stage

VOCABULARY = "word_bpe_49k.json"
#: White-space pieces, and words, in the transducer at most.
LEXICON = 1 << 18
#: Bytes of words that are merged in matrices of that width; longer words are merged one by one.
WIDTHS = (4, 8, 12, 16, 24, 32, 48)
#: Bytes of pieces that are split and merged at once, or one piece.
AT_ONCE = 1 << 22

PLAIN = re.compile(r"[\x21-\x7e¡-įı-ž‐-‧‰-⁞₠-₿]*")
NOT_PLAIN = r"[^\x21-\x7e¡-įı-ž‐-‧‰-⁞₠-₿]"
#: What Python splits at as white space and the library does not, or the other way round: such texts go to the library whole.
ODD_SPACES = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85")
#: The vocabulary's word pattern, for lower-cased text of PLAIN characters.
LETTERS, DIGITS = "a-zªµºß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĳĵķĸĺļľŀłńņňŉŋōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżž", "0-9²³¹¼½¾"
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^a-zªµºß-öø-ÿā-ž0-9²³¹¼½¾]+")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of each plain character: 0 for a line end, 1 for a letter, 2 for a digit, 3 for others."""
    letter, digit = re.compile(f"[{LETTERS}]"), re.compile(f"[{DIGITS}]")
    return np.array([0 if c == "\n" else 1 if letter.match(c) else 2 if digit.match(c) else 3 for c in map(chr, range(0x2100))], dtype=np.uint8)


def words_of(lines: list[str]) -> pa.Array:
    """What WORDS finds in lines of plain characters, lower-cased, line after line, each followed by a line end."""
    text = "\n".join([*lines, ""]).lower()
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    kind = _kinds()[codes]
    begins = np.append(True, kind[1:] != kind[:-1])[: len(codes)] | (kind == 0) | (kind == 2)
    # an apostrophe that begins a word may be that of 's 't 'm 'd 're 've 'll
    after = np.append(codes, [0, 0])
    mark = np.flatnonzero((codes == ord("'")) & begins)
    a, b = after[mark + 1], after[mark + 2]
    for found, size in ((np.isin(a, [*map(ord, "stmd")]), 2), (np.isin(a, [*map(ord, "rv")]) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")), 3)):
        begins[mark[found] + 1] = False
        begins[mark[found] + size] = True
    width = 1 + (codes >= 0x80) + (codes >= 0x800)
    ends = np.cumsum(width)
    offsets = np.append((ends - width)[begins], ends[-1:] if len(ends) else 0).astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(text.encode()))


def odd(text: str) -> bool:
    return any([c in text for c in ODD_SPACES])


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merger:
    """Ids of words by the vocabulary's merges."""

    #: No symbol, and no rank.
    PAD, NONE = np.uint64((1 << 20) - 1), np.int32((1 << 31) - 1)

    def __init__(self, json_name: str = VOCABULARY):
        import public_tokenizers

        with open(public_tokenizers.path(json_name), encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.bytes = [self.vocab[c] for c in byte_alphabet()]
        self.last = [self.vocab[c + self.end] for c in byte_alphabet()]
        #: both ids of a pair in one number -> rank of the merge and id of its result in one number
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[self.vocab[a] << 20 | self.vocab[b]] = rank << 20 | self.vocab[a + b]
        self.table()

    def table(self) -> None:
        """The same for arrays: an open hash table from pairs to ranks, and from ranks to what the merge makes."""
        size = 1 << max(10, (4 * len(self.pairs)).bit_length())
        self.shift, self.keys, self.ranks = np.uint64(64 - size.bit_length() + 1), np.full(size, (1 << 64) - 1, dtype=np.uint64), np.full(size, self.NONE, dtype=np.int32)
        self.made = np.zeros(max((p >> 20 for p in self.pairs.values()), default=0) + 1, dtype=np.uint64)
        pairs = np.array(list(self.pairs), dtype=np.uint64)
        taken: set[int] = set()
        for slot, pair, p in zip(self._slots(pairs).tolist(), self.pairs, self.pairs.values()):
            while slot in taken:
                slot = (slot + 1) % size
            taken.add(slot)
            self.keys[slot], self.ranks[slot], self.made[p >> 20] = pair, p >> 20, p & 0xFFFFF
        self.first, self.final = np.array(self.bytes, dtype=np.uint64), np.array(self.last, dtype=np.uint64)

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the merges of `a` with `b`; NONE where there is none."""
        pairs = (a << np.uint64(20) | b).ravel()
        slots = self._slots(pairs)
        out = self.ranks[slots]
        on = np.flatnonzero((self.keys[slots] != pairs) & (out != self.NONE))
        while len(on):  # another pair's slot: on to the next one
            slots[on] = (slots[on] + 1) % len(self.keys)
            out[on] = self.ranks[slots[on]]
            on = on[(self.keys[slots[on]] != pairs[on]) & (out[on] != self.NONE)]
        return out.reshape(a.shape)

    def merge(self, starts: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of many words of `data`: all of them, where each word's begin, how many each has."""
        at, size, flat, total, low = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64), [np.zeros(0, dtype=np.uint64)], 0, 0
        for width in WIDTHS:
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            if len(rows):
                ids = self._rounds(starts[rows], lengths[rows], data, width)
                held = ids != self.PAD
                size[rows] = held.sum(axis=1)
                at[rows] = total + np.cumsum(size[rows]) - size[rows]
                flat.append(ids[held])
                total += len(flat[-1])
        for k in np.flatnonzero(lengths > low).tolist():
            flat.append(np.array(self.ids(data[starts[k] : starts[k] + lengths[k]].tobytes()), dtype=np.uint64))
            at[k], size[k], total = total, len(flat[-1]), total + len(flat[-1])
        return np.concatenate(flat), at, size

    def _rounds(self, starts: np.ndarray, lengths: np.ndarray, data: np.ndarray, width: int) -> np.ndarray:
        """A row of symbols for each word, PAD behind them. A round merges the first of the best pairs of every row, so each row that goes on loses one symbol; the others are done."""
        rows, place = np.arange(len(starts)), np.arange(width)
        inside = place < lengths[:, None]
        part = data[np.where(inside, starts[:, None] + place, 0)]
        symbols = np.where(inside, self.first[part], self.PAD)
        symbols[rows, lengths - 1] = self.final[part[rows, lengths - 1]]
        ranks, out = self._ranks(symbols[:, :-1], symbols[:, 1:]), np.full(symbols.shape, self.PAD)
        while ranks.shape[1]:
            best = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(rows)), best]
            on = rank != self.NONE
            out[rows[~on], : symbols.shape[1]] = symbols[~on]
            rows, symbols, ranks, best, rank = rows[on], symbols[on], ranks[on], best[on], rank[on]
            if not len(rows):
                return out
            k = np.arange(len(rows))
            symbols[k, best] = self.made[rank]
            symbols, ranks = _without(symbols, best + 1), _without(ranks, best)
            k = np.flatnonzero(best > 0)
            ranks[k, best[k] - 1] = self._ranks(symbols[k, best[k] - 1], symbols[k, best[k]])
            k = np.flatnonzero(best < ranks.shape[1])
            ranks[k, best[k]] = self._ranks(symbols[k, best[k]], symbols[k, best[k] + 1])
        out[rows, :1] = symbols
        return out

    def ids(self, word: bytes) -> list[int]:
        part = [self.bytes[b] for b in word]
        part[-1] = self.last[word[-1]]
        if len(part) > 48:
            return self._long(part)
        get, none = self.pairs.get, 1 << 60
        ranked = [get(a << 20 | b, none) for a, b in zip(part, part[1:])]
        while ranked:
            best = min(ranked)
            if best == none:
                break
            k = ranked.index(best)
            part[k : k + 2] = [best & 0xFFFFF]
            del ranked[k]
            if k:
                ranked[k - 1] = get(part[k - 1] << 20 | part[k], none)
            if k < len(ranked):
                ranked[k] = get(part[k] << 20 | part[k + 1], none)
        return part

    def _long(self, part: list[int]) -> list[int]:
        """With a heap of pairs, for words of any length."""
        n, get = len(part), self.pairs.get
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(p, i) for i, (a, b) in enumerate(zip(part, part[1:])) if (p := get(a << 20 | b)) is not None]
        heapq.heapify(heap)
        # equal ranks leave the heap from left to right; an entry whose pair has changed is void
        while heap:
            p, i = heapq.heappop(heap)
            j = right[i] if alive[i] else -1
            if j < 0 or get(part[i] << 20 | part[j]) != p:
                continue
            part[i], alive[j], right[i] = p & 0xFFFFF, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (q := get(part[a] << 20 | part[b])) is not None:
                    heapq.heappush(heap, (q, a))
        return [x for x, on in zip(part, alive) if on]


def _without(matrix: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Each row without its entry of that column."""
    keep = np.ones(matrix.shape, dtype=bool)
    keep[np.arange(len(matrix)), column] = False
    return matrix[keep].reshape(len(matrix), -1)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start .. start + length - 1 of all spans, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and bytes of a string array without nulls."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return ends[:-1], np.diff(ends), np.frombuffer(data, dtype=np.uint8) if data else np.zeros(1, dtype=np.uint8)


class Encoder:
    """Texts to ids and back, as the tokenizers library does for the vocabulary without added special tokens.

    A batch is split at white space and its distinct pieces are looked up in the lexicon, all at once. Pieces that are not in it are split into
    words, and the distinct ones of these are looked up or merged, all at once again.
    """

    def __init__(self, json_name: str = VOCABULARY, lexicon: Automaton | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(json_name))
        self.library.no_truncation()
        self.library.no_padding()
        self.lexicon = lexicon
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        tokens = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.tokens = pa.array([tokens.get(i, "") for i in range(max(tokens) + 1)])
        self.kind = np.dtype("<u2" if max(tokens) < 1 << 16 else "<u4")
        self.merger = Merger(json_name)

    def unseen(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (as numbers of `kind`) of pieces that aren't in the lexicon, piece after piece, and how many each has. Words are looked up in the lexicon again."""
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(_strings(pieces)[1] + 1) // AT_ONCE)) + 1).tolist(), len(pieces)]
        done = [self._unseen(pieces.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])]
        return np.concatenate([ids for ids, _ in done]), np.concatenate([n for _, n in done])

    def _unseen(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lines = pieces.to_numpy(zero_copy_only=False).tolist()
        strange = np.flatnonzero(pc.match_substring_regex(pieces, NOT_PLAIN).to_numpy(zero_copy_only=False))
        own = [np.array(self.library.encode(lines[k], add_special_tokens=False).ids, dtype=self.kind) for k in strange.tolist()]
        for k in strange.tolist():
            lines[k] = ""
        coded = words_of(lines).dictionary_encode()
        index, words = coded.indices.to_numpy(), coded.dictionary
        starts, lengths, data = _strings(words)
        at, size, table = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64), []
        miss = np.arange(len(words))
        if self.lexicon:
            ranks = self.lexicon.ranks(starts, lengths, data)
            hit, miss = np.flatnonzero(ranks >= 0), np.flatnonzero(ranks < 0)
            low = self.lexicon.offsets[ranks[hit]].astype(np.int64)
            size[hit] = self.lexicon.offsets[ranks[hit] + 1].astype(np.int64) - low
            at[hit] = np.cumsum(size[hit]) - size[hit]
            table.append(self.lexicon.ids[spans(low, size[hit])].astype(self.kind))
        merged, begin, size[miss] = self.merger.merge(starts[miss], lengths[miss], data)
        at[miss] = begin + sum(map(len, table))
        table.append(merged.astype(self.kind))
        end = words.index("\n").as_py()
        ends = np.flatnonzero(index == end)
        at, size = at[index], size[index]
        size[ends] = 0
        # the library's ids take the place of the line end behind an empty line
        n_own = np.array([len(x) for x in own], dtype=np.int64)
        at[ends[strange]], size[ends[strange]] = sum(map(len, table)) + np.cumsum(n_own) - n_own, n_own
        flat = np.concatenate([*table, *own])[spans(at, size)]
        return flat, np.diff(np.cumsum(size)[ends], prepend=0)

    def _library_only(self, text: str) -> bool:
        return odd(text) or ("<|" in text and any([s in text for s in self.special]))

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and how many each text has."""
        texts = pc.fill_null(texts, "")
        strange = [k for k, t in enumerate(texts.to_pylist()) if self._library_only(t)]
        if strange:
            mask = np.zeros(len(texts), dtype=bool)
            mask[strange] = True
            own = [self.library.encode(texts[k].as_py(), add_special_tokens=False).ids for k in strange]
            texts = pc.if_else(pa.array(mask), "", texts)
        split = pc.utf8_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        starts, lengths, data = _strings(coded.dictionary)
        ranks = self.lexicon.ranks(starts, lengths, data) if self.lexicon else np.full(len(starts), -1)
        miss = ranks < 0
        new, n_new = self.unseen(coded.dictionary.filter(pa.array(miss)))
        if self.lexicon:
            table, offsets = self.lexicon.ids, self.lexicon.offsets.astype(np.int64)
            low, size = offsets[np.maximum(ranks, 0)], np.where(miss, 0, offsets[ranks + 1] - offsets[np.maximum(ranks, 0)])
        else:
            table, low, size = np.zeros(0, dtype=np.int32), np.zeros(len(ranks), dtype=np.int64), np.zeros(len(ranks), dtype=np.int64)
        low[miss], size[miss] = len(table) + np.cumsum(n_new) - n_new, n_new
        # the ids of the batch's distinct pieces, then of all its pieces
        used = np.concatenate([table[spans(low[~miss], size[~miss])], new])
        at = np.empty(len(ranks), dtype=np.int64)
        at[~miss] = np.cumsum(size[~miss]) - size[~miss]
        at[miss] = size[~miss].sum() + np.cumsum(n_new) - n_new
        each = size[index]
        flat = used[spans(at[index], each)].astype("<u4")
        bounds = np.append(0, np.cumsum(each))[split.offsets.to_numpy()]
        counts = np.diff(bounds)
        if strange:
            cuts = np.split(flat, bounds[1:-1])
            for k, ids in zip(strange, own):
                cuts[k] = np.array(ids, dtype="<u4")
            flat, counts = np.concatenate(cuts), np.array([len(c) for c in cuts])
        return flat, counts

    def decode_batch(self, flat: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts from ids: the vocabulary has no decoder, so its decoding is the tokens, joined by spaces."""
        tokens = self.tokens.take(pa.array(flat))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), tokens), " ")

    def encode(self, text: str) -> list[int]:
        return self.encode_batch(pa.array([text]))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return self.decode_batch(np.array(ids, dtype=np.int64), np.array([len(ids)]))[0].as_py()


def encoder(json_name: str = VOCABULARY, lexicon_uri: str | None = None) -> Encoder:
    """That of this worker process; its lexicon is mapped, not copied."""
    return resident(("bpe", json_name, lexicon_uri), lambda: Encoder(json_name, Automaton(open_mapped(lexicon_uri)) if lexicon_uri else None))


def piece_counts(docs: DataFrame) -> DataFrame:
    """piece, n: the white-space pieces of all texts, of plain characters (others never reach the lexicon)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            pieces = [p for p in counts if len(p) < 64 and PLAIN.fullmatch(p)]
            out = pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array([counts[p] for p in pieces], pa.int64())], ["piece", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in as_texts(batch.column("text")):
                counts.update(text.split())
            if len(counts) > 200_000:
                yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def word_counts(pieces: DataFrame) -> DataFrame:
    """word, n: the vocabulary's words of all counted pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for piece, n in zip(batch.column("piece").to_pylist(), batch.column("n").to_pylist()):
                for w in WORDS.findall(piece.lower()):
                    counts[w] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return pieces.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, column: str, size: int) -> list[str]:
    """The most frequent strings, `size` at most. The least count that keeps within `size` is read from the histogram of counts, so no
    more than `size` strings reach the driver."""
    top = counts.where("n >= 2").groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n")).limit(size).collect()
    least, total = None, 0
    for row in top:
        total += row.c
        if total > size:
            break
        least = row.n
    return counts.where(F.col("n") >= least).select(column).toArrow().column(0).to_pylist() if least else []


def build_lexicon(docs: DataFrame, json_name: str = VOCABULARY, size: int = LEXICON) -> str:
    """Compile the most frequent pieces and words, `size` at most of either, and publish the transducer; its URI."""
    spark = docs.sparkSession
    pieces = stage(piece_counts(docs), "pieces")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    words = stage(word_counts(pieces), "words")
    found = sorted({*most_frequent(pieces, "piece", size), *most_frequent(words, "word", size)})
    small_batches(spark)
    plain = Encoder(json_name)
    flat, counts = plain.unseen(pa.array(found, pa.string()))
    ids = [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] if found else []
    return publish(spark, "lexicon", compile_words([w.encode() for w in found], ids))


def bpe_encode(docs: DataFrame, json_name: str = VOCABULARY, size: int = LEXICON) -> DataFrame:
    """doc_id, ids (array of int), decoded: the operator's real output."""
    small_batches(docs.sparkSession)
    uri = build_lexicon(docs, json_name, size)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(json_name, uri)
        flat, counts = e.encode_batch(batch.column("text"))
        ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(flat.astype(np.int32)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, e.decode_batch(flat, counts)], ["doc_id", "ids", "decoded"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, json_name: str = VOCABULARY, size: int = LEXICON) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; ids and decoded texts stay in the workers."""
    small_batches(docs.sparkSession)
    uri = build_lexicon(docs, json_name, size)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(json_name, uri)
        flat, counts = e.encode_batch(batch.column("text"))
        shown = [hashlib.sha256(b).hexdigest() for b in e.decode_batch(flat, counts).cast(pa.binary()).to_pylist()]
        view, ends = memoryview(flat).cast("B"), (4 * np.cumsum(counts)).tolist()
        ids = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip([0, *ends], ends)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(ids), pa.array(shown)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe_lexicon(spark, sf_dir: str) -> DataFrame:
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
