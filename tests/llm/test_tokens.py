"""Token counts, BPE encoding and packing against the library."""

from __future__ import annotations

import hashlib
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verbarium.llm import automaton as A
from verbarium.llm import bpe_lexicon as B
from verbarium.llm import packing as K
from verbarium.llm import token_counts as T
from verbarium.llm.common import fresh_dir


@pytest.fixture(scope="module")
def words():
    return B.Encoder()


def test_counts_and_cache(spark, odd, documents):
    for docs in (odd, documents):
        cache = fresh_dir(spark, "cache")
        library = T.Counter("byte_bpe_50k.json", None)
        want = sorted(((r.doc_id, len((r.text or "").encode()), n, n > 1024) for r in docs.collect() for n in [len(library.library.encode(r.text or "", add_special_tokens=False))]), key=str)
        for _ in range(2):  # the second call finds everything in the cache
            assert sorted((tuple(r) for r in T.token_counts(docs, cache).collect()), key=str) == want
        version = T.tokenizer_digest("byte_bpe_50k.json")
        stored = spark.read.option("recursiveFileLookup", "true").parquet(f"{cache}/{version}")
        assert stored.count() == docs.selectExpr("coalesce(text, '')").distinct().count()


def test_texts_stay_where_they_are_read(spark, documents):
    """With a cache that knows nine texts of ten, only the tenth is encoded; and no exchange holds a text, known or not."""
    cache, seen = fresh_dir(spark, "cache"), []
    T.token_counts(documents.where("doc_id % 10 > 0"), cache).collect()
    version = T.tokenizer_digest("byte_bpe_50k.json")
    stored = lambda: spark.read.option("recursiveFileLookup", "true").parquet(f"{cache}/{version}").count()
    before, encode = stored(), T.encode_listed

    def listed(texts, *more):
        seen.append(encode(texts, *more))
        return seen[-1]

    T.encode_listed = listed
    try:
        out = T.token_counts(documents, cache)
        assert out.count() == documents.count()
    finally:
        T.encode_listed = encode
    assert stored() - before == documents.selectExpr("coalesce(text, '')").subtract(documents.where("doc_id % 10 > 0").selectExpr("coalesce(text, '')")).count() > 0
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "text" not in out._jdf.queryExecution().executedPlan().toString()


def test_counts_where_partitions_read_other_rows(spark, documents):
    """A second pass whose partitions hold other rows than the first one's lacks some digests; their texts are moved."""
    library = T.Counter("byte_bpe_50k.json", None).library
    encode = T.encode_listed
    T.encode_listed = lambda texts, *more: encode(texts.withColumn("part", texts["part"] + 1000), *more)
    try:
        got = T.token_counts(documents, fresh_dir(spark, "cache")).collect()
    finally:
        T.encode_listed = encode
    assert {r.doc_id: r.n_tokens for r in got} == {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False)) for r in documents.collect()}


def test_counts_of_an_empty_table(spark, none):
    assert T.token_counts(none, fresh_dir(spark, "cache")).count() == 0


def test_quick_engine_agrees_on_plain_characters():
    c = T.Counter("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    for k in range(0x3000):
        ch = chr(k)
        if T.PLAIN.fullmatch(ch):
            for t in (f"a{ch}b", f"1{ch} {ch}{ch}", f"{ch}'s {ch}", f" {ch}\n{ch}", f"  {ch}  "):
                assert len(c.quick.encode(t, allowed_special="all")) == len(c.library.encode(t, add_special_tokens=False)), (hex(k), t)


def same_as_library(e: B.Encoder, texts: list[str]) -> None:
    flat, counts = e.encode_batch(pa.array(texts, pa.string()))
    shown, at = e.decode_batch(flat, counts).to_pylist(), 0
    for t, n, s in zip(texts, counts.tolist(), shown):
        ids = e.library.encode(t or "", add_special_tokens=False).ids
        assert flat[at : at + n].tolist() == ids, t[:80]
        assert s == e.library.decode(ids, skip_special_tokens=False)
        at += n


def test_every_character(words):
    same_as_library(words, [y for c in range(1, 0x3000) for y in (chr(c), f"a{chr(c)}b", f"A {chr(c)}s", f"1{chr(c)}'s")])


def test_odd_texts(words):
    same_as_library(words, ["", "don't I'LL", "a<|endoftext|>b <|startoftext|>", "x" * 300, "ΣΑΣ", "é éx", "日本 😀", "a\x1cb c\x85d", "<|", "ab" * 200 + "é" * 77, "  ", "a" * 5000])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=60), max_size=5))
def test_any_text(texts):
    e = test_any_text.encoder = getattr(test_any_text, "encoder", None) or B.Encoder()
    same_as_library(e, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAéÉĀ9²'!‐stmdrvelL", max_size=12), max_size=4))
def test_words_of_lines(lines):
    assert B.words_of(lines).to_pylist() == [w for x in lines for w in [*B.WORDS.findall(x.lower()), "\n"]]


def test_ranks_of_pairs(words):
    m = words.merger
    rng = np.random.default_rng(4)
    known = np.array(list(m.pairs), dtype=np.uint64)
    a, b = np.append(known >> np.uint64(20), rng.integers(0, 49_000, 50_000, dtype=np.uint64)), np.append(known & np.uint64(0xFFFFF), rng.integers(0, 49_000, 50_000, dtype=np.uint64))
    assert m._ranks(a, b).tolist() == [m.pairs[k] >> 20 if k in m.pairs else m.NONE for k in (a << np.uint64(20) | b).tolist()]


def made_up(n, seed=3):
    rng = np.random.default_rng(seed)
    parts = ["er", "th", "an", "tion", "ción", "ß", "Sch", "o", "ndh", "'s", "9", "ly", "ll", "$$", "é"]
    return ["".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(1, 9))) for _ in range(n)]


def test_words_of_every_width(words):
    letters = [("etaoinshrdlu" * 60)[k % 7 : k % 7 + k] for k in range(1, 70)]
    same_as_library(words, [" ".join(letters), *letters, *(x + "é" for x in letters), " ".join(made_up(3000)), "é" * 24, "é" * 25])


def test_unseen_pieces_in_slices(words, monkeypatch):
    monkeypatch.setattr(B, "AT_ONCE", 50)
    same_as_library(words, ["", " ".join(made_up(300)), "日本 " * 3 + "x" * 120 + " 😀", "x" * 49, "y" * 50 + " z"])


def test_batches_without_unseen_words(words):
    known = ["the", "cat"]
    lexicon = A.Automaton(memoryview(A.compile_words([w.encode() for w in known], [words.library.encode(w, add_special_tokens=False).ids for w in known])))
    e = B.Encoder(B.VOCABULARY, lexicon)
    for texts in ([], [None, ""], ["the cat", "cat"], ["the cats", None, "日本 the", "THE cat"]):
        same_as_library(e, texts)


def test_unseen_words_are_merged_together(words):
    """Merging the words that no lexicon holds takes well under the CPU time of the library, word by word or text by text."""
    ours, theirs = [], []
    for seed in range(3):  # new words each time, so that remembering them is no help
        text = " ".join(made_up(60_000, seed))
        at = time.process_time()
        flat, _ = words.encode_batch(pa.array([text]))
        ours.append(time.process_time() - at)
        at = time.process_time()
        ids = words.library.encode(text, add_special_tokens=False).ids
        theirs.append(time.process_time() - at)
        assert flat.tolist() == ids
    assert 2.5 * min(ours) < min(theirs)


def test_packing_merges_together(words, monkeypatch):
    """Packing's encoder merges words by the matrix, a call for each batch."""
    calls = []
    e, merge = B.encoder(), B.Merger.merge
    monkeypatch.setattr(B.Merger, "merge", lambda self, starts, *more: calls.append(len(starts)) or merge(self, starts, *more))
    e.encode_batch(pa.array([" ".join(made_up(500)), "the end"]))
    assert len(calls) == 1 and calls[0] > 100


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=8), st.lists(st.integers(0, 60_000), max_size=4), max_size=60), st.lists(st.binary(max_size=9), max_size=10))
def test_automaton(table, others):
    a = A.Automaton(memoryview(A.compile_words(list(table), list(table.values()))))
    for w in [*table, *others]:
        assert a.get(w) == table.get(w)


def test_automaton_shares_suffixes():
    words = sorted(a + b for a in (b"ab", b"cd", b"ef") for b in (b"ing", b"ed", b"s"))
    a = A.Automaton(memoryview(A.compile_words(words, [[i] for i in range(9)])))
    assert len(a) == 9 and a.n_states < 12


def test_bpe_query(spark, odd, documents, words):
    for docs in (odd, documents):
        want = []
        for r in docs.collect():
            ids = words.library.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(words.library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert sorted(map(tuple, B.bpe_digests(docs, size=500).collect()), key=str) == sorted(want, key=str)
    full = B.bpe_encode(odd, size=50).where("doc_id = 4").first()
    assert full.ids == words.library.encode("the cat and the hat of", add_special_tokens=False).ids


def test_bpe_of_an_empty_table(none):
    assert B.bpe_digests(none).count() == 0 and B.bpe_encode(none).count() == 0


def brute_sweeps(histogram, capacity):
    """Piece by piece: each round the longest pieces claim slots, a slot being what the successor among the gaps holds of a length."""
    left, gaps, bins = dict(histogram), [], 0
    while left:
        gaps = sorted(g for g in gaps if g)
        least = next(t for t in (capacity // 2, capacity // 4, 0) if max(left) > t)
        none = {n: k for n, k in left.items() if n > max([least, *gaps])}
        more = max(sum(k for n, k in none.items() if n > capacity // 2), -(-sum(k * n for n, k in none.items()) // capacity))
        gaps, bins = gaps + [capacity] * more, bins + more
        fit = [n for n in sorted(left) if n > least and gaps[-1] >= n]
        first = {n: next(i for i, g in enumerate(gaps) if g >= n) for n in fit}
        each, given, used = {n: gaps[first[n]] // n for n in fit}, {}, 0
        for n in reversed(fit):
            given[n] = min(-(-left[n] // each[n]), len(gaps) - first[n] - used)
            used += given[n]
        end = 0
        for n in fit:
            slot = max(end, first[n])
            end = slot + given[n] if given[n] else end
            for k in range(slot, slot + given[n]):
                m = min(each[n], left[n])
                gaps[k], left[n] = gaps[k] - m * n, left[n] - m
                assert gaps[k] >= 0
            if not left[n]:
                del left[n]
    return bins


def test_sweeps_of_best_fit(spark):
    rng = np.random.default_rng(5)
    cases = [{}, {64: 3}, {1: 1}, {33: 7, 31: 7, 1: 5}, {k: 1 for k in range(1, 65)}, {k: int(n) for k, n in zip(range(1, 65), rng.integers(1, 60, 64))}]
    for histogram in cases:
        went = K.best_fit(spark.createDataFrame(list(histogram.items()), "length int, n long"), 64).collect()
        bins = K.rounds(np.array(list(histogram.items()), dtype=np.int64).reshape(-1, 2), 64)[1]
        ranks, filled = {}, {}
        for r in went:
            ranks.setdefault(r.s, []).append((r.at, r.n))
            for k in range(r.n):
                filled.setdefault(r.bin + k // r.each, []).append((r.offset + (k % r.each) * r.s, r.s))
        assert set(ranks) == set(histogram)
        for length, n in histogram.items():  # every rank once
            at = 0
            for first, count in sorted(ranks[length]):
                assert first == at
                at += count
            assert at == n
        for parts in filled.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 64
        free: list[int] = []  # best fit, longest first, piece by piece
        for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
            fits = [g for g in free if g >= length]
            if fits:
                free.remove(min(fits))
            free.append((min(fits) if fits else 64) - length)
        assert len(filled) == bins == brute_sweeps(histogram, 64) <= 1.01 * len(free) + 1


def check_packing(docs, encode, capacity):
    rows = K.pack_documents(docs, capacity).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(np.array(encode(r.text or "") + [1], dtype="<u4"))
    sequences = {}
    for r in rows:
        assert any(r.start == r.piece * capacity and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.length == min(capacity, len(ids) - r.start) for ids in texts[r.doc_id])
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(rows) == sum(-(-len(i) // capacity) for own in texts.values() for i in own)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    return len(sequences), total / capacity


def test_packing(odd, documents, words):
    encode = lambda t: words.library.encode(t, add_special_tokens=False).ids
    for docs, capacity in ((odd, 4096), (odd, 16), (documents, 4096), (documents, 700)):
        n, least = check_packing(docs, encode, capacity)
        assert n <= least * 1.05 + 1


def test_packing_of_an_empty_table(none):
    assert K.pack_documents(none).count() == 0
