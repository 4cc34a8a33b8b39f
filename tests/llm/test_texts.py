"""Language ID, quality, quality rules."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from verbarium.llm import language_id as L
from verbarium.llm import quality_mil as Q
from verbarium.llm import quality_rules as R


# -- language ID -------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    pieces = L.vocabulary()
    table = np.random.default_rng(0).dirichlet(np.ones(len(pieces)), 3).T
    return L.Unigrams(pieces, table, ["a", "b", "c"], [0.5, 0.3, 0.2])


def brute_word(m, word):
    """Sum over all segmentations, one by one."""
    text = L.MARK + word

    def walk(i):
        if i == len(text):
            yield np.ones(m.k)
        for j in range(i + 1, len(text) + 1):
            p = m.p.get(text[i:j], (L.UNKNOWN,) * m.k if j == i + 1 else None)
            if p is not None:
                for rest in walk(j):
                    yield np.array(p) * rest

    return np.log(sum(walk(0)))


def test_forward_sums_all_segmentations(model):
    words = ["the", "étude", "x", "straße", "日本", "thing", "q"]
    assert np.allclose(model.forward(words), [brute_word(model, w) for w in words])
    long = ["ab" * 60, "z" * 400]
    assert np.isfinite(model.forward(long)).all()
    assert np.allclose(model.forward(words), [model.long_word(w) for w in words])


def test_expected_uses(model):
    """Forward and backward against all segmentations, one by one."""
    words, counts = ["the", "thing", "été"], np.array([2.0, 1.0, 3.0])
    p = model.by_rank[:, 0]
    order = L.piece_trie(model.pieces)[1]
    place = {model.pieces[i]: r for r, i in enumerate(order)}
    want = np.zeros(len(p))

    def walk(text, i):
        if i == len(text):
            yield 1.0, []
        for j in range(i + 1, len(text) + 1):
            r = place.get(text[i:j], len(p) - 1 if j == i + 1 else None)
            if r is not None:
                for q, rest in walk(text, j):
                    yield p[r] * q, [r, *rest]

    for word, n in zip(words, counts):
        ways = list(walk(L.MARK + word, 0))
        total = sum(q for q, _ in ways)
        for q, ranks in ways:
            for r in ranks:
                want[r] += n * q / total
    assert np.allclose(L.Lattice(words, model.trie).uses(p, counts), want)


def test_tiny_probabilities(model):
    """Where a language hardly knows any piece, words short and long still have finite sums, and they agree."""
    table = np.full_like(model.table, 1e-12)
    table[:, 0] = model.table[:, 0]
    small = L.Unigrams(model.pieces, table, ["a", "b", "c"], [0.5, 0.3, 0.2])
    words = ["q" * 30, "zxj" * 10, "the", "日本語" * 10]
    assert np.isfinite(small.forward(words)).all() and np.allclose(small.forward(words), [small.long_word(w) for w in words])
    said = small.predict(pa.array(["q" * 30, "zxj " * 400, " ".join(words)]))
    assert all(lang == "a" and 0 <= score <= 1 for lang, score in said)


def test_every_language_is_learned(spark):
    """Three hundred of them, some with long texts only."""
    syllables = [c + v for c in "bcdfgklmnprstvz" for v in "aeiou"]
    word = lambda k: syllables[k % 75] + syllables[(k // 4 + 31) % 75] + syllables[(7 * k) % 73]
    rows = [(i, f"{word(i % 300)} " * (20_000 if i % 300 == 7 else 4), f"l{i % 300:03}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = L.identify(docs).collect()
    assert len({r.lang_pred for r in out}) > 290 and sum(r.lang_pred == f"l{r.doc_id % 300:03}" for r in out) > 0.97 * len(rows) and all(0 <= r.score <= 1 for r in out)


def test_prediction_against_brute_force(documents, odd):
    """The whole query: words of whole texts, sums over all segmentations, priors, the share of the best language."""
    for docs in (documents.limit(40).cache(), odd.where("doc_id in (1, 2, 3, 4, 5, 8, 9, 10)")):
        m = L.fit(docs)
        table = {w: np.array(row) for w, row in zip(m.pieces, m.table.tolist())}

        def word_sum(word):
            text, sums = L.MARK + word, [np.ones(m.k)]
            for j in range(1, len(text) + 1):
                ways = [sums[i] * table[text[i:j]] for i in range(j) if text[i:j] in table]
                single = [] if text[j - 1] in table else [sums[j - 1] * L.UNKNOWN]
                sums.append(sum(ways + single, np.zeros(m.k)))
            return np.log(sums[-1])

        got = {r.doc_id: r for r in L.identify(docs).collect()}
        for d in docs.collect():
            words = [w for run in (d.text or "").split() for w in re.findall(r"[^\W\d_]+", run.lower())]
            z = sum((word_sum(w) for w in words), np.array(m.priors, dtype=float))
            share = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            want = (m.languages[int(share.argmax())], share.max()) if words else ("und", 0.0)
            assert (got[d.doc_id].lang_pred, pytest.approx(got[d.doc_id].score)) == want


def test_whole_texts_count(model):
    a, b = (model.scores(pa.array([t]))[0] for t in ("one two", "one two " * 5000))
    assert np.allclose(5000 * a, b)


def test_held_out_accuracy(documents):
    rows = {r.doc_id: r for r in L.identify(documents).collect()}
    docs = documents.collect()
    assert len(rows) == len(docs)
    own = [(d.lang, rows[d.doc_id].lang_pred) for d in docs if rows[d.doc_id].held_out]
    assert all(rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) for d in docs)
    assert sum(a == b for a, b in own) >= 0.95 * len(own)


def test_language_of_odd_rows(odd, none):
    rows = {r.doc_id: r for r in L.identify(odd).collect()}
    assert all((rows[i].lang_pred, rows[i].score) == ("und", 0.0) for i in (1, 2, 3, 9))
    assert rows[4].lang_pred in ("en", "fr") and 0 <= rows[4].score <= 1 and not rows[None].held_out
    assert L.identify(odd).count() == odd.count() and L.identify(none).count() == 0
    assert {r.lang_pred for r in L.identify(odd.withColumn("lang", odd["lang"].substr(9, 1))).collect()} <= {"und", ""}


def test_language_stage(odd):
    kept = L.known_languages(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 4, 4, 5, 6, 7, 8, 10]


# -- quality -----------------------------------------------------------------------------------------------------------------------


def test_passages_hold_every_word_once():
    texts = [b"", b"  ", b"one", b"a b " * 200, b"x" * 1000, b" lead\n\ntwo words"]
    x, counts = Q.passages(texts)
    assert counts.tolist() == [max(1, -(-len(t.split()) // Q.PASSAGE)) for t in texts] and len(x) == counts.sum() and np.isfinite(x).all()
    for t in texts:  # a text's passages don't depend on its neighbours but for the byte that divides them
        alone, n = Q.passages([t])
        assert n[0] == counts[texts.index(t)]


def plain_score(m, text):
    """Features and network of one text from their definition, number by number."""
    import math

    words = re.findall(rb"[^ \t\n\r\x0b\x0c]+", text)
    starts = [w.start() for k, w in enumerate(re.finditer(rb"[^ \t\n\r\x0b\x0c]+", text)) if k % Q.PASSAGE == 0]
    bounds = [0, *starts[1:], len(text)]
    kind = lambda byte: next((k for k, c in enumerate(Q.CLASSES) if byte in c), len(Q.CLASSES))
    lines = [x for x in text.split(b"\n") if x]
    hs, es = [], []
    for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
        x = [0.0] * Q.FEATURES
        for i in range(low, high):
            x[kind(text[i]) * Q.N_CLASSES + kind((text + b"\n")[i + 1])] += 1 / max(1, high - low)
        x = [math.sqrt(v) for v in x]
        own = words[k * Q.PASSAGE : (k + 1) * Q.PASSAGE]
        n = max(1, len(own))
        x[-5:] = [len(set(own)) / n, sum(a == b for a, b in zip(own, own[1:])) / n, sum(map(len, own)) / n / 10, 1 - len(set(lines)) / max(1, len(lines)), len(set(words)) / max(1.0, len(words) ** 0.75)]
        x = [(v - m["mean"][i]) / m["dev"][i] for i, v in enumerate(x)]
        h = [math.tanh(sum(v * m["W"][i, j] for i, v in enumerate(x)) + m["b"][j]) for j in range(m["W"].shape[1])]
        gate = lambda j: math.tanh(sum(v * m["V"][i, j] for i, v in enumerate(h))) / (1 + math.exp(-sum(v * m["U"][i, j] for i, v in enumerate(h))))  # noqa: B023, E731
        hs.append(h)
        es.append(sum(m["w"][j] * gate(j) for j in range(m["V"].shape[1])))
    a = [math.exp(e - max(es)) for e in es]
    z = [sum(w * h[j] for w, h in zip(a, hs)) / sum(a) for j in range(len(hs[0]))]
    return 1 / (1 + math.exp(-(sum(v * c for v, c in zip(z, m["c"])) + float(m["c0"]))))


def test_scores_against_brute_force(spark, documents, odd, data):
    """The whole query: folds, fitted model, and each text's score."""
    labels = spark.read.parquet(f"{data}/labels.parquet")
    m = Q.fit(documents, labels)
    assert m["W"].shape == (Q.FEATURES, Q.HIDDEN)
    some = documents.where("length(text) < 6000").select("doc_id", "text").limit(30)
    few = some.union(odd.where("doc_id <> 6 or doc_id is null").select("doc_id", "text")).cache()
    fit, Q.fit = Q.fit, lambda *_: m
    try:
        got = Q.score_quality(few, labels).collect()
    finally:
        Q.fit = fit
    texts = {}
    for r in few.collect():
        texts.setdefault(r.doc_id, []).append((r.text or "").encode())
    for r in got:
        assert any(abs(r.score - plain_score(m, t)) < 1e-3 for t in texts[r.doc_id]) and r.predicted == (r.score >= 0.7), r


def test_long_texts_in_slices(documents):
    texts = [(r.text or "").encode() for r in documents.limit(60).collect()] + [b"", b" a", b"word " * 1000, b"x\n\n y" * 700]
    r = np.random.default_rng(2)
    x, counts = Q.passages(texts)
    m = Q.train(x, counts, (r.random(len(texts)) < 0.5).astype(float), np.ones(len(texts)), epochs=10)
    want = Q.score_texts(m, texts)
    assert np.allclose([Q.score_long(m, t, n) for t, n in zip(texts, [1, 2, 3] * len(texts))], want, atol=1e-5)
    assert np.allclose([Q.score_texts(m, [t])[0] for t in texts], want, atol=1e-6)  # neighbours don't matter


def test_gradient():
    r = np.random.default_rng(0)
    counts, y = np.array([2, 1, 3]), np.array([1.0, 0.0, 1.0])
    x = r.normal(size=(6, Q.FEATURES))
    loss = lambda m: -float((y * np.log(f := Q.forward(m, x, counts)["p"]) + (1 - y) * np.log(1 - f)).mean())
    assert loss(Q.train(x, counts, y, np.ones(3), epochs=60)) < 0.3 * loss(Q.train(x, counts, y, np.ones(3), epochs=1))


def test_attention_is_a_distribution_over_the_passages():
    x, counts = Q.passages([b"word " * 500, b"one"])
    r = np.random.default_rng(1)
    m = Q.train(x, counts, np.array([1.0, 0.0]), np.ones(2), epochs=5)
    assert np.allclose(np.add.reduceat(Q.forward(m, x, counts)["a"], [0, counts[0]]), 1) and r is not None


def test_held_out_quality(spark, documents, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = {r.doc_id: r for r in Q.score_quality(documents, labels).collect()}
    assert len(rows) == documents.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    own = [(r.quality, rows[r.doc_id].predicted) for r in labels.collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    assert sum(a == b for a, b in own) >= 0.9 * len(own)


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 0), (7, 1), (8, 1), (None, 1), (5, None), (10, 1), (9, 1)], "doc_id long, quality int")
    out = Q.score_quality(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert Q.score_quality(none, labels).count() == 0
    assert {r.predicted for r in Q.score_quality(odd, labels.where("false")).collect()} == {1}
    assert {round(r.score, 3) for r in Q.score_quality(odd, labels.where("quality = 0")).collect()} == {0.0}
    kept = Q.good_documents(odd, labels.where("false"))
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 10]


# -- rules -------------------------------------------------------------------------------------------------------------------------


def brute_base(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {p + k for places in at.values() if len(places) > 1 for p in places for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_base_features(odd, documents):
    for docs in (odd, documents):
        got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in R.quality_rules(docs).collect()), key=str)
        assert got == sorted(((r.doc_id, *brute_base(r.text)) for r in docs.collect()), key=str)


def test_kept_follows_posterior_and_base(documents):
    for r in R.quality_rules(documents).collect():
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_estimation_finds_accuracies():
    """From expectations that are off, the votes lead to the true probabilities."""
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.7
    true = [((0.8, 0.1), (0.1, 0.7)), ((0.7, 0.05), (0.2, 0.6)), ((0.6, 0.1), (0.1, 0.5)), ((0.3, 0.3), (0.3, 0.3)), ((0.0, 0.02), (0.0, 0.6))]
    u = rng.random((len(truth), len(true)))
    votes = np.stack([np.where(u[:, k] < np.where(truth, g[0], b[0]), 1, np.where(u[:, k] < np.where(truth, sum(g), sum(b)), -1, 0)) for k, (g, b) in enumerate(true)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    expected = [((0.6, 0.2), (0.2, 0.6))] * 4 + [((0.0, 0.1), (0.0, 0.3))]
    prior, table = R.fit([(tuple(p.tolist()), int(n)) for p, n in zip(patterns, counts)], expected, rounds=200, weight=20)
    assert abs(prior - 0.7) < 0.03
    for (g, b), t in zip(true, table):
        assert all(abs(x - y) < 0.04 for k, v in enumerate((1, -1)) for x, y in zip((g[k], b[k]), t[v]))
    right = np.array([R.posterior(tuple(v.tolist()), prior, table) >= 0.5 for v in votes]) == truth
    assert right.mean() > 0.93 and math.isfinite(R.posterior((1,) * 5, prior, table))


def brute_kept(rows, expected):
    """EM text by text, with arrays, over the votes of the texts that pass the base rules."""
    votes = np.array([r.votes for r in rows if not r.base_failed], dtype=int).reshape(-1, len(expected))
    start = np.maximum([[[g[0], b[0]], [g[1], b[1]], [1 - sum(g), 1 - sum(b)]] for g, b in expected], 1e-4)  # rule, vote, state
    which = np.select([votes == 1, votes == -1], [0, 1], 2)
    table, share, own = start.copy(), R.PRIOR, R.WEIGHT * np.array([R.PRIOR, 1 - R.PRIOR]) + 1
    for _ in range(R.ROUNDS):
        like = np.prod([table[k][which[:, k]] for k in range(len(table))], axis=0) * [share, 1 - share]
        p = like / like.sum(axis=1, keepdims=True)
        table = start * own + np.array([[p[which[:, k] == v].sum(axis=0) for v in range(3)] for k in range(len(table))])
        table /= table.sum(axis=1, keepdims=True)
        share = (own + p.sum(axis=0))[0] / (own.sum() + len(p))
    like = np.prod([table[k][which[:, k]] for k in range(len(table))], axis=0) * [share, 1 - share]
    return dict(zip([r.doc_id for r in rows if not r.base_failed], like[:, 0] / like.sum(axis=1)))


def mixed_texts(n=3000):
    """Good and bad texts in which numbers say nothing: four texts of ten hold very many, good ones and bad ones alike."""
    rng, rows = np.random.default_rng(11), []
    for i in range(n):
        good = rng.random() < 0.7
        words = [str(w) for w in rng.permutation(["ships", "came", "late", "to", "a", "harbour", "of", "salt", "and", "rope", "where", "no", "rain", "fell", "on", "fields"])]
        words[3], words[9] = words[3] + ",", words[9] + "."
        if rng.random() < 0.4:
            words += [str(x) for x in rng.integers(10**7, 10**8, 14)]
        if good and rng.random() < 0.3:
            words[5] += "*"
        if not good:
            words = [w.upper() for w in words] if rng.random() < 0.8 else words
            words += ["$$ ## %% &&"] if rng.random() < 0.8 else []
            words += ["!!!! ?!?! !!!!"] if rng.random() < 0.8 else []
        rows.append((i, " ".join(words), int(good)))
    return rows


def test_kept_against_brute_force(spark, documents, odd):
    expected = [v[1:] for v in R.rules().values()]
    made = spark.createDataFrame(mixed_texts(), "doc_id long, text string, good int")
    for docs in (documents, made, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = R.quality_rules(docs).collect()
        want = brute_kept(rows, expected)
        assert {r.doc_id for r in rows if r.kept} == {i for i, p in want.items() if p >= 0.5}
        assert all(abs(r.posterior - want[r.doc_id]) < 1e-6 for r in rows if not r.base_failed)


def test_estimation_changes_verdicts_for_cause(spark):
    """The rule on digits is trusted beforehand. Where it fires on good and bad texts alike, estimation finds that out, and good texts with numbers stay."""
    rows = mixed_texts()
    truth = {i: good for i, _, good in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string, good int")
    kept = {r.doc_id: r.kept for r in R.quality_rules(docs).collect()}
    fit = R.fit
    R.fit = lambda patterns, expected: fit(patterns, expected, rounds=0)
    try:
        hand = {r.doc_id: r.kept for r in R.quality_rules(docs).collect()}
    finally:
        R.fit = fit
    right = lambda verdicts: sum(v == bool(truth[i]) for i, v in verdicts.items()) / len(verdicts)
    other = [i for i in truth if kept[i] != hand[i]]
    assert len(other) > 100 and sum(kept[i] == bool(truth[i]) for i in other) > 0.9 * len(other) and right(kept) > right(hand) + 0.03, (len(other), right(kept), right(hand))


def test_rules_agree_with_labels(spark, documents, data):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = [r for r in R.quality_rules(documents).collect() if r.doc_id in labels and not r.base_failed]
    assert sum(r.kept == (labels[r.doc_id] == 1) for r in rows) >= 0.98 * len(rows)


def test_rules_on_an_empty_table(none):
    assert R.quality_rules(none).count() == 0


def test_rules_run_without_python(documents):
    plan = R.quality_rules(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
