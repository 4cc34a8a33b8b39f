from __future__ import annotations

import math
import os
import random

import numpy as np
from pyspark.sql import functions as F

from verbarium.operators import topics, variational
from verbarium.plans import staging


def fitted(terms, vocab, **options):
    model = variational.fit(topics.encode(terms, vocab), vocab, **options)
    rises = np.diff(model.objective)
    assert (rises > -1e-7 * np.abs(model.objective[:-1])).all(), model.objective  # it never falls
    return model


def test_special_functions():
    x = np.array([1e-3, 0.1, 0.5, 1, 2.5, 7, 40, 1e4])
    assert np.allclose(variational.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-10)
    h = 1e-5 * x
    assert np.allclose(variational.digamma(x), [(math.lgamma(v + d) - math.lgamma(v - d)) / (2 * d) for v, d in zip(x, h)], rtol=1e-6)


def planted(spark, n=240):
    """Three themes, each with seed words of its own in a few documents only, and documents on something else."""
    r, themes = random.Random(4), {"sea": "ship wave sail harbour tide crew", "farm": "cow field barn wheat plough hay", "music": "song drum choir melody flute tune"}
    said, rest = [], "stone cloud paper window lamp road".split()
    for k in range(n):
        name = [*themes, "none"][k % 4]
        words = rest if name == "none" else themes[name].split()
        said.append((k, name, " ".join(r.choice(words) for _ in range(30))))
    return spark.createDataFrame(said, "id long, name string, text string"), said


SEEDS = [("music", ["song", "drum"]), ("sea", ["ship", "wave", "notaword"]), ("farm", ["cow"])]


def test_planted_seeds_are_recovered(spark):
    docs, said = planted(spark)
    terms = topics.tokens(docs)
    model = fitted(terms, topics.vocabulary(terms), seeds=SEEDS, iterations=15, alpha=0.5)
    assert model.names == ["music", "sea", "farm", topics.RESIDUAL]
    by = {r.id: r.topic for r in topics.assign(model.documents).collect()}
    right = sum(model.names[by[k]] == (name if name != "none" else topics.RESIDUAL) for k, name, _ in said)
    assert right >= 0.97 * len(said), right
    best = {n: {r.term for r in topics.top_terms(model.terms.where(F.col("name") == n), 6).collect()} for n in model.names}
    assert best["sea"] == set("ship wave sail harbour tide crew".split()) and best["farm"] == set("cow field barn wheat plough hay".split())
    sums = model.terms.groupBy("topic").agg(F.sum("weight").alias("s")).collect() + model.documents.groupBy("id").agg(F.sum("weight").alias("s")).collect()
    assert all(math.isclose(r.s, 1) for r in sums)


def brute(docs, prior, start, alpha, iterations):
    """The same updates in plain loops over all documents at once."""
    psi = lambda v: float(variational.digamma(np.array(v)))
    k, size, model = len(prior), len(prior[0]), [list(r) for r in start]
    gammas = [[1.0] * k for _ in docs]
    for _ in range(iterations):
        logs = [[psi(v) - psi(sum(row)) for v in row] for row in model]
        taken = [[0.0] * size for _ in range(k)]
        for d, counts in enumerate(docs):
            for _ in range(variational.ROUNDS):
                theta = [psi(g) - psi(sum(gammas[d])) for g in gammas[d]]
                after = [alpha] * k
                for w, n in counts.items():
                    phi = [math.exp(theta[t] + logs[t][w]) for t in range(k)]
                    for t in range(k):
                        after[t] += n * phi[t] / sum(phi)
                change = sum(abs(a - b) for a, b in zip(after, gammas[d])) / k
                gammas[d] = after
                if change < variational.ENOUGH:
                    break
            theta = [psi(g) - psi(sum(gammas[d])) for g in gammas[d]]
            for w, n in counts.items():
                phi = [math.exp(theta[t] + logs[t][w]) for t in range(k)]
                for t in range(k):
                    taken[t][w] += n * phi[t] / sum(phi)
        model = [[prior[t][w] + taken[t][w] for w in range(size)] for t in range(k)]
    return model, gammas


def test_against_plain_loops(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("aa bb cc dd ee ff".split()) for _ in range(r.randrange(1, 25))) for _ in range(12)]
    terms = topics.tokens(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    vocab = topics.vocabulary(terms, 1, 1)
    model = fitted(terms, vocab, seeds=[("one", ["aa"]), ("two", ["dd", "ee"])], iterations=4, alpha=0.7, boost=20, seed=9)
    names = sorted({w for t in texts for w in t.split()})
    prior = np.full((3, len(names)), 0.1)
    prior[0, names.index("aa")] = prior[1, names.index("dd")] = prior[1, names.index("ee")] = 2
    start = prior + np.random.default_rng(9).gamma(100, 1 / 100, prior.shape)
    want, gammas = brute([{names.index(w): t.split().count(w) for w in set(t.split())} for t in texts], prior, start, 0.7, 4)
    for q in model.terms.collect():
        assert math.isclose(q.weight, want[q.topic][names.index(q.term)] / sum(want[q.topic]), rel_tol=1e-6)
    for q in model.documents.collect():
        assert math.isclose(q.weight, gammas[q.id][q.topic] / sum(gammas[q.id]), rel_tol=1e-6)


def test_earlier_steps_are_deleted_and_nothing_is_one_group(spark):
    docs, _ = planted(spark, 40)
    terms = topics.tokens(docs)
    vocab = topics.vocabulary(terms)
    root = staging.shared_dir(spark).removeprefix("file://")
    before = {n for n in os.listdir(root) if n.startswith("documents-")}
    model = variational.fit(topics.encode(terms, vocab), vocab, k=3, iterations=5)
    assert len({n for n in os.listdir(root) if n.startswith("documents-")} - before) == 1
    assert "FlatMapGroups" not in model.documents._jdf.queryExecution().executedPlan().toString()


def test_no_documents(spark):
    terms = topics.tokens(spark.createDataFrame([(1, "..")], "id long, text string"))
    model = variational.fit(topics.encode(terms, topics.vocabulary(terms)), topics.vocabulary(terms), k=2)
    assert model.terms.count() == model.documents.count() == 0 and model.objective == []


def test_lda_learns_from_every_document(spark):
    """Each document has a word of its own, which the model only knows if it reads that document."""
    docs = spark.createDataFrame([(k, f"{chr(97 + k // 26)}{chr(97 + k % 26)}own " * 50) for k in range(30)], "id long, text string")
    terms = topics.tokens(docs)
    model = fitted(terms, topics.vocabulary(terms, 1, 1), k=2, iterations=10)
    weights, shares = model.terms, model.documents
    best = {}
    for r in weights.collect():
        best[r.term] = max(r.weight, best.get(r.term, 0))
    assert len(best) == 30 and min(best.values()) > 0.4 * max(best.values()), sorted(best.values())
    assert shares.count() == 60


def test_lda_finds_planted_topics(spark):
    said = [["apple pear plum fig", "desk chair lamp sofa"][k % 2] for k in range(40)]
    terms = topics.tokens(spark.createDataFrame([(k, f"{t} " * 10) for k, t in enumerate(said)], "id long, text string"))
    vocab = topics.vocabulary(terms)
    model = fitted(terms, vocab, k=2)
    weights, shares = model.terms, model.documents
    found = {frozenset(r.term for r in rows) for rows in (topics.top_terms(weights, 4).where(f"topic = {k}").collect() for k in (0, 1))}
    assert found == {frozenset(t.split()) for t in said}
    by = {r.id: r.topic for r in topics.assign(shares).collect()}
    assert len({by[k] for k in range(0, 40, 2)}) == 1 and by[0] != by[1] and len({by[k] for k in range(1, 40, 2)}) == 1


def test_texts_give_the_model_of_their_tokens(spark):
    """Counted where they are read, also where rows share an id or have none, the texts give the model that rows of tokens give; and documents together that of each alone."""
    r = random.Random(3)
    texts = [(k % 37 if k % 11 else None, " ".join(r.choice("aa bb cc dd ee ff éé Gg x 12".split()) for _ in range(r.randrange(0, 60)))) for k in range(90)] + [(500, None), (501, "")]
    for rows in (texts, [(k, t) for k, (_, t) in enumerate(texts)]):
        docs = spark.createDataFrame(rows, "id long, text string")
        terms = topics.tokens(docs)
        vocab = topics.vocabulary(terms)
        one, two = fitted(terms, vocab, k=3, iterations=3), variational.fit_texts(docs, 3, iterations=3)
        for a, b, key in ((one.terms, two.terms, ["topic", "term", "term_id"]), (one.documents, two.documents, ["id", "topic"])):
            a, b = ({tuple(x[c] for c in key): x.weight for x in t.collect()} for t in (a, b))
            assert a.keys() == b.keys() and a and all(math.isclose(a[x], b[x], rel_tol=1e-9) for x in a)
    assert variational.fit_texts(docs.where("id < 0"), 2).terms.count() == 0


def test_no_token_is_exchanged(spark):
    """A few hundred distinct terms said two million times: what is shuffled are counts of terms."""
    said = spark.range(200).select("id", F.expr("array_join(transform(sequence(1, 10000), i -> concat('w', i % 300)), ' ')").alias("text"))
    variational_bags = topics.bags(said)
    assert "Exchange" not in variational_bags._jdf.queryExecution().executedPlan().toString()
    assert variational_bags.agg(F.sum(F.size("terms")).alias("n")).first().n == 200 * 300


def test_documents_at_rest_stay_as_they_are():
    r = np.random.default_rng(2)
    beta, counts, gamma = r.random((3, 40, 9)), r.integers(0, 4, (40, 9)).astype(float), r.random((40, 3)) + 0.5
    together = variational.improved(gamma, counts, beta, 0.4)
    alone = np.concatenate([variational.improved(gamma[[d]], counts[[d]], beta[:, [d]], 0.4) for d in range(40)])
    assert np.allclose(together, alone, rtol=1e-12)


def test_seeded_texts(spark):
    """Seeds of planted themes, counted where the texts are read, give the topics that rows of tokens give."""
    docs, _ = planted(spark, 40)
    terms = topics.tokens(docs)
    one = fitted(terms, topics.vocabulary(terms), seeds=SEEDS, iterations=3)
    two = variational.fit_texts(docs.select("id", "text"), seeds=SEEDS, iterations=3)
    assert one.names == two.names
    a, b = ({(x.id, x.name): x.weight for x in m.documents.collect()} for m in (one, two))
    assert a.keys() == b.keys() and all(math.isclose(a[x], b[x], rel_tol=1e-9) for x in a)
