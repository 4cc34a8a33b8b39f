from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from verbarium.llm import components as C
from verbarium.llm import simhash as S


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    f = np.array(fps, dtype=np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 4):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    roots = {}
    for k, i in enumerate(ids):
        if i is not None:
            r = find(k)
            roots[r] = min(roots.get(r, i), i)
    return [roots.get(find(k)) for k in range(len(ids))]


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], [f"{f:016x}" for f in fps], brute_components([i for i, _ in rows], fps)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.near_dedup(docs).collect()), key=str) == want


def test_documents(documents):
    check(documents)


def test_odd_rows(odd):
    check(odd)


def test_empty_table(none):
    assert S.near_dedup(none).count() == 0


def test_golay_is_perfect():
    g = S.golay()
    x = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    codeword = x ^ g.leader[g.syndrome(x)]
    assert (g.syndrome(codeword) == 0).all() and (np.bitwise_count(codeword ^ x) <= 3).all()
    assert sorted(set(g.n_near.tolist())) == [1, 6]


def test_keys_meet_at_four_errors():
    r = random.Random(1)
    x = np.array([r.getrandbits(64) for _ in range(1500)], dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in r.sample(range(64), r.randint(1, 4)):
            y[i] ^= np.uint64(1 << b)

    def table(f):
        out = [{} for _ in f]
        for i, k, s in zip(*(c.tolist() for c in S.keys(f))):
            out[i].setdefault(k, set()).add(s)
        return out

    for a, b in zip(table(x), table(y)):
        assert any(0 in a[k] and 0 in b[k] or any(s != t for s in a[k] for t in b[k]) for k in a.keys() & b.keys())


def test_dense_group_in_blocks(spark):
    """Thousands of fingerprints around one centre: the links are a forest, and small blocks find the same components."""
    r = random.Random(2)
    centre = r.getrandbits(64)
    fps = sorted({centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(1500)} | {r.getrandbits(64) for _ in range(300)})
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = brute_components(list(range(len(fps))), fps)
    for bucket in (S.BUCKET, 64):
        links = S.near_links(frame, bucket)
        roots = {r_.node & (1 << 64) - 1: r_.root for r_ in C.components(links).collect()}
        got = {}
        for k, f in enumerate(fps):
            got.setdefault(roots.get(f, f), set()).add(want[k])
        assert all(len(v) == 1 for v in got.values()) and len(got) == len(set(want))


def test_keys_are_never_broadcast(spark, capsys):
    """A fingerprint becomes a hundred keys, which Spark sizes as a few: under its own threshold it would broadcast them all."""
    frame = spark.range(2000).select(F.xxhash64("id").alias("fp"))
    S.near_links(frame).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_a_long_chain(spark):
    chain = spark.range(0, 3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = C.components(chain)
    assert out.count() == 3001 and out.select("root").distinct().collect()[0].root == 0


def test_stage(odd):
    kept = S.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({r.component_id for r in S.near_dedup(odd).collect()}, key=str)
