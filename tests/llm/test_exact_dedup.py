from __future__ import annotations

import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from verbarium.llm import exact_dedup as E
from verbarium.llm.common import SPACE_BYTES


def norm(t):
    return (t or "").encode().translate(None, SPACE_BYTES)


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((i, t))
    out = []
    for key, own in groups.items():
        best = min(own, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        seen = False
        for i, t in own:
            kept = (i, len(t or "")) == (best[0], len(best[1] or "")) and not seen
            seen |= kept
            out.append((i, best[0], len(own), kept, hashlib.sha256(key).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def test_against_brute_force(odd, documents):
    for docs in (odd, documents):
        assert result(E.exact_dedup(docs)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_empty_table(none):
    assert E.exact_dedup(none).count() == 0


def test_digests_that_collide_are_not_used(odd):
    weak = lambda b: bytes([len(b) % 2])
    assert not E.verified(odd.select("doc_id", "text"), weak)
    assert result(E.exact_dedup(odd, (weak, *E.DIGESTS))) == result(E.exact_dedup(odd))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=5000), max_size=8), st.binary(min_size=3000, max_size=20_000))
def test_chunks_make_up_the_text_and_depend_on_it_alone(others, text):
    alone = next(iter(E.cut([text])))
    assert b"".join(alone) == text and all(len(c) <= E.MAX_CHUNK for c in alone)
    assert list(E.cut([*others, text]))[-1] == alone


def test_equal_passages_give_equal_chunks():
    import random

    r = random.Random(5)
    shared = bytes(r.randrange(256) for _ in range(60_000))
    a, b = (next(iter(E.cut([head + shared]))) for head in (b"one head", b"another, longer head" * 40))
    assert len(set(a) & set(b)) > 0.8 * len(a)


def test_stage_keeps_one_row_of_each_group(odd):
    kept = E.drop_copies(odd)
    assert kept.columns == odd.columns
    want = sorted((i for i, _, _, kept_, _ in brute([(r.doc_id, r.text) for r in odd.collect()]) if kept_), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == want and 3 in want and 2 not in want
