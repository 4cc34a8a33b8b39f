"""WARC archives, chat rotation, the pipeline."""

from __future__ import annotations

import hashlib
import json
import subprocess
import sys
from collections import Counter

import pytest
import zstandard

from verbarium.llm import chat_rotation as C
from verbarium.llm import exact_dedup, language_id, packing, pipeline, quality_mil, simhash
from verbarium.llm import warc as W
from verbarium.llm.common import fresh_dir

PAGES = [
    (1, "http://a/ b", "<p>" + "é" * 100), (2, None, "<p>" + "é" * 100), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "bad\r\nX: y", "z" * 500_000), (None, "n", "<p>" + "é" * 100), (8, "d", "q" * 150),
    (8, "d", "q" * 150), (9, "e", "q" * 150), (None, None, "w" * 120), (None, None, "w" * 120),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, copy int")


def archived(spark, df):
    path = fresh_dir(spark, "warc")
    files = W.archive_pages(df, path)
    return W.read_archives(spark, path), files


def test_round_trip_of_odd_rows(spark):
    rows, files = archived(spark, pages(spark, PAGES))
    got = rows.collect()
    assert len(got) == len(PAGES) == sum(f.records for f in files.collect())
    assert Counter(r.payload_digest for r in got) == Counter(hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in PAGES)
    assert all(r.payload_bytes == len((h or "").encode()) for r in got for i, _, h in PAGES if i is not None and i == r.page_id)
    by = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert {(1, "response", None), (2, "revisit", 1), (5, "response", None), (6, "response", None), (3, "response", None), (8, "response", None), (8, "revisit", 8), (9, "revisit", 8), (None, "revisit", 1)} <= by
    texts = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert bytes(texts[7]).decode() == "z" * 500_000
    assert next(r.target_uri for r in got if r.page_id == 2) == "urn:page:2" and "\n" not in next(r.target_uri for r in got if r.page_id == 7)


def test_no_pages(spark):
    rows, files = archived(spark, pages(spark, []))
    assert rows.count() == 0 and files.count() == 0


def test_archives_roll_over_and_hold_a_dictionary(spark, data):
    df = spark.read.parquet(f"{data}/pages.parquet")
    path = fresh_dir(spark, "warc")
    dictionary = W.train([r.html.encode()[:8000] for r in df.collect()] * 5)
    files = W.write_archives(W.plan_records(df.union(df)), path, dictionary, roll=20_000).collect()
    assert len(files) > 2 and W.read_archives(spark, path).count() == 2 * df.count()
    blob = bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
    assert blob[:4] == b"\x5d\x2a\x4d\x18" and W.read_dictionary(blob)[0] is not None


def record(**change):
    return W.build_record(1, 1, "http://a", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), None, False)


def test_records_are_validated():
    good = record()
    assert W.parse_record(good)["payload_bytes"] == 200
    for bad in (good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"xxx", b"xyx", 1), good.replace(b"Content-Length: 200", b"Content-Length: 201"), b"", good.replace(b"response\r\n", b"odd\r\n", 1)):
        with pytest.raises(W.WarcError):
            W.parse_record(bad)


def test_frames_are_validated():
    frame = zstandard.ZstdCompressor().compress(record())
    for head in (b"", W.dictionary_frame(b"")):
        assert [W.parse_record(f)["page_id"] for f in W.read_frames(head + frame * 3)] == [1, 1, 1]
    for bad in (frame[:-3], b"junk" + frame, frame + b"tail", W.dictionary_frame(b"d" * 50)[:20]):
        with pytest.raises(W.WarcError):
            list(W.read_frames(bad))


# -- chat --------------------------------------------------------------------------------------------------------------------------

TALK = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (1, 2, "assistant", "yes"), (1, 2, "user", None), (1, None, "user", "first"), (2, 0, None, "who"), (2, 1, "user", "é" * 5000), (3, 0, "system", "alone"), (None, 1, "user", "lost")]


def brute_rotation(rows):
    out, talks = [], {}
    for c, t, r, x in rows:
        talks.setdefault(c, []).append((t is not None, t or 0, r or "unknown", hashlib.sha256((x or "").encode()).hexdigest(), t, x or ""))
    for c, turns in talks.items():
        turns.sort(key=lambda v: v[:4])
        for me in {v[2] for v in turns} - {"system"}:
            at = 0
            for k, (_, _, who, _, turn, text) in enumerate(turns):
                role = "system" if who == "system" else "assistant" if who == me else "user"
                head = f"<|im_start|>{'user name=' + who if role == 'user' else role}\n"
                seg = f"{head}{text}<|im_end|>\n"
                mask = (at + len(head), len(seg) - len(head)) if role == "assistant" else (0, 0)
                out.append((c, me, k, turn, who, role, seg, at, len(seg), *mask))
                at += len(seg)
    return sorted(out, key=str)


def test_rotation(spark, data):
    odd = spark.createDataFrame([(*r, 5, "s") for r in TALK], "conv_id long, turn long, role string, text string, seq int, speaker string")
    for df in (odd, spark.read.parquet(f"{data}/conversations.parquet")):
        rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
        assert sorted(map(tuple, C.rotate(df).collect()), key=str) == brute_rotation(rows)


def test_dialogues_are_put_together(spark):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    whole = C.assemble(C.rotate(df)).where("conv_id = 1 and perspective = 'assistant'").first()
    assert whole.text.startswith("<|im_start|>user name=user\nfirst<|im_end|>\n<|im_start|>system\nbe kind")
    assert [whole.text[m.start : m.start + m.length] for m in whole.masks] == ["yes<|im_end|>\n"] * 2
    parts = C.assemble(C.rotate(df), 1000).where("conv_id = 2 and perspective = 'user'").orderBy("part").collect()
    assert "".join(p.text for p in parts).endswith("é<|im_end|>\n")


def test_no_conversations(spark):
    assert C.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# -- pipeline ----------------------------------------------------------------------------------------------------------------------


def test_pipeline_against_its_parts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    good = {r.doc_id for r in language_id.identify(docs).collect() if r.lang_pred != "und"}
    first = docs.where(docs.doc_id.isin(sorted(good)))
    good = {r.doc_id for r in quality_mil.score_quality(first, spark.read.parquet(f"{data}/labels.parquet")).collect() if r.predicted}
    best = {}
    for i in sorted(good):  # exact copies: the longest, then the smallest id
        key = "".join(rows[i].split(" "))
        key = rows[i].encode().translate(None, exact_dedup.SPACE_BYTES)
        if key not in best or len(rows[i]) > len(rows[best[key]]):
            best[key] = i
    left = sorted(best.values())
    fps = [simhash.fingerprint(rows[i].encode()) for i in left]
    root = list(range(len(left)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(left)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    left = {left[k] for k in range(len(left)) if find(k) == k}
    got = pipeline.run(spark, data).collect()
    assert {r.doc_id for r in got} == left
    want = {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in packing.pieces(docs.where(docs.doc_id.isin(sorted(left)))).collect()}
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_stages_on_odd_and_empty_documents(spark, odd, none, data):
    for docs in (odd, none):
        for name, function in pipeline.STAGES:
            out = function(spark, docs, data)
            assert name == "packing" or out.columns == docs.columns
            n = out.count()
            assert n <= docs.count() + 50 and (n > 0) == (docs is odd)


def test_rest_works_without_the_operators(tmp_path):
    """The entry module imports and offers the other queries where this subpackage is gone."""
    import os
    import shutil

    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{here}/verbarium", tmp_path / "verbarium", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import json, __spark_entry__ as e; print(json.dumps(sorted(e.queries())))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    names = json.loads(out.stdout)
    assert "bigram_assoc" in names and not [n for n in names if n.startswith("op") and n[2].isdigit()] and "pipeline" not in names


def test_filtering_stages_judge_rows_not_keys(spark, data):
    """Rows without doc_id, and different texts with one doc_id, stay or go each by itself."""
    a, b, c = ("the cat and the hat of the house by the sea " * 8, "old ships came late to a harbour of salt and rope " * 8, "no rain fell on fields where farmers sowed their grain " * 8)
    given = [(None, a), (None, b), (7, "12 34 !!"), (7, c), (8, a), (8, a), (None, c), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(given)], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(pipeline.STAGES)
    kept = lambda name: sorted(r.n_chars for r in stages[name](spark, docs, data).collect())
    assert kept("language_id") == [0, 1, 3, 4, 5, 6]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_mil.good_documents(docs, labels).count() == len(given)
    want = {1, 2, 3, 7}  # and one of the two equal rows with id 8
    for name in ("exact_dedup", "simhash"):
        got = set(kept(name))
        assert len(got & {4, 5}) == 1 and got - {4, 5} == want, (name, got)
