from __future__ import annotations

import io
import re
import tarfile
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbarium.operators import formats as X


def archive(*members, first_stored=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members:
            z.writestr(name, text)
    return out.getvalue()


def files():
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        t.addfile(tarfile.TarInfo("a.txt"))
    types = ("[Content_Types].xml", "<Types/>")
    return {
        "a/one.pdf": (b"%PDF-1.5\n" + b"x" * 5000 + b"\n%%EOF\n", "fmt/19", None),
        "a/junk.pdf": (b"\0" * 900 + b"%PDF-1.2 " + b"%%EOF" + b"\n" * 700, "fmt/16", None),
        "late.pdf": (b"\0" * 2000 + b"%PDF-1.2 %%EOF", "fmt/14", X.ONLY_EXTENSION),
        "pdf.doc": (b"%PDF-2.0\n%%EOF", "fmt/1129", X.NO_EXTENSION),
        "b.docx": (archive(types, ("word/document.xml", "<w/>" * 9000), ("word/media/big.bin", "x" * 200_000)), "fmt/412", None),
        "b.xlsx": (archive(types, ("xl/workbook.xml", "<x/>")), "fmt/214", None),
        "really.docx": (archive(types, ("xl/workbook.xml", "<x/>")), "fmt/214", X.NO_EXTENSION),
        "plain.zip": (archive(("my/word/document.xml", ""), types, ("word/document.xml.bak", "")), "x-fmt/263", None),
        "t.tar": (tar.getvalue(), "x-fmt/265", None),
        "p.png": (bytes.fromhex("89504E470D0A1A0A0000000D49484452") + b"\0" * 9, "fmt/11", None),
        "p.jpeg": (b"\xff\xd8\xff\xe0\0\x10JFIF\0\x01\x01rest", "fmt/43", None),
        "raw.jpg": (b"\xff\xd8\xff\xdb\0", "fmt/41", None),
        "w.wav": (b"RIFF\1\2\3\4WAVEfmt \x10\0\0\0\x01\0", "fmt/141", None),
        "page.html": (b"\n <!DOCTYPE html><html>", "fmt/471", None),
        "page.xml": (b"<?xml version='1.0'?><svg/>", "fmt/92", X.NO_EXTENSION),
        "t.csv": ("a,é\n".encode(), "x-fmt/18", None),
        "t.weird": (b"words", "x-fmt/111", X.ONLY_TEXT),
        "t.md": (b"\0\1", "fmt/1149", X.ONLY_EXTENSION),
        "noext": (b"\0\1", None, None),
        "empty.txt": (b"", "x-fmt/111", X.ONLY_EXTENSION),
        "empty": (b"", None, None),
    }


def test_files_by_content(spark, tmp_path):
    made = files()
    for name, (content, _, _) in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    want = {name: (puid, warning) for name, (_, puid, warning) in made.items() if puid}
    held = spark.createDataFrame([(n, bytearray(c)) for n, (c, _, _) in made.items()], "path string, content binary")
    whole = X.identify(X.edges_of_content(held))
    assert {r.path: (r.puid, r.warning) for r in whole.collect()} == want
    read = X.edges(spark, f"file://{tmp_path}")
    del want["empty.txt"]  # Spark lists no empty files
    assert {r.path.split(f"{tmp_path}/")[1]: (r.puid, r.warning) for r in X.identify(read).collect()} == want
    most = read.agg(F.max(F.octet_length("head")), F.max(F.octet_length("tail"))).first()
    assert most[0] <= X.head_bytes() and most[1] <= X.tail_bytes()
    plan = spark.read.format("binaryFile").load(f"file://{tmp_path}").select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


def test_encoding_formats(spark):
    rows = spark.createDataFrame([("a", "fmt/1", "A", "x/y", None), ("b", "fmt/2", "B", None, "w")], "path string, puid string, name string, mime string, warning string")
    assert [(r.encoding_format, r.warning) for r in X.encoding_formats(rows).orderBy("path").collect()] == [("x/y", None), (X.REGISTRY + "fmt/2", "w")]


def test_priorities_and_tables(spark):
    a, b, c = (X.Signature(p, p, None, ("x",), (X.Sequence(s),), over=o) for p, s, o in (("f/1", "4142", ()), ("f/2", "41", ()), ("f/3", "414243", ("f/1", "f/2"))))
    held = spark.createDataFrame([("1.x", bytearray(b"ABCD"), bytearray()), ("2.x", bytearray(b"ABD"), bytearray()), ("3.x", bytearray(b"AD"), bytearray()), ("4.x", None, None)], "path string, head binary, tail binary")
    got = {r.path: r.puid for r in X.identify(held, (a, b, c)).collect()}
    assert got == {"1.x": "f/3", "2.x": "f/1", "3.x": "f/2", "4.x": "f/1"}  # the last by its extension
    table = spark.createDataFrame([(2, "f/9", "N", "m/n", ["x"], [("41", 1, 3, True)], None, ["f/1"], None), (1, "t/1", "T", None, None, None, ["a.xml"], None, True)], "no int, puid string, name string, mime string, extensions array<string>, sequences array<struct<bytes:string,low:int,high:int,at_end:boolean>>, members array<string>, over array<string>, text boolean")
    assert X.signatures_of(table) == (X.Signature("t/1", "T", None, members=("a.xml",), text=True), X.Signature("f/9", "N", "m/n", ("x",), (X.Sequence("41", 1, 3, True),), over=("f/1",)))


def test_sequences():
    assert X.pattern_of("41 ?? {2} {1-3} [30:39] (41|4243) ") == (r"\x41..{2,2}.{1,3}[\x30-\x39](?:\x41|\x42\x43)", 10)
    for wrong in ("4", "4G", "(41", "41)", "{x}"):
        with pytest.raises(ValueError):
            X.pattern_of(wrong)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=12), st.integers(0, 4), st.integers(0, 3), st.booleans())
def test_offsets(content, low, more, at_end):
    s = X.Sequence("61??62", low, low + more, at_end)
    pattern = (X._in_tail(s) if at_end else X._in_head(s))[0].replace(r"\z", r"\Z")
    hits = [k for k in range(len(content) - 2) if content[k] == 0x61 and content[k + 2] == 0x62]
    want = any(low <= (len(content) - k - 3 if at_end else k) <= low + more for k in hits)
    assert bool(re.search(pattern, content.decode("latin-1"))) == want
