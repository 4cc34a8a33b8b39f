from __future__ import annotations

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from verbarium.operators import templates
from verbarium.sources import office, readers

SCHEMA = "id long, text string, yes boolean, x double, d date"


@pytest.fixture(scope="module")
def formats(spark):
    office.register(spark)
    return spark


def test_workbooks_round_trip(formats, spark, tmp_path):
    rows = [(k, f" <a & \"b\">\r\n\t'é日😀' \x01{k}", k % 2 == 0 if k % 3 else None, k / 7, None) for k in range(50)] + [(None, None, None, float("nan"), None), (60, "", None, None, None)]
    path = f"file://{tmp_path}/w"
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.format("xlsx").option("sheet", "A&B").option("most_rows", 7).mode("append").save(path)
    assert all(f.endswith(".xlsx") and f.startswith("part-") for f in os.listdir(f"{tmp_path}/w"))  # nothing staged is left
    got = spark.read.format("xlsx").schema("yes string, text string, id string, absent string").option("sheet", "A&B*").load(path).collect()
    want = [("" if y is None else str(y).upper(), (t or "").replace("\x01", ""), "" if k is None else str(k), None) for k, t, y, _, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    raw = spark.read.format("xlsx").load(path)
    assert raw.where("row_no > 7").count() == 0 and raw.where("row_no = 1").select("cells").distinct().collect()[0].cells == ["id", "text", "yes", "x", "d"]
    assert spark.read.format("xlsx").option("sheet", "none").load(path).count() == 0
    spark.createDataFrame(rows[:1], SCHEMA).write.format("xlsx").mode("overwrite").save(path)
    again = spark.read.format("xlsx").load(path)
    assert again.count() == 2 and {r.sheet for r in again.collect()} == {"Sheet1"}


def test_empty_tables_and_failed_writes(formats, spark, tmp_path):
    empty = f"file://{tmp_path}/empty"
    spark.createDataFrame([], SCHEMA).write.format("xlsx").mode("append").save(empty)
    assert [r.cells for r in spark.read.format("xlsx").load(empty).collect()] == [["id", "text", "yes", "x", "d"]]
    failing = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("stop")).cast("string")).otherwise("a").alias("t"))
    with pytest.raises(Exception, match="stop"):
        failing.write.format("xlsx").mode("append").save(f"file://{tmp_path}/failed")
    left = [f for _, _, files in os.walk(f"{tmp_path}/failed") for f in files]
    assert not [f for f in left if f.endswith(".xlsx")]


def test_names_of_columns():
    assert [office.column_name(k) for k in (0, 25, 26, 51, 52, 701, 702)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]
    assert all(office.column_no(f"{office.column_name(k)}9") == k for k in range(2000))
    assert [len(p.paths) for p in office.dealt([("a", office.PARTITION_BYTES - 1), ("b", 1), ("c", 1), ("d", office.PARTITION_BYTES * 3), ("e", 0)])] == [2, 1, 1, 1]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document {W}><w:body>{body}</w:body></w:document>')


def test_documents(formats, spark, tmp_path):
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\'{style}\'/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    table = f"<w:tbl><w:tr><w:tc>{p('a')}{p('b')}</w:tc><w:tc><w:tbl><w:tr><w:tc>{p('in')}</w:tc></w:tr></w:tbl></w:tc></w:tr><w:tr><w:tc>{p('c')}</w:tc></w:tr></w:tbl>"
    docx(tmp_path / "one.docx", p("Top", "Heading1") + p("one<w:tab/></w:t><w:br/><w:t>two") .replace("<w:tab/></w:t>", "</w:t><w:tab/>") + table + p("under", "Caption") + "<w:p/>" + p("x", "Heading9"))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "note.txt").write_text("no document")
    read = spark.read.format("docx").option("on_error", "skip").load(f"{tmp_path}")
    got = sorted((os.path.basename(r.path), r.order, r.tag, r.text) for r in read.collect())
    assert got[0][:3] == ("bad.docx", 0, "error")
    assert got[1:] == [("one.docx", k, t, x) for k, (t, x) in enumerate([("h1", "Top"), ("p", "one\t\ntwo"), ("tr", "a b\tin"), ("tr", "c"), ("caption", "under"), ("p", ""), ("p", "x")])]
    with pytest.raises(Exception, match="can't be read"):
        spark.read.format("docx").load(f"file://{tmp_path}").collect()
    assert spark.read.format("docx").schema("text string").load(f"file://{tmp_path}/o*.docx").count() == 7
    held = spark.read.format("binaryFile").load(f"{tmp_path}/one.docx")
    assert [(r.order, r.tag, r.text) for r in readers.docx(held).orderBy("order").collect()] == [g[1:] for g in got[1:]]


# -- templates -----------------------------------------------------------------------------------------------------------------------


def shown(spark, template, name="N", n=1, words=("a", "<b>"), people=(("x", 1), ("y", None)), flag=True):
    df = spark.createDataFrame([(name, n, list(words) if words is not None else None, [tuple(p) for p in people], flag)], "name string, n int, words array<string>, people array<struct<who: string, age: int>>, flag boolean")
    return df.select(templates.render(df, template).alias("t")).first().t


def test_templates(spark):
    assert shown(spark, "{{name}}|{{{name}}}", name="<i>&'\"") == "&lt;i&gt;&amp;&#39;&quot;|<i>&'\""
    assert shown(spark, "{{#each words}}[{{@index}}:{{this}} {{name}}]{{/each}}") == "[0:a N][1:&lt;b&gt; N]"
    assert shown(spark, "{{#each people}}{{who}}{{#if age}}={{age}}{{else}}?{{/if}};{{#each words}}{{who}}{{this}}{{/each}} {{/each}}{{! gone }}") == "x=1;xax&lt;b&gt; y?;yay&lt;b&gt; "
    for template, options, want in (("{{#if n}}y{{else}}n{{/if}}", {"n": 0}, "n"), ("{{#if name}}y{{/if}}", {"name": ""}, ""), ("{{#if words}}y{{else}}n{{/if}}", {"words": None}, "n"), ("{{#if flag}}y{{else}}n{{/if}}", {"flag": None}, "n"), ("{{#each words}}x{{/each}}{{n}}", {"words": None, "n": None}, ""), ("", {}, ""), ("{ {{n}} }", {}, "{ 1 }")):
        assert shown(spark, template, **options) == want
    for wrong in ("{{#if n}}", "{{/if}}", "{{else}}", "{{#each n}}{{/each}}", "{{nothing}}", "{{words}}", "{{#if n}}{{/each}}", "{{a b}}", "{{#if n}}{{else}}{{else}}{{/if}}"):
        with pytest.raises(templates.TemplateError):
            shown(spark, wrong)
    assert [templates.chosen(*x) for x in (("a", "b", "c"), (" ", "b", "c"), (None, None, "c"))] == ["a", "b", "c"]


def test_pages(spark):
    entity = spark.createDataFrame([("#a", ["Person", "Agent"]), ("#b", [])], "id string, types array<string>")
    prop = spark.createDataFrame([("#a", "name", 0, "A & B", None), ("#a", "knows", 1, None, "#b"), ("#a", "knows", 0, "somebody", None)], "id string, key string, ord int, value string, ref string")
    got = {r.id: r.html for r in templates.pages(entity, prop).collect()}
    assert "<h1>A &amp; B</h1><p>Person, Agent</p>" in got["#a"] and '<dt>knows</dt><dd>somebody</dd><dd><a href="#b">#b</a></dd>' in got["#a"]
    assert got["#b"].endswith("<h1>#b</h1><dl></dl></body></html>")
