"""Registered queries over office files and pages that they write, and their SQL."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import templates
from ..sources import office
from .graph_queries import shop_graph
from .staging import fresh_dir, ship

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("workbook_round_trip", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN 'TRUE' ELSE 'FALSE' END AS first FROM orders")
def workbook_round_trip(spark, d):
    """Orders written as workbooks of several sheets and read again, three of their columns."""
    office.register(spark)
    path = fresh_dir(spark, "workbook")
    orders = spark.read.parquet(f"{d}/orders.parquet")
    first = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 5 == 1).alias("first")
    orders.select("o_orderkey", "o_custkey", "o_orderstatus", first, "o_totalprice", "o_orderpriority").repartition(3, "o_orderkey").write.format("xlsx").option("sheet", "Orders & more").option("most_rows", 2000).mode("append").save(path)
    return spark.read.format("xlsx").schema("o_orderkey string, o_orderpriority string, first string").option("sheet", "Orders & more*").load(path)


def _document(turns: list[dict]) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(
        f'<w:p><w:pPr><w:pStyle w:val="Heading{1 + t["turn"] % 6}"/></w:pPr><w:r><w:t>{escape(t["role"] or "")}</w:t></w:r></w:p><w:p><w:r><w:t xml:space="preserve">{escape(t["text"] or "")}</w:t></w:r></w:p>' for t in turns
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@query("document_source", """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS k FROM conversations),
b AS (SELECT conv_id, 2 * k AS n, 'h' || (1 + turn % 6) AS tag, role AS text FROM t UNION ALL SELECT conv_id, 2 * k + 1, 'p', text FROM t)
SELECT 'c' || conv_id || '.docx' AS file, CAST(n AS INTEGER) AS "order", tag, text FROM b""")
def document_source(spark, d):
    """A Word document for each conversation, written by the tasks and read as a source."""
    office.register(spark)
    ship(spark)
    path = fresh_dir(spark, "documents")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist()):
                with fs.open_output_stream(f"{root}/c{conv}.docx") as f:
                    f.write(_document(turns))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id")], ["conv_id"])

    turns = spark.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))  # a document each
    turns.mapInArrow(run, "conv_id long").count()
    return spark.read.format("docx").load(path).select(F.regexp_extract("path", r"([^/]*)\z", 1).alias("file"), "order", "tag", "text")


@query("entity_pages", """
WITH p AS (
  SELECT '#s' || s_suppkey AS id, s_name AS name, printf('%.2f', s_acctbal) AS balance, '#n' || s_nationkey AS nation FROM supplier)
SELECT id, '<!DOCTYPE html><html><head><meta charset="utf-8"><title>' || name || '</title></head><body><h1>' || name || '</h1><p>Supplier</p><dl><dt>balance</dt><dd>' || balance || '</dd><dt>name</dt><dd>' || name
  || '</dd><dt>nation</dt><dd><a href="' || nation || '">' || nation || '</a></dd></dl></body></html>' AS html FROM p""")
def entity_pages(spark, d):
    """Pages of a graph's suppliers."""
    entity, prop = shop_graph(spark, d)
    return templates.pages(entity.where(F.array_contains("types", "Supplier")), prop)
