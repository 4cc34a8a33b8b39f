"""Readers: text, CSV, CHAT, lexicons, crates, office files. Files come through Spark's sources, from any store it knows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trim
from ..operators import graph
from ..operators.selection import header_names
from ..operators.sentiment import LexiconError, lexicon
from ..plans.staging import running, stage
from . import office

SKIPPED_FOLDERS = r"(^|/)(\.[^/]+|node_modules|_config|_backups)/"
READABLE = ("txt", "md", "markdown", "docx", "pdf")


def decode(content: Column) -> Column:
    """Text of a file: UTF-16 by its byte order mark, else UTF-8; the mark is dropped."""
    rest = F.substring(content, F.lit(3), F.length(content))
    return (
        F.when(F.hex(F.substring(content, 1, 2)) == "FFFE", F.decode(rest, "UTF-16LE")).when(F.hex(F.substring(content, 1, 2)) == "FEFF", F.decode(rest, "UTF-16BE"))
        .when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.decode(F.substring(content, F.lit(4), F.length(content)), "UTF-8")).otherwise(F.decode(content, "UTF-8"))
    )


def scan_folder(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """id, file_name, path, length, content of all files below a folder. Content is read only where it is used."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (r.option("pathGlobFilter", pattern) if pattern else r).load(path)
    return files.select(F.col("path").alias("id"), F.regexp_extract("path", r"([^/]*)\z", 1).alias("file_name"), "path", "length", "content")


def in_locale_order(files: DataFrame) -> DataFrame:
    return files.orderBy(F.expr("collate(path, 'UNICODE')"))


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))


def cleanable(files: DataFrame) -> DataFrame:
    """Text files outside hidden and tool folders."""
    return files.where(extension("path").isin("txt", "text", "md") & ~F.col("path").rlike(SKIPPED_FOLDERS))


def readable_for_names(files: DataFrame) -> DataFrame:
    return files.where(extension("path").isin(*READABLE))


def transcript_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with transcripts, one for each base name, .docx before .txt; and those passed over."""
    f = files.where(extension("path").isin("docx", "txt")).withColumn("base", F.regexp_replace("file_name", r"\.[^.]*\z", ""))
    w = Window.partitionBy("base").orderBy(F.when(extension("path") == "docx", 0).otherwise(1), "path")
    n = f.withColumn("r", F.row_number().over(w))
    return n.where("r = 1").drop("r", "base"), n.where("r > 1").select("path", F.concat(F.lit("skipped: "), "file_name").alias("warning"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Corpus rows of plain text files: a row for each line that isn't blank."""
    files = scan_folder(spark, path, "*.txt").select("file_name", decode(F.col("content")).alias("t"))
    lines = files.select(F.col("file_name").alias("source"), F.posexplode(F.split("t", "\r\n?|\n")).alias("k", "text")).where(trim("text") != "")
    return lines.select(F.concat("source", F.lit("#"), (F.col("k") + 1).cast("string")).alias("id"), "source", (F.col("k") + 1).cast("long").alias("line_no"), F.lit("").alias("speaker"), "text")


def paragraphs(text: Column) -> Column:
    """Lines of a plain text in the shape of a document's paragraphs, each followed by a blank line."""
    return F.array_join(F.transform(F.split(text, "\r\n?|\n"), lambda x: F.concat(x, F.lit("\n"))), "\n")


def chat_lines(spark: SparkSession, path: str) -> DataFrame:
    """Corpus rows of CHAT files: `*CODE:` and a tab or space; `@` lines are metadata, tabbed ones continue."""
    files = scan_folder(spark, path, "*.cha").select("file_name", F.regexp_replace(decode(F.col("content")), "\r?\n\t", " ").alias("t"))
    lines = files.select(F.col("file_name").alias("source"), F.posexplode(F.split("t", "\r\n?|\n")).alias("k", "line")).where(F.col("line").startswith("*"))
    said = r"^\*([^:]+):[\t ]*(.*)\z"
    return lines.select(F.concat("source", F.lit("#"), (F.col("k") + 1).cast("string")).alias("id"), "source", (F.col("k") + 1).cast("long").alias("line_no"), F.regexp_extract("line", said, 1).alias("speaker"), F.regexp_extract("line", said, 2).alias("text"))


def csv_parts(spark: SparkSession, path: str, order: str = "row_no", source: str = "file_name", multi_line: bool = True) -> list[DataFrame]:
    """A CSV file, or a folder of them, as strings: a table for each different header, with distinct column names, the row's number in its file (from 1)
    and the file's name.

    Cells may hold line breaks; then a file is read by one task. Where none does, `multi_line=False` lets large files be split.
    """
    # Spark takes the number of columns from one file, so the widest first record is looked up first
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("k"))
    first = lines.groupBy("file").agg(F.min_by("value", "k").alias("v"))
    count = lambda c: F.length(F.regexp_replace("v", f"[^{c}]+", ""))
    widest = first.agg(F.max(count(","))).first()[0]
    if widest is None:
        return []
    # a header that goes on in the next line is taken as Spark reads it; such files are looked at one by one
    for (file,) in first.where(count('"') % 2 == 1).select("file").collect() if multi_line else ():
        head = spark.read.option("header", False).option("multiLine", True).option("quote", '"').option("escape", '"').csv(file)
        widest = max(widest, len(head.columns) - 1)
    t = spark.read.schema(", ".join(f"_c{k} string" for k in range(widest + 1))).option("header", False).option("multiLine", multi_line).option("quote", '"').option("escape", '"').csv(path)
    raw = t.select(F.array(*t.columns).alias("cells"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), F.lit(1).cast("long").alias("one"))
    rows = stage(running(raw, ["file"], ["block", "k"], "one").select("file", "cells", F.col("seq").alias("n")), "csv")
    heads = rows.where("n = 0").select("file", F.col("cells").alias("head"))
    body = rows.where("n > 0").join(heads, "file")
    kinds = sorted((r.head for r in heads.select("head").distinct().collect()), key=lambda x: [c or "" for c in x])
    parts = []
    for head in kinds:
        width = max((k + 1 for k, c in enumerate(head) if c is not None), default=0) if len(kinds) > 1 else len(head)
        mine = body.where(F.col("head").eqNullSafe(F.array(*[F.lit(c).cast("string") for c in head])))
        named = [F.col("cells")[k].alias(c) for k, c in enumerate(header_names(head[:width]))]
        parts.append(mine.select(*named, F.col("n").alias(order), F.regexp_extract("file", r"([^/]*)\z", 1).alias(source)))
    return parts


def csv_table(spark: SparkSession, path: str, order: str = "row_no", multi_line: bool = True) -> DataFrame:
    """The rows of csv_parts() as one table; a column that a file lacks is null there."""
    parts = [p.drop("file_name") for p in csv_parts(spark, path, order, "file_name", multi_line)]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts) if parts else spark.createDataFrame([], f"{order} long")


def csv_corpus(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Corpus rows of a CSV or a folder of them: the text column, or all cells; the speaker from a speaker or speakerId column, in any case. The
    source is the file's name, the line number the row's number in it."""
    out = spark.createDataFrame([], "id string, source string, line_no long, speaker string, text string")
    for t in csv_parts(spark, path, multi_line=multi_line):
        cells = [c for c in t.columns if c not in ("row_no", "file_name")]
        low = {c.strip().lower(): c for c in cells}
        text = F.coalesce(F.col(f"`{low['text']}`"), F.lit("")) if "text" in low else F.concat_ws(" ", *[F.col(f"`{c}`") for c in cells])
        who = low.get("speakerid") or low.get("speaker")
        n = F.col("row_no")
        out = out.unionByName(t.select(F.concat("file_name", F.lit("#"), n.cast("string")).alias("id"), F.col("file_name").alias("source"), n.alias("line_no"), (F.coalesce(F.col(f"`{who}`"), F.lit("")) if who else F.lit("")).alias("speaker"), text.alias("text")))
    return out


def lexicon_csv(spark: SparkSession, path: str) -> DataFrame:
    """A word-category lexicon: header `word,sentiment`, any case, checked."""
    t = csv_table(spark, path)
    names = [c.strip().lower().lstrip("﻿") for c in t.columns if c != "row_no"]
    if names[:2] != ["word", "sentiment"]:
        raise LexiconError("the header must be word,sentiment")
    a, b = [c for c in t.columns if c != "row_no"][:2]
    return lexicon(t.select(F.col(f"`{a}`").alias("word"), F.col(f"`{b}`").alias("category")))


def crate(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """entity and prop of a metadata file."""
    return graph.from_json(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


# -- office files --------------------------------------------------------------------------------------------------------------------


def docx_blocks(content: bytes) -> list[tuple[int, str, str]]:
    """(order, tag, text) of a document's body: h1 to h6, p, caption, and tr for table rows (cells divided by tabs)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return list(office.document_blocks(z))


def _blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for path, content in zip(part["path"], part["content"]):
            try:
                rows += [(path, *b, None) for b in docx_blocks(bytes(content))]
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                rows.append((path, 0, "error", "", str(e)))
        yield pd.DataFrame(rows, columns=["path", "order", "tag", "text", "error"])


def docx(files: DataFrame) -> DataFrame:
    """path, order, tag, text, error: the blocks of documents (path, content). An unreadable file is a row with its error."""
    return files.select("path", "content").mapInPandas(_blocks, "path string, order int, tag string, text string, error string")


def docx_text(blocks: DataFrame) -> DataFrame:
    """path, text: paragraphs divided by blank lines."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("order", "text"))), lambda x: x["text"])
    return blocks.where("tag <> 'error'").groupBy("path").agg(F.concat(F.array_join(parts, "\n\n"), F.lit("\n\n")).alias("text"))


def xlsx_rows(content: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, row number, cells as text) of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        strings = office.shared_strings(z)
        rows = ((name, number, cells) for name, member in office.sheets(z) for number, cells in office.sheet_rows(z, member, strings))
        return [(name, number, [cells.get(k, "") for k in range(max(cells, default=-1) + 1)]) for name, number, cells in rows]


def xlsx(files: DataFrame) -> DataFrame:
    """path, sheet, row_no, cells of workbooks (path, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(p, *r) for p, c in zip(part["path"], part["content"]) for r in xlsx_rows(bytes(c))], columns=["path", "sheet", "row_no", "cells"])

    return files.select("path", "content").mapInPandas(run, "path string, sheet string, row_no int, cells array<string>")


def sheet_table(rows: DataFrame, sheet: str) -> DataFrame:
    """One sheet with its first row as header."""
    mine = rows.where(F.col("sheet") == sheet)
    head = mine.orderBy("row_no").limit(1).first()
    names = header_names(list(head.cells))
    return mine.where(F.col("row_no") > head.row_no).select("row_no", *[F.coalesce(F.get("cells", F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names)])


def merge_config(uploaded: dict | None, folder: dict | None, bundled: dict | None) -> list[dict]:
    """The mapping of a merge: the uploaded, the folder's or the bundled one; both shapes, a list or {column: target}."""
    found = next((c for c in (uploaded, folder, bundled) if c), {})
    body = found.get("mapping", found) if isinstance(found, dict) else found
    if isinstance(body, dict):
        body = [{"source": k, **(v if isinstance(v, dict) else {"target": v})} for k, v in body.items()]
    return [{"source": m["source"], "target": m.get("target") or m["source"], "type": m.get("type") or ""} for m in body]
