"""Word documents and workbooks as Spark data sources: `spark.read.format("docx")`, `format("xlsx")`, and `df.write.format("xlsx")`.

Reading: files are dealt to partitions by size; a task opens a file where it lies, reads the zip members it needs as streams, and yields rows as the XML goes by, so a sheet of any length takes a row's memory
(shared strings apart, which the format keeps in one list). The schema says what is read: `path, order, tag, text` of documents; `path, sheet, row_no, cells` of workbooks, or else named columns, which are looked up in the sheet's
first row, and only their cells are decoded. The option `sheet` names the sheets that are opened (`*`: anything). Writing: each task streams its rows into a workbook of its own in a staging folder, a sheet for every
`most_rows` rows; the driver moves the files when all tasks have ended, or deletes them if one failed.

Options: `path` (file, folder or pattern in the last name; a URI, or a local path), for workbooks `sheet` (default: all, or when columns are named the first). Paths must have a scheme that `pyarrow.fs` knows on driver and
executors. Unreadable files are an error, or with `on_error` = `skip` a warning row (documents: tag `error`) or none (workbooks).
"""

from __future__ import annotations

import fnmatch
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: fixed values: name spaces of the formats
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"

#: Bytes of files that a partition reads, and rows that the format allows a sheet.
PARTITION_BYTES, MOST_ROWS = 64 << 20, 1_048_576

SHEET_ROWS = "path string, sheet string, row_no int, cells array<string>"
BLOCKS = "path string, order int, tag string, text string"

#: What reading a damaged file raises; a file shorter than a directory of members is an invalid position.
UNREADABLE = (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError, ValueError)


def _fs(path: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:", path) else f"file://{path}")


@dataclass
class Files(InputPartition):
    paths: list[str]


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """URIs and sizes of the files that a path names."""
    import pyarrow.fs as pafs

    scheme = m[0] if (m := re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:(//)?[^/]*", path)) else "file://"
    folder, _, name = path.rpartition("/")
    pattern = name if re.search(r"[*?\[]", name) else None
    fs, root = _fs(folder if pattern else path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        found = [info]
    else:
        found = [f for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, pattern or f"*.{suffix}") and not f.base_name.startswith(("_", "."))]
    prefix = scheme if scheme.startswith("file") else scheme.rstrip("/") + "/"
    return sorted((f.path if "://" in f.path else f"file://{f.path}" if scheme.startswith("file") else prefix + f.path.lstrip("/"), f.size) for f in found)


def dealt(files: list[tuple[str, int]]) -> list[Files]:
    out, held = [Files([])], 0
    for path, size in files:
        if held and held + size > PARTITION_BYTES:
            out.append(Files([]))
            held = 0
        out[-1].paths.append(path)
        held += size
    return out


class _Reader(DataSourceReader):
    suffix = ""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.options = schema.fieldNames(), options
        self.sheet = options.get("sheet")

    def partitions(self) -> list[Files]:
        return dealt(listed(self.options["path"], self.suffix))

    def read(self, partition: Files) -> Iterator[tuple]:
        skip = self.options.get("on_error", "fail") == "skip"
        for path in partition.paths:
            try:
                fs, name = _fs(path)
                with fs.open_input_file(name) as f, zipfile.ZipFile(f) as z:
                    yield from self.rows(path, z)
            except UNREADABLE as e:
                if not skip:
                    raise ValueError(f"{path} can't be read: {e}") from e
                yield from self.failed(path, e)

    def failed(self, path: str, error: Exception) -> Iterator[tuple]:
        return iter(())


# -- documents ---------------------------------------------------------------------------------------------------------------------------


def document_blocks(z: zipfile.ZipFile) -> Iterator[tuple[int, str, str]]:
    """order, tag, text of the body's blocks, as they end: h1 to h6, p, caption, and tr for table rows (cells divided by tabs)."""
    order, depth = 0, 0  # depth: of tables
    words: list[str] = []
    cells: list[list[str]] = []
    style = ""
    with z.open("word/document.xml") as f:
        for event, node in ElementTree.iterparse(f, ("start", "end")):
            tag = node.tag
            if event == "start":
                if tag == f"{W}tbl":
                    depth += 1
                elif tag == f"{W}tr" and depth == 1:
                    cells = []
                elif tag == f"{W}tc" and depth == 1:
                    cells.append([])
                elif tag == f"{W}p":
                    words, style = [], ""
                continue
            if tag == f"{W}t":
                words.append(node.text or "")
            elif tag == f"{W}tab":
                words.append("\t")
            elif tag in (f"{W}br", f"{W}cr"):
                words.append("\n")
            elif tag == f"{W}pStyle":
                style = node.get(f"{W}val") or ""
            elif tag == f"{W}p":
                if depth:
                    cells[-1].append("".join(words))
                else:
                    m = re.match(r"(?i)heading\s*([1-6])$", style)
                    yield order, f"h{m[1]}" if m else "caption" if style.lower() == "caption" else "p", "".join(words)
                    order += 1
                node.clear()
            elif tag == f"{W}tr" and depth == 1:
                yield order, "tr", "\t".join(" ".join(c) for c in cells)
                order += 1
                node.clear()
            elif tag == f"{W}tbl":
                depth -= 1
                node.clear()


class DocxReader(_Reader):
    suffix = "docx"

    def rows(self, path: str, z: zipfile.ZipFile) -> Iterator[tuple]:
        for order, tag, text in document_blocks(z):
            row = {"path": path, "order": order, "tag": tag, "text": text}
            yield tuple(row[n] for n in self.names)

    def failed(self, path: str, error: Exception) -> Iterator[tuple]:
        row = {"path": path, "order": 0, "tag": "error", "text": str(error)}
        yield tuple(row[n] for n in self.names)


class DocxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema: StructType) -> DocxReader:
        return DocxReader(schema, dict(self.options))


# -- workbooks -----------------------------------------------------------------------------------------------------------------------------


def column_no(cell: str) -> int:
    """The column of a cell's name, from 0."""
    out = 0
    for x in re.match("[A-Z]*", cell)[0]:
        out = out * 26 + ord(x) - 64
    return out - 1


def column_name(k: int) -> str:
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    out: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        with z.open("xl/sharedStrings.xml") as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag == f"{S}si":
                    out.append("".join(t.text or "" for t in node.iter(f"{S}t")))
                    node.clear()
    return out


def sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names of sheets and of their members."""
    links = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    targets = ((s.get("name"), links[s.get(f"{R}id")]) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet"))
    return [(name, t if t.startswith("xl/") else f"xl/{t}") for name, t in targets]


def sheet_rows(z: zipfile.ZipFile, member: str, strings: list[str], wanted: set[int] | None = None) -> Iterator[tuple[int, dict[int, str]]]:
    """row number, cells by column; only the `wanted` columns, once the caller has put any there."""
    number = 0
    with z.open(member) as f:
        for _, node in ElementTree.iterparse(f):
            if node.tag != f"{S}row":
                continue
            number = int(node.get("r", number + 1))
            cells: dict[int, str] = {}
            at = -1
            for c in node.findall(f"{S}c"):
                at = column_no(c.get("r")) if c.get("r") else at + 1
                if wanted and at not in wanted:
                    continue
                kind, v = c.get("t"), c.find(f"{S}v")
                text = "".join(t.text or "" for t in c.iter(f"{S}t")) if kind == "inlineStr" else (v.text or "") if v is not None else ""
                cells[at] = strings[int(text)] if kind == "s" and text else {"1": "TRUE", "0": "FALSE"}.get(text, text) if kind == "b" else text
            node.clear()
            yield number, cells


class XlsxReader(_Reader):
    suffix = "xlsx"

    def rows(self, path: str, z: zipfile.ZipFile) -> Iterator[tuple]:
        raw = "cells" in self.names
        chosen = [(n, m) for n, m in sheets(z) if self.sheet is None or n == self.sheet or ("*" in self.sheet and fnmatch.fnmatchcase(n, self.sheet))]
        strings = shared_strings(z) if chosen else []
        for name, member in chosen if raw or self.sheet else chosen[:1]:
            if raw:
                for number, cells in sheet_rows(z, member, strings):
                    row = {"path": path, "sheet": name, "row_no": number, "cells": [cells.get(k, "") for k in range(max(cells, default=-1) + 1)]}
                    yield tuple(row[n] for n in self.names)
                continue
            wanted: set[int] = set()
            place: dict[str, int] | None = None
            for number, cells in sheet_rows(z, member, strings, wanted):
                if place is None:
                    place = {}
                    for k in sorted(cells):
                        place.setdefault(cells[k].strip(), k)
                    wanted |= {place[n] for n in self.names if n in place} or {-1}
                else:
                    known = {"path": path, "sheet": name, "row_no": number}
                    yield tuple(cells.get(place[n], "") if n in place else known.get(n) for n in self.names)


@dataclass
class Written(WriterCommitMessage):
    file: str | None


def _cell(at: str, value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", str(value))  # XML has no such characters
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text, {chr(13): "&#13;"})}</t></is></c>'


class XlsxWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        self.names, self.path, self.overwrite = schema.fieldNames(), options["path"].rstrip("/"), overwrite
        self.sheet, self.most = options.get("sheet", "Sheet1"), min(int(options.get("most_rows", MOST_ROWS)), MOST_ROWS)
        self.run = uuid.uuid4().hex
        self.staging = f"{self.path}/_staging-{self.run}"
        if self.most < 2:
            raise ValueError("a sheet holds a header and a row at least")

    def write(self, rows: Iterator[tuple]) -> Written:
        from pyspark import TaskContext

        first = next(rows, None)
        context = TaskContext.get()
        if first is None:
            return Written(None)
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.xlsx"
        fs, root = _fs(self.staging)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{name}") as out:
            self.workbook(out, first, rows)
        return Written(name)

    def workbook(self, out, first: tuple | None, rows: Iterator[tuple]) -> None:
        count = 0
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            while first is not None or not count:
                count += 1
                with z.open(f"xl/worksheets/sheet{count}.xml", "w") as f:
                    f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>'.encode())
                    number, row = 1, tuple(self.names)
                    while row is not None:
                        f.write((f'<row r="{number}">' + "".join(_cell(f"{column_name(k)}{number}", v) for k, v in enumerate(row)) + "</row>").encode())
                        if number == 1:
                            row = first
                        elif number == self.most:
                            first = next(rows, None)
                            break
                        else:
                            row = next(rows, None)
                        number += 1
                    else:
                        first = None
                    f.write(b"</sheetData></worksheet>")
            self.frame(z, count)

    def frame(self, z: zipfile.ZipFile, count: int) -> None:
        head = '<?xml version="1.0" encoding="UTF-8"?>'
        each = range(1, count + 1)
        kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
                   f'<Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kinds}.worksheet+xml"/>' for k in each) + "</Types>")  # fmt: skip
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        named = [(k, escape(self.sheet if k == 1 else f"{self.sheet} {k}", {'"': "&quot;"})) for k in each]
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in named) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{LINKS}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in each) + "</Relationships>")

    def commit(self, messages: list[Written | None]) -> None:
        import pyarrow.fs as pafs

        fs, root = _fs(self.path)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if f.base_name.endswith(".xlsx"):
                    fs.delete_file(f.path)
        done = [m.file for m in messages if m is not None and m.file]
        for file in done:
            fs.move(f"{root}/_staging-{self.run}/{file}", f"{root}/{re.sub(r'-[0-9]+[.]xlsx$', '', file)}-{self.run}.xlsx")
        if not done:  # an empty table is one workbook with its header
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/part-00000-{self.run}.xlsx") as out:
                self.workbook(out, None, iter(()))
        self._cleared()

    def abort(self, messages: list[Written | None]) -> None:
        self._cleared()

    def _cleared(self) -> None:
        import pyarrow.fs as pafs

        fs, root = _fs(self.staging)
        if fs.get_file_info(root).type == pafs.FileType.Directory:
            fs.delete_dir(root)


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return SHEET_ROWS

    def reader(self, schema: StructType) -> XlsxReader:
        return XlsxReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> XlsxWriter:
        return XlsxWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session."""
    from ..plans.staging import ship

    ship(spark)
    spark.dataSource.register(DocxSource)
    spark.dataSource.register(XlsxSource)
