"""Choosing documents: rows of a corpus (id, source, line_no, speaker, text) from texts and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim

ALL = "__all__"


def corpus(df: DataFrame, *, source: str = "source", order: str, text: str = "text", speaker: str | None = None, id_prefix: str = "") -> DataFrame:
    """Any table as a corpus: id, source, line_no, speaker, text; missing text and speaker are empty."""
    who = F.coalesce(F.col(speaker).cast("string"), F.lit("")) if speaker else F.lit("")
    src = F.col(source).cast("string")
    return df.select(
        F.concat(F.lit(id_prefix), src, F.lit("#"), F.col(order).cast("string")).alias("id"), src.alias("source"), F.col(order).cast("long").alias("line_no"),
        who.alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def header_names(header: list[str]) -> list[str]:
    """Distinct column names: a repeated name gets ` (2)`, a blank one is `column N`."""
    seen: dict[str, int] = {}
    out = []
    for k, name in enumerate(header, 1):
        base = (name or "").strip() or f"column {k}"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base} ({seen[base]})")
    return out


def default_columns(columns: list[str]) -> list[str]:
    """The text column if there is one, else all."""
    return [c for c in columns if c.strip().lower() == "text"][:1] or list(columns)


def row_text(columns: list[str]) -> Column:
    """Cells of a row that aren't blank, joined by a space."""
    cells = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])
    return F.array_join(F.filter(cells, lambda x: trim(x) != ""), " ")


def table_documents(table: DataFrame, source: str, order: str, columns: list[str] | None = None) -> DataFrame:
    """A document for each row of a table, of the chosen columns in the order of the header; blank rows go."""
    names = [c for c in table.columns if c != order]
    chosen = names if columns is None else [c for c in names if c in columns]
    t = table.select(F.col(order).cast("long").alias("line_no"), (row_text(chosen) if chosen else F.lit("")).alias("text")).where(trim("text") != "")
    return t.select(F.concat(F.lit(f"{source}#"), F.col("line_no").cast("string")).alias("id"), F.lit(source).alias("source"), "line_no", F.lit("").alias("speaker"), "text")


def select_documents(docs: DataFrame, tables: dict[str, tuple[DataFrame, str]] | None = None, source: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """All documents, those of one source, or, for a table's source, its rows. tables: name -> (rows, order column)."""
    if source in (None, ALL):
        return docs
    if tables and source in tables:
        table, order = tables[source]
        return table_documents(table, source, order, columns)
    return docs.where(F.col("source") == source)


def select_many(docs: DataFrame, tables: dict[str, tuple[DataFrame, str]] | None = None, sources: list[str] | None = None, columns: dict[str, list[str]] | None = None) -> DataFrame:
    """Several sources in the given order (column branch); None: all documents; []: none."""
    if sources is None:
        return docs.withColumn("branch", F.lit(0))
    if not sources:
        return docs.where(F.lit(False)).withColumn("branch", F.lit(0))
    parts = [select_documents(docs, tables, s, (columns or {}).get(s)).select("id", "source", "line_no", "speaker", "text").withColumn("branch", F.lit(k)) for k, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, parts)


def topic_documents(docs: DataFrame, tables: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """Documents for topics: one for each file, its lines joined; one for each row of a table, numbered from 1 before blank rows go.

    A row holds a whole source, as it is meant to be shown. Topic models need no more than `topic_rows`, whose rows stay as small as the lines.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    whole = docs if not tables else docs.where(~F.col("source").isin(*tables))
    out = whole.groupBy("source").agg(F.min("line_no").alias("line_no"), trim(F.array_join(F.transform(ordered, lambda x: x["text"]), " ")).alias("text"))
    out = out.select(F.col("source").alias("id"), "source", F.col("source").alias("label"), "line_no", "text").where("text <> ''")
    for name, (table, order) in (tables or {}).items():
        rows = table_documents(table, name, order)
        number = F.col("line_no").cast("string")
        out = out.unionByName(rows.select(F.concat(F.lit(f"{name}#row-"), number).alias("id"), "source", F.concat(F.lit(f"{name} · row "), number).alias("label"), "line_no", "text"))
    return out


def topic_rows(docs: DataFrame, tables: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """id, line_no, text: what topic_documents() joins, line by line; `id` is the same. Terms of an id count as those of one document, so a source of any
    size is never gathered."""
    whole = docs if not tables else docs.where(~F.col("source").isin(*tables))
    out = whole.select(F.col("source").alias("id"), "line_no", "text")
    for name, (table, order) in (tables or {}).items():
        rows = table_documents(table, name, order)
        out = out.unionByName(rows.select(F.concat(F.lit(f"{name}#row-"), F.col("line_no").cast("string")).alias("id"), "line_no", "text"))
    return out.where(trim("text") != "")


def sources(docs: DataFrame, tables: list[str] = ()) -> DataFrame:
    """Distinct sources of documents and tables in locale order."""
    names = docs.select("source").distinct()
    if tables:
        names = names.union(docs.sparkSession.createDataFrame([(t,) for t in tables], "source string")).distinct()
    return names.orderBy(F.expr("collate(source, 'UNICODE')"), "source")


def contains(df: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    """Rows in which one of the columns holds the query, in any case."""
    q = query.strip().lower()
    if not q:
        return df
    return df.where(reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).contains(q) for c in columns or df.columns]))


def option(value: object, default: int, low: int, high: int | None = None) -> int:
    """A number from a form: leading digits, the default if there are none, kept in its range."""
    import re

    m = re.match(r"\s*([+-]?\d+)", str(value))
    n = int(m[1]) if m else default
    return max(low, n if high is None else min(high, n))
