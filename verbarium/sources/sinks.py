"""Writers: exact CSV text, one file for each document, tables for each type, run records."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import round_half_up
from ..operators.transcripts import csv_cell

SHOWN = 2000


def csv_line(columns: list[str]) -> Column:
    """A row as CSV: only cells that need it are quoted."""
    return F.concat_ws(",", *[csv_cell(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in columns])


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Rows as CSV lines in that exact form, the header in every part, so that each is a table of its own."""
    header = ",".join(_cell(c) for c in df.columns)
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    line = csv_line(df.columns)
    lines = df.select(F.when(first, F.concat(F.lit(header + "\n"), line)).otherwise(line).alias("value"))
    if df.isEmpty():
        lines = df.sparkSession.createDataFrame([(header,)], "value string")
    lines.write.mode("overwrite" if overwrite else "errorifexists").text(path)


def _cell(x: str) -> str:
    return '"' + x.replace('"', '""') + '"' if re.search('[,"\n]', x) else x


def write_files(texts: DataFrame, path: str, overwrite: bool = False, existing: DataFrame | None = None) -> DataFrame:
    """texts: doc, text. A folder for each document below `path`; documents in `existing` (doc) are skipped unless overwritten. Returns the
    documents skipped."""
    skipped = texts.join(existing, "doc", "left_semi") if existing is not None and not overwrite else texts.where(F.lit(False))
    todo = texts.join(existing, "doc", "left_anti") if existing is not None and not overwrite else texts
    todo.select("doc", F.col("text").alias("value")).write.mode("overwrite" if overwrite else "append").partitionBy("doc").text(path)
    return skipped.select("doc", F.lit("file exists, overwrite is off").alias("warning"))


def write_types(tables: dict[str, DataFrame], path: str, overwrite: bool = False) -> None:
    """One CSV folder for each type."""
    for name, table in tables.items():
        write_csv(table, f"{path}/{re.sub(r'[^A-Za-z0-9_-]+', '_', name)}.csv", overwrite)


def fixed(df: DataFrame, digits: int, columns: list[str]) -> DataFrame:
    """Numbers as they are exported: a fixed number of decimals; nulls empty."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", round_half_up(F.col(c), digits))).otherwise("") for c in columns})


def shown(df: DataFrame) -> DataFrame:
    """What a panel shows; exports carry all rows."""
    return df.limit(SHOWN)


def slug_name(text: str, most: int = 40) -> str:
    return re.sub(r"^-+|-+$", "", re.sub(r"[^a-z0-9]+", "-", text.strip().lower()))[:most] or "export"


def export_name(kind: str, *, query: str = "", n: int = 2, day: date | None = None) -> str:
    """File names of exports."""
    if kind == "concordance":
        return f"wordfinder-{slug_name(query)}.csv"
    if kind == "ngrams":
        return f"ngrams-n{n}.csv"
    return f"{kind}-{(day or date.today()).isoformat()}.csv"


def parameters(**values: object) -> str:
    """A record of a run's parameters, a line for each."""
    return "\n".join(f"{k}: {', '.join(map(str, v)) if isinstance(v, (list, tuple)) else v}" for k, v in values.items())
