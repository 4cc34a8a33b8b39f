"""Metadata of a build: transcripts and their CSV and CHAT files, workbooks that are crates, links of preview pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug, trim
from .transcripts import person_entities

def _none():
    return F.lit(None).cast("string")


def _value(df: DataFrame, key: str, value, ord_=0) -> DataFrame:
    return df.select("id", F.lit(key).alias("key"), F.lit(ord_).cast("int").alias("ord"), value.cast("string").alias("value"), _none().alias("ref"))


def _link(df: DataFrame, key: str, ref, order=None) -> DataFrame:
    return df.select("id", F.lit(key).alias("key"), (order if order is not None else F.lit(0)).cast("int").alias("ord"), _none().alias("value"), ref.alias("ref"))


def transcript_graph(parsed: dict[str, DataFrame], folder: str = "_outputs/csv") -> tuple[DataFrame, DataFrame]:
    """entity and prop: an object for each transcript with its source file and CSV, and its speakers as people with their details."""
    docs = parsed["rows"].select("doc").distinct()
    base = F.regexp_replace("doc", r"\.[^.]*\z", "")
    objects = docs.select(F.concat(F.lit("#"), slug(base)).alias("id"), "doc", F.concat(F.lit(f"{folder}/"), base, F.lit(".csv")).alias("csv"))
    people = person_entities(parsed["speakers"])
    note = F.concat("id", F.lit("-annotation"))
    kind = lambda df, c, *t: df.select(c.alias("id"), F.array(*map(F.lit, t)).alias("types"))
    entity = kind(objects, F.col("id"), "RepositoryObject").unionByName(kind(objects, F.col("doc"), "File")).unionByName(kind(objects, F.col("csv"), "File")).unionByName(kind(objects, note, "Annotation")).unionByName(kind(people, F.col("id"), "Person"))
    who = parsed["speakers"].select("doc", F.when(F.col("resolved").startswith("#"), F.col("resolved")).otherwise(F.concat(F.lit("#"), "resolved")).alias("person"), "order").dropDuplicates(["doc", "person"])
    speaks = objects.join(who, "doc").withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("order")) - 1)
    prop = _value(objects, "name", F.col("doc")).unionByName(_link(objects, "hasPart", F.col("doc"))).unionByName(_link(objects, "hasPart", F.col("csv"), F.lit(1)))
    source, table = objects.select(F.col("doc").alias("id")), objects.select(F.col("csv").alias("id"), "doc", F.col("id").alias("object"))
    media = F.when(F.lower("id").endswith(".docx"), "application/vnd.openxmlformats-officedocument.wordprocessingml.document").otherwise("text/plain")
    prop = prop.unionByName(_value(source, "name", F.col("id"))).unionByName(_value(source, "encodingFormat", media)).unionByName(_value(table, "encodingFormat", F.lit("text/csv")))
    prop = prop.unionByName(_value(table, "name", F.regexp_extract("id", r"([^/]*)\z", 1))).unionByName(_link(table, "annotationOf", F.col("doc"))).unionByName(_link(table, "isPartOf", F.col("object")))
    notes = objects.select(note.alias("id"), F.col("id").alias("object"), "csv")
    prop = prop.unionByName(_link(notes, "annotationOf", F.col("object"))).unionByName(_link(notes, "annotationBody", F.col("csv")))
    prop = prop.unionByName(_link(speaks, "speaker", F.col("person"), F.col("n"))).unionByName(_value(people, "name", F.col("name")))
    some = lambda c: people.where(F.coalesce(c, F.lit("")) != "")
    prop = prop.unionByName(_value(some("alternate_name"), "alternateName", F.col("alternate_name"))).unionByName(_value(some("description"), "description", F.col("description")))
    return entity.dropDuplicates(["id"]), prop


def custom_values(people: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A PropertyValue for each custom field of a person. fields: id (person), label, value."""
    known = fields.join(people.select("id"), "id", "left_semi").where(F.coalesce("value", F.lit("")) != "")
    tail = F.regexp_replace(F.regexp_replace(F.lower(trim("label")), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+\z", "")
    made = known.withColumn("pv", F.concat("id", F.lit("-"), F.when(tail == "", "property").otherwise(tail)))
    own = made.select(F.col("pv").alias("id"), "label", "value")
    prop = _link(made, "additionalProperty", F.col("pv"), F.row_number().over(Window.partitionBy("id").orderBy("label")) - 1)
    return own.select("id", F.array(F.lit("PropertyValue")).alias("types")).dropDuplicates(["id"]), prop.unionByName(_value(own, "name", F.col("label"))).unionByName(_value(own, "value", F.col("value")))


def add_chat_files(entity: DataFrame, prop: DataFrame, docs: DataFrame, folder: str = "_outputs/chat") -> tuple[DataFrame, DataFrame]:
    """docs: doc. A File for each CHAT file, joined to its object's parts where the object exists and doesn't have it."""
    base = F.regexp_replace("doc", r"\.[^.]*\z", "")
    files = docs.select(F.concat(F.lit("#"), slug(base)).alias("id"), F.concat(F.lit(f"{folder}/"), base, F.lit(".cha")).alias("file"))
    mine = files.join(entity.select("id"), "id", "left_semi")
    new = mine.join(prop.where("key = 'hasPart'").select("id", F.col("ref").alias("file")), ["id", "file"], "left_anti")
    last = prop.where("key = 'hasPart'").groupBy("id").agg((F.max("ord") + 1).alias("next"))
    rows = _link(new.join(last, "id", "left"), "hasPart", F.col("file"), F.coalesce("next", F.lit(0)))
    e = files.select(F.col("file").alias("id"), F.array(F.lit("File")).alias("types")).join(entity.select("id"), "id", "left_anti")
    return entity.unionByName(e), prop.unionByName(rows)


def workbook_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entity and prop of a workbook that is a crate: rows (sheet, row_no, cells), the first row of a sheet names properties, `@id` and `@type` among
    them; a cell that is quoted in brackets, or a JSON list, or an id of the workbook, is a reference."""
    heads = rows.groupBy("sheet").agg(F.min_by("cells", "row_no").alias("head"), F.min("row_no").alias("first"))
    cells = rows.join(heads, "sheet").where(F.col("row_no") > F.col("first")).select("sheet", "row_no", F.map_from_entries(F.filter(F.arrays_zip(F.transform("head", trim), "cells"), lambda x: x["0"].isNotNull() & (x["0"] != "") & x["cells"].isNotNull())).alias("m"))
    cells = cells.where("m['@id'] is not null and m['@id'] <> ''").select(F.col("m")["@id"].alias("id"), F.coalesce(F.nullif(F.col("m")["@type"], F.lit("")), F.col("sheet")).alias("type"), "m", "row_no")
    entity = cells.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(F.split("type", r"\s*,\s*")))).alias("types"))
    pairs = cells.select("id", F.explode("m").alias("key", "cell")).where(~F.col("key").isin("@id", "@type") & (trim("cell") != ""))
    listed = F.when(F.col("cell").startswith("["), F.coalesce(F.from_json("cell", "array<string>"), F.array("cell"))).otherwise(F.array("cell"))
    one = pairs.select("id", F.regexp_replace("key", r"^\.", "").alias("key"), F.posexplode(listed).alias("ord", "v"))
    known = entity.select(F.col("id").alias("v"), F.lit(True).alias("known"))
    named = one.withColumn("v", F.regexp_replace("v", r'^"(.*)"\z', "$1")).join(known, "v", "left")
    is_ref = F.coalesce("known", F.lit(False))
    return entity, named.select("id", "key", "ord", F.when(~is_ref, F.col("v")).alias("value"), F.when(is_ref, F.col("v")).alias("ref"))


# -- links of preview pages ----------------------------------------------------------------------------------------------------------

ATTRIBUTE = re.compile(r"""(\b(?:href|src)\s*=\s*)(["'])(.*?)\2|(url\(\s*)(["']?)(.*?)\5(\s*\))""", re.S)


def rewrite(html: str, targets: dict[str, str]) -> str:
    """Links to copied files point at their copies. A link counts up to its longest known base before `#` or `?`; entities and percent signs are
    decoded to compare, and the rest of the link stays."""

    def moved(link: str) -> str | None:
        plain = unescape(link)
        for at in sorted({len(plain), *(m.start() for m in re.finditer("[#?]", plain))}, reverse=True):
            base = plain[:at]
            for known in (base, unquote(base), base.removeprefix("./"), unquote(base).removeprefix("./")):
                if known in targets:
                    return quote(targets[known], safe="/:._-~") + plain[at:]
        return None

    def change(m: re.Match) -> str:
        attribute = m[1] is not None
        new = moved(m[3] if attribute else m[6])
        if new is None:
            return m[0]
        return f"{m[1]}{m[2]}{new}{m[2]}" if attribute else f"{m[4]}{m[5]}{new}{m[5]}{m[7]}"

    return ATTRIBUTE.sub(change, html)


def rewrite_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """pages: path, html; links: path (of a page), source, target. Each page meets its own links only."""
    own = links.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("source", "target"))).alias("targets"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part["html"] = [rewrite(h or "", dict(t) if t is not None else {}) for h, t in zip(part["html"], part["targets"])]
            yield part[["path", "html"]]

    return pages.join(own, "path", "left").select("path", "html", "targets").mapInPandas(run, "path string, html string")
