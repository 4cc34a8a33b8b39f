"""Structured documents: blocks (path, order, tag, text) of office files as chapters, parts and media in a metadata graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug, trim
from ..plans.staging import running

#: fixed values: marks of media in running text
MEDIA = r"\[(sound|image|video):\s*([^\]]+)\]"
CREDIT = r"(?i)^\s*(photo|image|picture)\s*(credit)?\s*:\s*(.+)$"


def preflight(blocks: DataFrame) -> DataFrame:
    """path, n_blocks, n_headings, styles, n_errors before a build."""
    return blocks.groupBy("path").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if(F.col("tag").rlike("^h[1-6]$")).alias("n_headings"), F.sort_array(F.collect_set("tag")).alias("styles"), F.count_if(F.col("tag") == "error").alias("n_errors"))


def chapters(blocks: DataFrame, level: int = 1) -> DataFrame:
    """Adds chapter_no (0 before the first heading) and chapter: blocks belong to the last heading of a level up to `level`."""
    w = Window.partitionBy("path").orderBy("order")
    heads = F.col("tag").isin([f"h{k}" for k in range(1, level + 1)])
    return blocks.withColumn("chapter_no", F.sum(heads.cast("int")).over(w)).withColumn("chapter", F.coalesce(F.last(F.when(heads, trim("text")), True).over(w), F.lit("")))


def under_heading(blocks: DataFrame) -> DataFrame:
    """Adds h2: the last second-level heading, under which third-level headings and tables stand."""
    w = Window.partitionBy("path").orderBy("order")
    return blocks.withColumn("h2", F.last(F.when(F.col("tag") == "h2", trim("text")), True).over(w))


def media(blocks: DataFrame) -> DataFrame:
    """path, order, kind, target of the media that blocks name; a target counts once for each document."""
    found = blocks.withColumn("m", F.explode(F.regexp_extract_all("text", F.lit(MEDIA), F.lit(0))))
    one = found.select("path", "order", F.regexp_extract("m", MEDIA, 1).alias("kind"), trim(F.regexp_extract("m", MEDIA, 2)).alias("target"))
    return one.groupBy("path", "target").agg(F.min("order").alias("order"), F.min("kind").alias("kind")).select("path", "order", "kind", "target")


def missing_media(found: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """Targets to be written: all, or those that don't exist (existing: target)."""
    return found.select("target").distinct() if overwrite else found.select("target").distinct().join(existing, "target", "left_anti")


def credits(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("text").rlike(CREDIT)).select("path", "order", trim(F.regexp_extract("text", CREDIT, 3)).alias("credit"))


def assemble(blocks: DataFrame, collection: str) -> tuple[DataFrame, DataFrame]:
    """entity and prop: a collection of the documents, an object for each, a part for each chapter with its text, and the source files."""
    c = chapters(blocks)
    doc = F.concat(F.lit("#"), slug(F.regexp_extract("path", r"([^/]*)\z", 1)))
    parts = c.groupBy("path", "chapter_no").agg(
        F.max("chapter").alias("name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "text"))), lambda x: x["text"]), "\n").alias("text")
    ).withColumn("doc", doc).withColumn("id", F.concat("doc", F.lit("-"), F.col("chapter_no").cast("string")))
    root = f"#{collection}"
    none = F.lit(None).cast("string")
    docs = parts.select("path", "doc").distinct()
    kind = lambda df, c, *t: df.select(F.col(c).alias("id"), F.array(*map(F.lit, t)).alias("types"))
    one = docs.sparkSession.createDataFrame([(root,)], "id string")
    entity = kind(one, "id", "RepositoryCollection").unionByName(kind(docs, "doc", "RepositoryObject")).unionByName(kind(parts, "id", "DocumentPart")).unionByName(kind(docs, "path", "File"))
    value = lambda df, c, k, v: df.select(F.col(c).alias("id"), F.lit(k).alias("key"), F.lit(0).alias("ord"), v.alias("value"), none.alias("ref"))
    ref = lambda df, c, k, r, o: df.select(c.alias("id"), F.lit(k).alias("key"), o.cast("int").alias("ord"), none.alias("value"), r.alias("ref"))
    numbered = running(docs.withColumn("one", F.lit(1)), [], ["path"], "one")
    prop = value(parts, "id", "name", F.col("name")).unionByName(value(parts, "id", "text", F.col("text")))
    prop = prop.unionByName(ref(parts, F.col("doc"), "hasPart", F.col("id"), F.col("chapter_no"))).unionByName(ref(docs, F.col("doc"), "source", F.col("path"), F.lit(0)))
    return entity, prop.unionByName(ref(numbered, F.lit(root), "pcdm:hasMember", F.col("doc"), F.col("seq")))


#: Types of the entities of a folder crate: fixed values
DERIVED, SOURCES, GROUP, PART, CHAPTER, ROW = "custom:DerivedContentCollection", "custom:SourceDocumentsCollection", "custom:SourceDocumentGroup", "bibo:DocumentPart", "bibo:Chapter", "custom:TableRow"


def outline(blocks: DataFrame) -> DataFrame:
    """path, chapter_no, level, heading, text, n_rows, position, parent_no: the chapters under the first three heading levels. The first-level ones have no
    position: the first of them introduces the document. A third-level chapter with a table belongs to the last second-level one (parent_no)."""
    w = Window.partitionBy("path").orderBy("order")
    head = F.col("tag").isin("h1", "h2", "h3")
    b = blocks.where("tag <> 'error'").withColumn("chapter_no", F.sum(head.cast("int")).over(w)).where("chapter_no > 0")
    said = F.array_sort(F.collect_list(F.when(~F.col("tag").isin("h1", "h2", "h3", "tr"), F.struct("order", trim("text").alias("t")))))
    c = b.groupBy("path", "chapter_no").agg(
        F.max(F.when(head, F.substring("tag", 2, 1).cast("int"))).alias("level"), F.max(F.when(head, trim("text"))).alias("heading"),
        F.array_join(F.filter(F.transform(said, lambda x: x["t"]), lambda x: x != ""), "\n\n").alias("text"), F.count_if(F.col("tag") == "tr").alias("n_rows"),
    )
    by = Window.partitionBy("path").orderBy("chapter_no")
    c = c.withColumn("position", F.when(F.col("level") > 1, F.sum((F.col("level") > 1).cast("int")).over(by)))
    above = F.last(F.when(F.col("level") == 2, F.col("chapter_no")), True).over(by)
    return c.withColumn("parent_no", F.when((F.col("level") == 3) & (F.col("n_rows") > 0), above))


def folder_crate(blocks: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """entity and prop of folders of documents (path: topic folder/.../name.docx): for each topic a collection of its documents and a group of its source files;
    for each document its chapters, for each chapter its table rows, the chapters below it and the media that it names and that lie in `media`
    beside the document (files: path)."""
    named = blocks.where(~F.lower("path").rlike(r"notes[^/]*\.docx$"))
    part_id = F.concat(F.lit("#"), slug(F.regexp_replace("path", "/", "-")))
    folder, none = F.substring_index("path", "/", 1), F.lit(None).cast("string")
    of = lambda no: F.concat(part_id, F.lit("-chapter-"), no.cast("string"))
    c = outline(named).withColumn("part", part_id)
    numbers = c.select("path", F.col("chapter_no").alias("parent_no"), F.col("position").alias("parent_position"))
    c = c.join(numbers, ["path", "parent_no"], "left").withColumn("id", F.when(F.col("position").isNotNull(), of(F.col("position"))).otherwise(F.concat("part", F.lit("-intro"))))
    docs = named.select("path").distinct().withColumns({"part": part_id, "folder": folder})
    intro = c.where("level = 1").groupBy("path").agg(F.min_by(F.struct("heading", "text"), "chapter_no").alias("i"))
    chapters_ = c.where("position is not null")

    w = Window.partitionBy("path").orderBy("order")
    placed = named.withColumn("chapter_no", F.sum(F.col("tag").isin("h1", "h2", "h3").cast("int")).over(w))
    rows = placed.where("tag = 'tr'").withColumn("k", F.row_number().over(Window.partitionBy("path", "chapter_no").orderBy("order"))).join(chapters_.select("path", "chapter_no", "id"), ["path", "chapter_no"])
    rows = rows.select(F.concat("id", F.lit("-row-"), F.col("k").cast("string")).alias("row"), "id", "k", trim("text").alias("text"))
    shown = media(placed).join(placed.select("path", "order", "chapter_no"), ["path", "order"]).join(c.select("path", "chapter_no", "id", "position", "part", "n_rows"), ["path", "chapter_no"])
    shown = shown.withColumn("file", F.concat(F.regexp_replace("path", "[^/]*$", ""), F.lit("media/"), "target"))
    if files is not None:
        shown = shown.join(files.select(F.col("path").alias("file")), "file", "left_semi")

    value = lambda df, i, key, v: df.select(F.col(i).alias("id"), F.lit(key).alias("key"), F.lit(0).alias("ord"), v.cast("string").alias("value"), none.alias("ref"))
    link = lambda df, i, ref, o: df.select(i.alias("id"), F.lit("hasPart").alias("key"), o.cast("int").alias("ord"), none.alias("value"), ref.alias("ref"))
    nth = lambda by, o: F.row_number().over(Window.partitionBy(by).orderBy(o)) - 1
    topics = docs.select("folder").distinct().withColumns({"id": F.concat(F.lit("#"), slug("folder")), "group": F.concat(F.lit("#sourceDocuments-"), slug("folder"))})
    topics = running(topics.withColumn("one", F.lit(1)), [], ["folder"], "one")
    mine = docs.join(topics.select("folder", "id", "group"), "folder").withColumn("k", nth("folder", "path"))
    body = chapters_.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("position", F.concat_ws("\n\n", "heading", F.nullif("text", F.lit(""))).alias("t")))).alias("all"))
    whole = docs.join(intro, "path", "left").join(body, "path", "left").withColumn("parts", F.concat(F.array(F.coalesce("i.text", F.lit(""))), F.coalesce(F.transform("all", lambda x: x["t"]), F.array().cast("array<string>"))))
    fallback = F.regexp_replace(F.regexp_extract("path", r"([^/]*)\z", 1), r"(?i)\.docx\z", "")
    top = chapters_.where("parent_no is null")
    below = chapters_.where("parent_no is not null").withColumn("above", of(F.col("parent_position")))
    two = docs.sparkSession.createDataFrame([("#derivedContent", "Derived Content", 0), ("#sourceDocuments", "Source Documents", 1)], "id string, name string, k int")

    parts = [
        value(chapters_, "id", "name", F.col("heading")), value(chapters_, "id", "text", F.col("text")), value(chapters_, "id", "position", F.col("position")),
        value(rows, "row", "text", F.col("text")), value(rows, "row", "position", F.col("k")), link(rows, F.col("id"), F.col("row"), F.col("k") - 1),
        link(top, F.col("part"), F.col("id"), F.col("position")), link(below, F.col("above"), F.col("id"), 1_000_000 + F.col("position")),
        link(shown, F.when(F.col("position").isNotNull(), F.col("id")).otherwise(F.col("part")), F.col("file"), 500_000 + F.col("order")),
        value(whole, "part", "name", F.coalesce("i.heading", fallback)), value(whole, "part", "text", F.array_join(F.filter("parts", lambda x: x != ""), "\n\n---\n\n")),
        link(mine, F.col("id"), F.col("part"), F.col("k")), link(mine, F.col("group"), F.col("path"), F.col("k")), value(topics, "id", "name", F.col("folder")), value(topics, "group", "name", F.col("folder")),
        link(topics, F.lit("#derivedContent"), F.col("id"), F.col("seq")), link(topics, F.lit("#sourceDocuments"), F.col("group"), F.col("seq")),
        value(two, "id", "name", F.col("name")), link(two, F.lit("./"), F.col("id"), F.col("k")),
    ]
    kind = lambda df, i, t: df.select(F.col(i).alias("id"), F.array(F.lit(t)).alias("types"))
    entities = [kind(chapters_, "id", CHAPTER), kind(rows, "row", ROW), kind(docs, "part", PART), kind(docs, "path", "File"), kind(shown.select("file").distinct(), "file", "File"), kind(topics, "id", "RepositoryCollection"),
                kind(topics, "group", GROUP), kind(two.where("k = 0"), "id", DERIVED), kind(two.where("k = 1"), "id", SOURCES)]
    return reduce(DataFrame.unionByName, entities), reduce(DataFrame.unionByName, parts)


def build_defaults(options: dict) -> dict:
    """Settings of a build with their defaults."""
    return {"name": "Collection", "description": "", "license": "", "creators": [], "overwrite": False, "outputs_in_crate": False, **{k: v for k, v in options.items() if v not in (None, "")}}


def creators(options: dict) -> list[tuple[str, str]]:
    """(id, name) of the creators, from names or `name <id>`."""
    import re

    out = []
    for c in options.get("creators", []):
        m = re.match(r"^(.*?)\s*<([^>]+)>\s*$", c)
        out.append((m[2], m[1]) if m else ("#" + re.sub(r"[^a-z0-9]+", "_", c.strip().lower()).strip("_"), c.strip()))
    return out
