"""Registered queries of readers, grammars by columns, gazetteer answers and sections, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import builds, charts, concordance, grammar, names, sentiment, transcripts
from ..sources import readers
from .corpus_queries import _CONV, TOKENS, _kwic_sql, conversations, documents
from .staging import fresh_dir
from .table_queries import _as_transcripts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _number(key: str, width: int):
    return F.lpad(F.col(key).cast("string"), width, " ")


# -- readers -------------------------------------------------------------------------------------------------------------------------


@query("chat_loader", "SELECT upper(substr(c_mktsegment, 1, 3)) AS speaker, c_name || ' has ' || c_custkey || ' boats' || CASE WHEN c_custkey % 3 = 0 THEN ' and more' ELSE '' END AS text, count(*) AS n FROM customer GROUP BY ALL")
def chat_loader(spark, d):
    """Customers as turns of CHAT files, some over two lines, between lines of metadata; written and read again."""
    path = fresh_dir(spark, "chat")
    said = F.concat(F.lit("*"), F.upper(F.substring("c_mktsegment", 1, 3)), F.when(F.col("c_custkey") % 2 == 0, ":\t").otherwise(": "), "c_name", F.lit(" has "), F.col("c_custkey").cast("string"), F.lit(" boats"))
    turn = F.concat(said, F.when(F.col("c_custkey") % 3 == 0, "\n\tand more").otherwise(""), F.lit("\n%com:\tnone"))
    lines = _t(spark, d, "customer").select(F.explode(F.split(F.concat(F.lit("@Comment:\tx\n"), turn), "\n")).alias("line"))
    plain = {"extension": "cha", "sep": "\x01", "quote": "\x00", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    lines.write.options(**plain).csv(path)
    return readers.chat_lines(spark, path).groupBy("speaker", "text").agg(F.count(F.lit(1)).alias("n"))


@query("transcript_sources", """
WITH f AS (SELECT 'd/t' || (c_custkey // 3) AS base, ['docx', 'txt', 'csv'][c_custkey % 3 + 1] AS ext FROM customer), g AS (SELECT base || '.' || ext AS path, ext, bool_or(ext = 'docx') OVER (PARTITION BY base) AS word FROM f WHERE ext <> 'csv')
SELECT path, CASE WHEN ext = 'txt' AND word THEN 'skipped: ' || substr(path, 3) END AS warning FROM g""")
def transcript_sources(spark, d):
    """Which files of a folder are transcripts: a document before a text of the same name."""
    ext = F.element_at(F.array(*map(F.lit, ("docx", "txt", "csv"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    file = F.concat(F.lit("t"), F.floor(F.col("c_custkey") / 3).cast("string"), F.lit("."), ext)
    taken, passed = readers.transcript_files(_t(spark, d, "customer").select(F.concat(F.lit("d/"), file).alias("path"), file.alias("file_name")))
    return taken.select("path", F.lit(None).cast("string").alias("warning")).unionByName(passed)


@query("cleanable_files", """
WITH f AS (SELECT ['a/', '.git/', 'x/node_modules/', 'x.y/', '_backups/'][s_suppkey % 5 + 1] || s_suppkey || ['.txt', '.MD', '.pdf', '.text', ''][s_suppkey % 7 % 5 + 1] AS path, s_suppkey % 5 AS k, s_suppkey % 7 % 5 AS e FROM supplier)
SELECT path, k IN (0, 3) AND e IN (0, 1, 3) AS cleanable, e IN (0, 1, 2) AS readable FROM f""")
def cleanable_files(spark, d):
    """Files that can be cleaned, and those that can be read for names, among files of many kinds and folders."""
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    key = F.col("s_suppkey")
    path = F.concat(pick(("a/", ".git/", "x/node_modules/", "x.y/", "_backups/"), key % 5), key.cast("string"), pick((".txt", ".MD", ".pdf", ".text", ""), key % 7 % 5))
    files = _t(spark, d, "supplier").select(path.alias("path"))
    some = lambda df, c: df.select("path", F.lit(True).alias(c))
    marked = files.join(some(readers.cleanable(files), "cleanable"), "path", "left").join(some(readers.readable_for_names(files), "readable"), "path", "left")
    return marked.fillna(False, ["cleanable", "readable"])


@query("paragraph_lines", "SELECT s_suppkey AS doc, unnest(['Mr ' || s_name, 'no. ' || s_suppkey, 'last']) AS line, unnest([1, 2, 3]) AS line_no FROM supplier")
def paragraph_lines(spark, d):
    """Plain texts in the shape of a document's paragraphs, read as paragraphs again."""
    text = F.concat(F.lit("Mr "), "s_name", F.lit("\r\nno. "), F.col("s_suppkey").cast("string"), F.lit("\nlast"))
    docs = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("doc"), readers.paragraphs(text).alias("text"))
    return grammar.read_lines(docs).where("trim(line) <> ''").select("doc", F.trim(F.regexp_replace("line", "\n", "")).alias("line"), F.col("line_no").cast("int").alias("line_no"))


# -- grammars by columns -------------------------------------------------------------------------------------------------------------


def _fixed(spark, d):
    """Suppliers as lines of equal width, a document for each nation; the first two are the marked ones."""
    line = F.concat(_number("s_suppkey", 6), F.lit("  "), F.rpad(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")), 5, " "), F.rpad("s_name", 24, " "))
    lines = _t(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("doc"), F.col("s_suppkey").alias("line_no"), line.alias("line"))
    marked = [{"line": r.line, "spans": [{"field": "turn", "start": 6 - len(str(r.line_no)), "end": 6}, {"field": "speaker", "start": 8, "end": 9 + len(r.doc)}, {"field": "text", "start": 13, "end": len(r.line)}]} for r in lines.orderBy("line_no").limit(2).collect()]
    return lines, marked


@query("fixed_width_turns", "SELECT CAST(s_nationkey AS VARCHAR) AS doc, CAST(s_suppkey AS VARCHAR) AS turn_number, '#N' || s_nationkey AS speaker_id, trim(s_name) AS text FROM supplier")
def fixed_width_turns(spark, d):
    """Turns of fixed-width lines, by columns from two marked lines."""
    lines, marked = _fixed(spark, d)
    g = grammar.build("fixed", [], marked, fixed_width=True, has_header=False)
    return grammar.rows(grammar.parse(lines, g)).select("doc", "turn_number", "speaker_id", "text")


@query("fixed_width_documents", "SELECT CAST(s_nationkey AS VARCHAR) AS doc, count(*) >= 3 AS fixed FROM supplier GROUP BY s_nationkey")
def fixed_width_documents(spark, d):
    """Which documents look like lines of fixed width: those of three lines or more, as all are equally long."""
    return grammar.looks_fixed_width(_fixed(spark, d)[0])


@query("dropped_columns", "SELECT s_suppkey, s_name || chr(9) || s_suppkey AS tabs, substr(s_name, 1, 2) || substr(s_name, 6) AS cut FROM supplier")
def dropped_columns(spark, d):
    """Lines without their second tab-separated column, and without three characters."""
    line = F.concat_ws("\t", "s_name", F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string"))
    return _t(spark, d, "supplier").select("s_suppkey", grammar.drop_columns(line, [{"tab": 2}]).alias("tabs"), grammar.drop_columns(F.col("s_name"), [{"from": 2, "to": 5}]).alias("cut"))


# -- names, sections, search, plots, builds ------------------------------------------------------------------------------------------


@query("gazetteer_records", """
SELECT n_name AS name, CAST(n_nationkey + 0.5 AS DOUBLE) AS latitude, CAST(n_regionkey + 100.25 AS DOUBLE) AS longitude, CASE n_nationkey % 3 WHEN 2 THEN 'A' ELSE 'S' END || n_regionkey AS region, 'town' AS kind, 'p' AS provider, 2 AS provider_order FROM nation""")
def gazetteer_records(spark, d):
    """Records from gazetteer answers of three shapes: GeoJSON features, lists under results and under items."""
    n = _t(spark, d, "nation")
    where = [(F.col("n_nationkey") + 0.5).alias("latitude"), (F.col("n_regionkey") + 100.25).alias("longitude")]
    region = lambda x: F.concat(F.lit(x), F.col("n_regionkey").cast("string"))
    feature = F.struct(F.struct(F.col("n_name").alias("name"), region("S").alias("state"), F.lit("town").alias("category")).alias("properties"), F.struct(F.array(F.col("n_regionkey") + 100.25, F.col("n_nationkey") + 0.5).alias("coordinates")).alias("geometry"))
    result = F.struct(F.col("n_name").alias("placename"), *where, region("S").alias("state"), F.lit("town").alias("feature"))
    item = F.struct(F.col("n_name").alias("title"), *where, region("A").alias("authority"), F.lit("town").alias("category"))
    shape = F.when(F.col("n_nationkey") % 3 == 0, F.to_json(F.struct(F.array(feature).alias("features")))).when(F.col("n_nationkey") % 3 == 1, F.to_json(F.struct(F.array(result).alias("results")))).otherwise(F.to_json(F.struct(F.array(item).alias("items"))))
    return names.flatten_records(n.select(shape.alias("json")), "p", 2).drop("record_no")


@query("renamed_sections", f"""
WITH s AS (SELECT CASE WHEN trim(coalesce(source, '')) = '' THEN 'untitled' WHEN source = (SELECT min(source) FROM documents) THEN 'merged' WHEN source = (SELECT max(source) FROM documents) THEN 'merged' ELSE source END AS section, source, doc_id, {TOKENS} AS t FROM documents),
b AS (SELECT section, t, CAST(coalesce(sum(len(t)) OVER (PARTITION BY section ORDER BY source, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS k FROM s)
SELECT section, k + unnest(generate_series(1, len(t))) AS token_index, unnest(t) AS token FROM b""")
def renamed_sections(spark, d):
    """Tokens with their places in sections, of which two are given one name."""
    docs = documents(spark, d)
    first, last = docs.agg(F.min("source"), F.max("source")).first()
    return sentiment.section_tokens(docs, renamed={first: "merged", last: "merged"} if first is not None else None)


@query("kwic_sorted", f"SELECT * FROM ({_kwic_sql('(?i)tion', _CONV)}) ORDER BY source, line_no, match_no LIMIT 250")
def kwic_sorted(spark, d):
    """The first 250 matches in the order of documents."""
    return concordance.sort_rows(concordance.search(conversations(spark, d), "tion")).limit(250)


@query("bound_datasets", "SELECT 'Clients' AS dataset, c_custkey AS id, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS name FROM customer UNION ALL SELECT 'Makers', s_suppkey, s_name FROM supplier UNION ALL SELECT 'Lost', NULL, 'lost.csv'")
def bound_datasets(spark, d):
    """Datasets of a plots configuration bound to tables, blank cells as nulls; and the one that is missing."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_name")).otherwise("  ").alias("name"))
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    config = {"plots": {"datasets": {"Clients": {"source": "c.csv"}, "Makers": "s.csv", "Lost": {"path": "lost.csv"}}, "plotList": []}}
    found, missing = charts.bind_datasets(config, {"c.csv": c, "s.csv": s})
    out = spark.createDataFrame([(n, None, source) for n, source in missing], f"dataset string, id {c.schema['id'].dataType.simpleString()}, name string")
    for name, rows in found.items():
        out = out.unionByName(rows.select(F.lit(name).alias("dataset"), "id", "name"))
    return out


@query("transcript_objects", """
WITH c AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS doc FROM conversations), p(id, name, about) AS (VALUES ('#una', 'Una', 'guest'), ('#abe', 'Abe', NULL), ('#SYSTEM', 'Sys', NULL))
SELECT '#' || doc AS id, 'hasPart' AS key, 0 AS ord, doc AS said FROM c UNION ALL SELECT '#' || doc, 'hasPart', 1, '_outputs/csv/' || doc || '.csv' FROM c UNION ALL SELECT '#' || doc, 'name', 0, doc FROM c
UNION ALL SELECT '#' || doc || '-annotation', 'annotationBody', 0, '_outputs/csv/' || doc || '.csv' FROM c UNION ALL SELECT '#' || doc || '-annotation', 'annotationOf', 0, '#' || doc FROM c
UNION ALL SELECT '_outputs/csv/' || doc || '.csv', 'isPartOf', 0, '#' || doc FROM c UNION ALL SELECT '_outputs/csv/' || doc || '.csv', 'annotationOf', 0, doc FROM c
UNION ALL SELECT '#' || doc, 'speaker', o, who FROM c, (VALUES (0, '#una'), (1, '#abe'), (2, '#SYSTEM')) s(o, who) UNION ALL SELECT id, 'description', 0, about FROM p WHERE about IS NOT NULL""")
def transcript_objects(spark, d):
    """What a build says of its transcripts: objects, their files and annotations, speakers."""
    _, prop = builds.transcript_graph(transcripts.parse(_as_transcripts(spark, d)))
    wanted = F.col("key").isin("hasPart", "annotationBody", "annotationOf", "isPartOf", "speaker", "description") | ((F.col("key") == "name") & F.col("id").startswith("#") & ~F.col("id").isin("#una", "#abe", "#SYSTEM"))
    return prop.where(wanted).select("id", "key", "ord", F.coalesce("value", "ref").alias("said"))


@query("transcript_logs", "SELECT CAST(conv_id AS VARCHAR) AS doc, count(*) || ' rows, ' || count(DISTINCT role) || ' speakers' AS head FROM conversations GROUP BY conv_id")
def transcript_logs(spark, d):
    """The first line of each transcript's report."""
    return transcripts.log_text(transcripts.parse(_as_transcripts(spark, d))).select("doc", F.substring_index("text", "\n", 1).alias("head"))
