"""Registered queries over structured documents, transcripts and places, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import builds, documents, names, transcripts
from .table_queries import _LINE, _as_transcripts

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


def _s(name: str):
    return F.col(name).cast("string")


# -- structured documents: orders as blocks --------------------------------------------------------------------------------------------

_BLOCKS = """SELECT 'd/Doc ' || (o_custkey % 50) || '.docx' AS path, CAST(o_orderkey AS INTEGER) AS "order",
  CASE o_orderkey % 11 WHEN 0 THEN 'h1' WHEN 1 THEN 'h2' WHEN 2 THEN 'tr' WHEN 3 THEN 'h3' ELSE 'p' END AS tag,
  CASE o_orderkey % 5 WHEN 0 THEN 'see [sound: a' || (o_orderkey % 9) || '.wav ] and [image:b.png] ' WHEN 1 THEN ' Photo Credit :  P' || o_custkey ELSE ' T' || o_orderkey END AS text FROM orders"""


def _blocks(spark, d):
    k = F.col("o_orderkey")
    tag = F.when(k % 11 == 0, "h1").when(k % 11 == 1, "h2").when(k % 11 == 2, "tr").when(k % 11 == 3, "h3").otherwise("p")
    said = F.when(k % 5 == 0, F.concat(F.lit("see [sound: a"), (k % 9).cast("string"), F.lit(".wav ] and [image:b.png] "))).when(k % 5 == 1, F.concat(F.lit(" Photo Credit :  P"), _s("o_custkey"))).otherwise(F.concat(F.lit(" T"), _s("o_orderkey")))
    return _t(spark, d, "orders").select(F.concat(F.lit("d/Doc "), (F.col("o_custkey") % 50).cast("string"), F.lit(".docx")).alias("path"), k.cast("int").alias("order"), tag.alias("tag"), said.alias("text"))


@query("document_preflight", f"""SELECT path, count(*) AS n_blocks, count(*) FILTER (tag IN ('h1', 'h2', 'h3')) AS n_headings, array_to_string(list_sort(list(DISTINCT tag)), ',') AS styles, CAST(0 AS BIGINT) AS n_errors FROM ({_BLOCKS}) GROUP BY path""")
def document_preflight(spark, d):
    return documents.preflight(_blocks(spark, d)).withColumn("styles", F.array_join("styles", ","))


_CHAPTERS = f"""SELECT *, count(*) FILTER (tag = 'h1') OVER w AS chapter_no, coalesce(last_value(CASE WHEN tag = 'h1' THEN trim(text) END IGNORE NULLS) OVER w, '') AS chapter
FROM ({_BLOCKS}) WINDOW w AS (PARTITION BY path ORDER BY "order")"""


@query("document_chapters", f'SELECT path, "order", chapter_no, chapter FROM ({_CHAPTERS})')
def document_chapters(spark, d):
    return documents.chapters(_blocks(spark, d)).select("path", "order", "chapter_no", "chapter")


@query("document_headings", f"""SELECT path, "order", last_value(CASE WHEN tag = 'h2' THEN trim(text) END IGNORE NULLS) OVER (PARTITION BY path ORDER BY "order") AS h2 FROM ({_BLOCKS})""")
def document_headings(spark, d):
    return documents.under_heading(_blocks(spark, d)).select("path", "order", "h2")


_MEDIA = f"""SELECT path, min("order") AS "order", kind, target FROM (SELECT path, "order", unnest(['sound', 'image']) AS kind, unnest(['a' || ("order" % 9) || '.wav', 'b.png']) AS target FROM ({_BLOCKS}) WHERE "order" % 5 = 0) GROUP BY ALL"""


@query("document_media", _MEDIA)
def document_media(spark, d):
    return documents.media(_blocks(spark, d))


@query("missing_media", f"SELECT DISTINCT target FROM ({_MEDIA}) WHERE target NOT IN ('a1.wav', 'b.png')")
def missing_media(spark, d):
    there = spark.createDataFrame([("a1.wav",), ("b.png",)], "target string")
    return documents.missing_media(documents.media(_blocks(spark, d)), there)


@query("document_credits", """SELECT 'd/Doc ' || (o_custkey % 50) || '.docx' AS path, CAST(o_orderkey AS INTEGER) AS "order", 'P' || o_custkey AS credit FROM orders WHERE o_orderkey % 5 = 1""")
def document_credits(spark, d):
    return documents.credits(_blocks(spark, d))


@query("document_crate", f"""
WITH c AS ({_CHAPTERS}), p AS (SELECT path, chapter_no, max(chapter) AS name, string_agg(text, chr(10) ORDER BY "order") AS text FROM c GROUP BY ALL),
d AS (SELECT *, '#' || replace(regexp_replace(lower(regexp_extract(path, '([^/]*)$', 1)), '[^a-z0-9]+', '-', 'g'), '--', '-') AS doc FROM p)
SELECT doc || '-' || chapter_no AS id, 'name' AS key, 0 AS ord, name AS value, NULL AS ref FROM d UNION ALL SELECT doc || '-' || chapter_no, 'text', 0, text, NULL FROM d
UNION ALL SELECT doc, 'hasPart', CAST(chapter_no AS INTEGER), NULL, doc || '-' || chapter_no FROM d
UNION ALL SELECT DISTINCT doc, 'source', 0, NULL, path FROM d
UNION ALL SELECT '#texts', 'pcdm:hasMember', CAST(row_number() OVER (ORDER BY path) - 1 AS INTEGER), NULL, doc FROM (SELECT DISTINCT path, doc FROM d)""")
def document_crate(spark, d):
    return documents.assemble(_blocks(spark, d), "texts")[1].select("id", "key", "ord", "value", "ref")


# -- builds ----------------------------------------------------------------------------------------------------------------------------


@query("chat_files", """
SELECT '#c' || s_suppkey || '-txt' AS id, '_outputs/chat/C' || s_suppkey || '.cha' AS ref, CASE WHEN s_suppkey % 3 = 0 THEN 0 WHEN s_suppkey % 3 = 1 THEN 5 ELSE 2 END AS ord FROM supplier WHERE s_suppkey % 7 > 0""".replace("|| '-txt' AS id", "AS id"))
def chat_files(spark, d):
    """A CHAT file joins the parts of its object, after those there are, if it isn't among them and the object exists."""
    s, k = _t(spark, d, "supplier"), F.col("s_suppkey")
    name, none = F.concat(F.lit("#c"), _s("s_suppkey")), F.lit(None).cast("string")
    entity = s.where(k % 7 > 0).select(name.alias("id"), F.array(F.lit("RepositoryObject")).alias("types"))
    file = F.concat(F.lit("_outputs/chat/C"), _s("s_suppkey"), F.lit(".cha"))
    part = lambda rows, ord_, ref: rows.select(name.alias("id"), F.lit("hasPart").alias("key"), F.lit(ord_).alias("ord"), none.alias("value"), ref.alias("ref"))
    prop = part(s.where(k % 3 == 1), 4, F.lit("x.txt")).unionByName(part(s.where(k % 3 == 2), 2, file))
    docs = s.select(F.concat(F.lit("C"), _s("s_suppkey"), F.lit(".txt")).alias("doc"))
    out = builds.add_chat_files(entity, prop, docs)[1]
    return out.where("ref like '%.cha'").join(entity.select("id"), "id", "left_semi").select("id", "ref", "ord")


@query("custom_values", """
SELECT '#p' || c_custkey AS id, 'additionalProperty' AS key, '#p' || c_custkey || '-' || x AS ref, NULL AS value FROM customer, (VALUES ('home-town'), ('property')) v(x) WHERE c_custkey % 3 > 0 AND (x = 'home-town' OR c_custkey % 2 = 0)
UNION ALL SELECT '#p' || c_custkey || '-' || x, 'name', NULL, l FROM customer, (VALUES ('home-town', ' Home  Town'), ('property', '!')) v(x, l) WHERE c_custkey % 3 > 0 AND (x = 'home-town' OR c_custkey % 2 = 0)
UNION ALL SELECT '#p' || c_custkey || '-' || x, 'value', NULL, c_name FROM customer, (VALUES ('home-town'), ('property')) v(x) WHERE c_custkey % 3 > 0 AND (x = 'home-town' OR c_custkey % 2 = 0)""")
def custom_values(spark, d):
    """Fields of people that are known and filled become values of their own."""
    c, k = _t(spark, d, "customer"), F.col("c_custkey")
    who = F.concat(F.lit("#p"), _s("c_custkey"))
    fields = c.select(who.alias("id"), F.lit(" Home  Town").alias("label"), F.col("c_name").alias("value")).unionByName(c.select(who.alias("id"), F.lit("!").alias("label"), F.when(k % 2 == 0, F.col("c_name")).otherwise("").alias("value")))
    return builds.custom_values(c.where(k % 3 > 0).select(who.alias("id")), fields)[1].select("id", "key", "ref", "value")


@query("workbook_graph", """
SELECT '#n' || n_nationkey AS id, 'name' AS key, 0 AS ord, n_name AS value, NULL AS ref FROM nation
UNION ALL SELECT '#n' || n_nationkey, 'region', 0, NULL, '#r' || n_regionkey FROM nation
UNION ALL SELECT '#n' || n_nationkey, 'near', CAST(i AS INTEGER), CASE WHEN i = 0 AND n_nationkey + 1 < 25 THEN NULL WHEN i = 0 THEN '#n' || (n_nationkey + 1) ELSE 'sea' END,
  CASE WHEN i = 0 AND n_nationkey + 1 < 25 THEN '#n' || (n_nationkey + 1) END FROM nation, (VALUES (0), (1)) v(i)
UNION ALL SELECT '#r' || r_regionkey, 'name', 0, r_name, NULL FROM region""")
def workbook_graph(spark, d):
    """Sheets of a workbook as a graph: cells that name an id of the workbook are references."""
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    heads = spark.createDataFrame([("Nation", 1, ["@id", "@type", " name ", ".region", "near", ""]), ("Region", 1, ["@id", "name"])], "sheet string, row_no int, cells array<string>")
    near = F.concat(F.lit('["#n'), (F.col("n_nationkey") + 1).cast("string"), F.lit('", "sea"]'))
    nations = n.select(F.lit("Nation").alias("sheet"), (F.col("n_nationkey") + 2).cast("int").alias("row_no"), F.array(F.concat(F.lit("#n"), _s("n_nationkey")), F.lit("Place, Thing"), F.col("n_name"), F.concat(F.lit('"#r'), _s("n_regionkey"), F.lit('"')), near, F.lit("lost")).alias("cells"))
    regions = r.select(F.lit("Region").alias("sheet"), (F.col("r_regionkey") + 2).cast("int").alias("row_no"), F.array(F.concat(F.lit("#r"), _s("r_regionkey")), F.col("r_name")).alias("cells"))
    return builds.workbook_graph(heads.unionByName(nations).unionByName(regions))[1].select("id", "key", "ord", "value", "ref")


@query("rewrite_pages", """SELECT 'p' || page_id AS path, '<a href="new/' || page_id || '.html?q=1#x">t</a><img src=''y.png''><b style="background:url(new/i' || page_id || '.png)">' || page_id || '</b>' AS html FROM pages""")
def rewrite_pages(spark, d):
    """Links to copied files point at their copies."""
    p, k = _t(spark, d, "pages"), _s("page_id")
    html = F.concat(F.lit('<a href="./x%20'), k, F.lit(".html?q=1#x\">t</a><img src='y.png'><b style=\"background:url(i&amp;"), k, F.lit('.png)">'), k, F.lit("</b>"))
    path = F.concat(F.lit("p"), k).alias("path")
    links = p.select(path, F.concat(F.lit("x "), k, F.lit(".html")).alias("source"), F.concat(F.lit("new/"), k, F.lit(".html")).alias("target"))
    links = links.unionByName(p.select(path, F.concat(F.lit("i&"), k, F.lit(".png")).alias("source"), F.concat(F.lit("new/i"), k, F.lit(".png")).alias("target")))
    return builds.rewrite_pages(p.select(path, html.alias("html")), links)


# -- transcripts -----------------------------------------------------------------------------------------------------------------------


@query("transcript_trimmed", f"""
WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS doc, rank() OVER (PARTITION BY conv_id ORDER BY turn, {_LINE}) AS row_no, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT doc, CAST(row_no AS INTEGER) AS row_no FROM t WHERE row_no > 1 AND row_no <= n - 1""")
def transcript_trimmed(spark, d):
    return transcripts.parse(_as_transcripts(spark, d), header_rows=1, footer_rows=1)["rows"].select("doc", "row_no")


@query("transcript_sections", """
SELECT CAST(conv_id AS VARCHAR) AS doc, name, name = 'MAIN' AS processed, CASE name WHEN 'PRELIMINARIES' THEN 6 WHEN 'MAIN' THEN 7 END AS header_line,
  CASE name WHEN 'PRELIMINARIES' THEN 'section marker was found, but no valid transcript rows were found' WHEN 'MAIN' THEN n || ' transcript row(s) processed' ELSE 'section marker was not found before the end of the document' END AS reason
FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), (VALUES ('PRELIMINARIES'), ('MAIN'), ('POSTLIMINARIES')) m(name)""")
def transcript_sections(spark, d):
    return transcripts.parse(_as_transcripts(spark, d))["section_diagnostics"]


@query("transcript_markers", """SELECT CAST(conv_id AS VARCHAR) AS doc, l AS line_no, m AS matched, CAST(NULL AS VARCHAR) AS near_miss FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES (6, 'PRELIMINARIES'), (7, 'MAIN')) v(l, m)""")
def transcript_markers(spark, d):
    return transcripts.parse(_as_transcripts(spark, d))["markers"].select("doc", "line_no", "matched", "near_miss")


@query("transcript_people", "SELECT id, 'Person' AS type, name, description FROM (VALUES ('#una', 'Una', 'guest'), ('#abe', 'Abe', NULL), ('#SYSTEM', 'Sys', NULL)) p(id, name, description)")
def transcript_people(spark, d):
    return transcripts.person_entities(transcripts.parse(_as_transcripts(spark, d))["speakers"]).select("id", "type", "name", "description")


@query("transcript_unresolved", f"""
WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS doc, role, rank() OVER (PARTITION BY conv_id ORDER BY turn, {_LINE}) AS row_no FROM conversations)
SELECT doc, CAST(row_no AS INTEGER) AS row_no, 'SYSTEM' AS speaker_id FROM t WHERE role NOT IN ('user', 'assistant')""")
def transcript_unresolved(spark, d):
    return transcripts.unresolved(transcripts.parse(_as_transcripts(spark, d))["rows"]).select("doc", "row_no", "speaker_id")


# -- places ----------------------------------------------------------------------------------------------------------------------------

#: an invented gazetteer: each customer's key gives a name of one of four kinds; lakes have two records
_GAZETTEER = """
SELECT c_custkey AS record_no, CASE c_custkey % 4 WHEN 0 THEN 'Mount K' || c_custkey WHEN 1 THEN 'K' || c_custkey || ' Mountain' WHEN 2 THEN 'Port K' || c_custkey || ' North' ELSE 'Lake K' || c_custkey END AS name,
  CASE c_custkey % 3 WHEN 0 THEN 'Queensland, AU' WHEN 1 THEN 'VIC' ELSE 'NSW' END AS region, CASE WHEN c_custkey // 4 % 2 = 0 THEN 'Reef' ELSE 'town or city' END AS kind FROM customer
UNION ALL SELECT c_custkey + 10000000, 'LAKE  K' || c_custkey, 'QLD', 'Reef' FROM customer WHERE c_custkey % 4 = 3"""


def _gazetteer(spark, d):
    c, k = _t(spark, d, "customer"), F.col("c_custkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("Mount K"), _s("c_custkey"))).when(k % 4 == 1, F.concat(F.lit("K"), _s("c_custkey"), F.lit(" Mountain"))).when(k % 4 == 2, F.concat(F.lit("Port K"), _s("c_custkey"), F.lit(" North"))).otherwise(F.concat(F.lit("Lake K"), _s("c_custkey")))
    region = F.when(k % 3 == 0, "Queensland, AU").when(k % 3 == 1, "VIC").otherwise("NSW")
    g = c.select(k.alias("record_no"), name.alias("name"), region.alias("region"), F.when(F.floor(k / 4) % 2 == 0, "Reef").otherwise("town or city").alias("kind"))
    lakes = c.where(k % 4 == 3).select((k + 10_000_000).alias("record_no"), F.concat(F.lit("LAKE  K"), _s("c_custkey")).alias("name"), F.lit("QLD").alias("region"), F.lit("Reef").alias("kind"))
    return g.unionByName(lakes).select("*", F.col("record_no").cast("double").alias("latitude"), F.lit(1.0).alias("longitude"), F.lit("made").alias("provider"), F.lit(0).alias("provider_order"))


@query("place_lookup", f"""
WITH g AS ({_GAZETTEER}),
w AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 'Mt. K' || c_custkey WHEN 1 THEN 'mount K' || c_custkey WHEN 2 THEN 'Port K' || c_custkey ELSE 'lake   k' || c_custkey END AS name, c_custkey % 4 AS case_no, c_custkey AS k FROM customer),
c AS (SELECT w.name, g.name AS matched, record_no, case_no <> 2 AS exact, CASE WHEN case_no = 2 THEN 300 ELSE 400 END + CASE WHEN region IN ('QLD', 'Queensland, AU') THEN 10 ELSE 0 END + CASE WHEN kind = 'Reef' THEN 0 ELSE 5 END AS rank
  FROM w JOIN g ON CASE case_no WHEN 0 THEN g.name = 'Mount K' || k WHEN 1 THEN g.name = 'K' || k || ' Mountain' WHEN 2 THEN starts_with(g.name, 'Port K' || k) ELSE g.name IN ('Lake K' || k, 'LAKE  K' || k) END)
SELECT name, matched, CAST(record_no AS DOUBLE) AS latitude, exact, rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank DESC, record_no) AS r FROM c) WHERE r = 1""")
def place_lookup(spark, d):
    """Exact names under other spellings, names that only begin a record's, records that differ in region and kind."""
    c, k = _t(spark, d, "customer"), F.col("c_custkey")
    asked = c.select(F.when(k % 4 == 0, F.concat(F.lit("Mt. K"), _s("c_custkey"))).when(k % 4 == 1, F.concat(F.lit("mount K"), _s("c_custkey"))).when(k % 4 == 2, F.concat(F.lit("Port K"), _s("c_custkey"))).otherwise(F.concat(F.lit("lake   k"), _s("c_custkey"))).alias("name"))
    return names.resolve_places(asked, _gazetteer(spark, d), "Queensland").select("name", "matched", "latitude", "exact", "rank")


@query("place_cache", """
SELECT 'NATION ' || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'cached' ELSE 'found' END AS state FROM nation WHERE n_nationkey % 3 > 0 OR n_nationkey % 2 = 0""")
def place_cache(spark, d):
    """Even names are in the cache, others in the gazetteer, some nowhere."""
    n, k = _t(spark, d, "nation"), F.col("n_nationkey")
    name = F.concat(F.lit("NATION "), _s("n_nationkey"))
    g = n.where(k % 3 > 0).select(k.cast("long").alias("record_no"), name.alias("name"), k.cast("double").alias("latitude"), F.lit(2.0).alias("longitude"), F.lit("").alias("region"), F.lit("").alias("kind"), F.lit("found").alias("provider"), F.lit(0).alias("provider_order"))
    cache = n.where(k % 2 == 0).select(name.alias("name"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"), F.lit("cached").alias("provider"))
    return names.with_cache(n.select(name.alias("name")), cache, g)[0].select("name", F.col("provider").alias("state"))
