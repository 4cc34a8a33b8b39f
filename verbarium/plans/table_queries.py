"""Registered queries over tables, graphs, transcripts and names, and the SQL that must give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import charts, grammar, graph, induction, names, tagger, transcripts
from .staging import spread

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


# -- charts and plots ----------------------------------------------------------------------------------------------------------------


@query("chart_geometry", """
WITH a AS (SELECT count(o_totalprice) AS n_points, count(*) - count(o_totalprice) AS skipped, least(min(o_totalprice), 0.0) AS y_min, greatest(max(o_totalprice), 0.0) AS y_max FROM orders),
s AS (SELECT *, CASE WHEN y_max - y_min = 0 THEN 1.0 ELSE y_max - y_min END AS span FROM a)
SELECT n_points, skipped, y_min, y_max, span, CAST(greatest(1, ceil(n_points / 12)) AS BIGINT) AS label_every, k AS tick_no, y_min + span * k / 4 AS tick FROM s, (SELECT CAST(unnest([0, 1, 2, 3, 4]) AS INTEGER) AS k)""")
def chart_geometry(spark, d):
    g = charts.chart_geometry(_t(spark, d, "orders"), "o_totalprice")
    return g.select(*[c for c in g.columns if c != "ticks"], F.posexplode("ticks").alias("tick_no", "tick"))


@query("tick_labels", """SELECT o_orderkey, CASE WHEN o_totalprice >= 1000 THEN regexp_replace(regexp_replace(format('{:.2f}', floor(o_totalprice / 100 + 0.5) / 10), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || 'k'
ELSE regexp_replace(regexp_replace(format('{:.2f}', floor(o_totalprice * 100 + 0.5) / 100), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') END AS label FROM orders""")
def tick_labels(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", charts.tick_label(F.col("o_totalprice")).alias("label"))


@query("bar_count", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def bar_count(spark, d):
    return charts.bar_count(_t(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("bar_percent", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS percent FROM lineitem GROUP BY l_returnflag, l_linestatus")
def bar_percent(spark, d):
    return charts.bar_percent(_t(spark, d, "lineitem"), "l_returnflag", "l_linestatus").withColumn("percent", F.round("percent", 6))


@query("bar_share", "SELECT o_orderpriority, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM orders GROUP BY o_orderpriority")
def bar_share(spark, d):
    return charts.bar_percent(_t(spark, d, "orders"), "o_orderpriority").withColumn("percent", F.round("percent", 6))


@query("scatter", "SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y, l_returnflag AS color FROM lineitem")
def scatter(spark, d):
    return charts.scatter(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


@query("box", """
WITH q AS (SELECT l_returnflag, count(l_extendedprice) AS n, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY ALL)
SELECT l_returnflag, any_value(n) AS n, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3,
  min(l_extendedprice) FILTER (l_extendedprice >= q1 - 1.5 * (q3 - q1)) AS low, max(l_extendedprice) FILTER (l_extendedprice <= q3 + 1.5 * (q3 - q1)) AS high
FROM lineitem JOIN q USING (l_returnflag) GROUP BY l_returnflag""")
def box(spark, d):
    return charts.box(_t(spark, d, "lineitem"), "l_returnflag", "l_extendedprice").withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("histogram", "SELECT floor(l_extendedprice / 2500.0) * 2500.0 AS bin_start, count(*) AS n FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY ALL")
def histogram(spark, d):
    return charts.histogram(_t(spark, d, "lineitem"), "l_extendedprice", 2500.0)


@query("histogram_yearmonth", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n FROM orders GROUP BY ALL")
def histogram_yearmonth(spark, d):
    return charts.time_histogram(_t(spark, d, "orders"), "o_orderdate", "yearmonth")


@query("histogram_dayhours", "SELECT CAST(dayofweek(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hours, count(*) AS n FROM events GROUP BY ALL")
def histogram_dayhours(spark, d):
    return charts.time_histogram(_t(spark, d, "events"), "ts", "dayhours")


@query("invalid_counts", """SELECT 'c_acctbal' AS variable, count(c_acctbal) AS n_valid, count(*) - count(c_acctbal) AS n_invalid FROM customer
UNION ALL SELECT 'c_mktsegment', 0, count(*) FROM customer""")
def invalid_counts(spark, d):
    return charts.invalid_counts(_t(spark, d, "customer"), ["c_acctbal", "c_mktsegment"])


#: places made from keys: some without a latitude, some without a weight
_PLACES = """SELECT CASE WHEN s_suppkey % 7 = 0 THEN 'unknown' ELSE CAST(s_suppkey % 80 - 40 AS VARCHAR) END AS lat, CAST(s_suppkey % 170 AS VARCHAR) AS lon, CASE WHEN s_suppkey % 5 = 0 THEN '0' ELSE CAST(s_suppkey % 9 AS VARCHAR) END AS w FROM supplier"""


def _points(spark, d):
    k = F.col("s_suppkey")
    t = _t(spark, d, "supplier").select(F.when(k % 7 == 0, "unknown").otherwise((k % 80 - 40).cast("string")).alias("lat"), (k % 170).cast("string").alias("lon"), F.when(k % 5 == 0, "0").otherwise((k % 9).cast("string")).alias("w"))
    return charts.map_points(t, "lat", "lon", "w")


@query("map_points", f"SELECT CAST(lat AS DOUBLE) AS latitude, CAST(lon AS DOUBLE) AS longitude, coalesce(nullif(CAST(w AS DOUBLE), 0), 1) AS weight FROM ({_PLACES}) WHERE lat <> 'unknown'")
def map_points(spark, d):
    return _points(spark, d)[0]


@query("map_usable", f"SELECT count(*) FILTER (lat <> 'unknown') AS usable, count(*) FILTER (lat = 'unknown') AS invalid FROM ({_PLACES})")
def map_usable(spark, d):
    return _points(spark, d)[1]


@query("mercator", f"""SELECT latitude, longitude, floor((longitude + 180) / 360 * 1024 * 100 + 0.5) / 100 AS x,
floor((1 - ln(tan(radians(latitude)) + 1 / cos(radians(latitude))) / pi()) / 2 * 1024 * 100 + 0.5) / 100 AS y
FROM (SELECT DISTINCT CAST(lat AS DOUBLE) AS latitude, CAST(lon AS DOUBLE) AS longitude FROM ({_PLACES}) WHERE lat <> 'unknown')""")
def mercator(spark, d):
    x, y = charts.mercator(F.col("latitude"), F.col("longitude"), 2)
    return _points(spark, d)[0].select("latitude", "longitude").distinct().select("latitude", "longitude", x.alias("x"), y.alias("y"))


@query("heat_cells", f"""WITH p AS (SELECT CAST(lat AS DOUBLE) AS la, CAST(lon AS DOUBLE) AS lo, coalesce(nullif(CAST(w AS DOUBLE), 0), 1) AS weight FROM ({_PLACES}) WHERE lat <> 'unknown'),
m AS (SELECT weight, floor((lo + 180) / 360 * 2048 * 100 + 0.5) / 100 AS x, floor((1 - ln(tan(radians(la)) + 1 / cos(radians(la))) / pi()) / 2 * 2048 * 100 + 0.5) / 100 AS y FROM p)
SELECT CAST(floor(x / 16) AS BIGINT) AS cell_x, CAST(floor(y / 16) AS BIGINT) AS cell_y, sum(weight) AS weight FROM m GROUP BY ALL""")
def heat_cells(spark, d):
    return charts.heat_cells(_points(spark, d)[0], 3)


# -- a graph made from keys: regions hold nations, nations customers, customers orders -------------------------------------------------

_EDGES = [("nation", "r", "n_regionkey", "n", "n_nationkey"), ("customer", "n", "c_nationkey", "c", "c_custkey")]


def _graph(spark, d):
    """Entities and properties; some customers state a publish flag, some refer to an entity that isn't there."""
    r, n, c = _t(spark, d, "region"), _t(spark, d, "nation"), _t(spark, d, "customer")
    ident = lambda p, k: F.concat(F.lit(f"#{p}"), F.col(k).cast("string"))
    none = F.lit(None).cast("string")
    e = [
        spark.createDataFrame([("./", ["Dataset"])], graph.ENTITY), r.select(ident("r", "r_regionkey").alias("id"), F.array(F.lit("RepositoryCollection")).alias("types")),
        n.select(ident("n", "n_nationkey").alias("id"), F.array(F.lit("RepositoryObject")).alias("types")), c.select(ident("c", "c_custkey").alias("id"), F.array(F.lit("Person")).alias("types")),
    ]
    ref = lambda df, a, k, b, o: df.select(a.alias("id"), F.lit(k).alias("key"), F.col(o).cast("int").alias("ord"), none.alias("value"), b.alias("ref"))
    val = lambda df, a, k, v: df.select(a.alias("id"), F.lit(k).alias("key"), F.lit(0).alias("ord"), v.cast("string").alias("value"), none.alias("ref"))
    p = [
        ref(r, F.lit("./"), "hasPart", ident("r", "r_regionkey"), "r_regionkey"), ref(n, ident("r", "n_regionkey"), "hasPart", ident("n", "n_nationkey"), "n_nationkey"),
        ref(c, ident("n", "c_nationkey"), "hasPart", ident("c", "c_custkey"), "c_custkey"), val(c, ident("c", "c_custkey"), "name", F.col("c_name")),
        val(c.where("c_custkey % 3 = 0"), ident("c", "c_custkey"), graph.PUBLISH, F.when(F.col("c_custkey") % 2 == 0, "true").otherwise("false")),
        val(n.where("n_nationkey % 4 = 1"), ident("n", "n_nationkey"), graph.PUBLISH, F.lit("true")),
        ref(c.where("c_custkey % 10 = 7"), ident("c", "c_custkey"), "knows", F.concat(F.lit("#c"), (F.col("c_custkey") * 2).cast("string")), "c_custkey"),
    ]
    return reduce(DataFrame.unionByName, e), reduce(DataFrame.unionByName, p)


@query("publish_cascade", """
WITH e AS (SELECT './' AS parent, '#r' || r_regionkey AS id FROM region UNION ALL SELECT '#r' || n_regionkey, '#n' || n_nationkey FROM nation UNION ALL SELECT '#n' || c_nationkey, '#c' || c_custkey FROM customer),
f AS (SELECT '#c' || c_custkey AS id, c_custkey % 2 = 0 AS own FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT '#n' || n_nationkey, true FROM nation WHERE n_nationkey % 4 = 1),
x AS (SELECT a.id, a.parent, coalesce(f.own, g.own, h.own) AS effective FROM e a LEFT JOIN f ON f.id = a.id LEFT JOIN f g ON g.id = a.parent LEFT JOIN e b ON b.id = a.parent LEFT JOIN f h ON h.id = b.parent),
k1 AS (SELECT id FROM x WHERE effective), k2 AS (SELECT id FROM k1 UNION SELECT parent FROM x WHERE id IN (SELECT id FROM k1)),
k3 AS (SELECT id FROM k2 UNION SELECT parent FROM x WHERE id IN (SELECT id FROM k2))
SELECT id, effective, id IN (SELECT id FROM k3) AS kept FROM x""")
def publish_cascade(spark, d):
    return graph.publish_subset(*_graph(spark, d)).select("id", "effective", "kept")


@query("dangling_refs", "SELECT '#c' || c_custkey AS id, 'knows' AS key, '#c' || (c_custkey * 2) AS ref FROM customer WHERE c_custkey % 10 = 7 AND c_custkey * 2 NOT IN (SELECT c_custkey FROM customer)")
def dangling_refs(spark, d):
    return graph.dangling(*_graph(spark, d))


@query("orphan_sweep", """
WITH a AS (SELECT c_custkey FROM customer WHERE c_custkey % 20 = 7)
SELECT './' AS id UNION SELECT '#c' || c_custkey FROM a UNION SELECT '#c' || (a.c_custkey * 2) FROM a JOIN customer k ON k.c_custkey = a.c_custkey * 2""")
def orphan_sweep(spark, d):
    """The root names some customers as authors; what these know stays, the rest goes in rounds."""
    e, p = _graph(spark, d)
    who = _t(spark, d, "customer").where("c_custkey % 20 = 7").select(F.lit("./").alias("id"), F.lit("author").alias("key"), F.col("c_custkey").cast("int").alias("ord"), F.lit(None).cast("string").alias("value"), F.concat(F.lit("#c"), F.col("c_custkey").cast("string")).alias("ref"))
    return graph.clear_scan(e, p.unionByName(who))[0].select("id")


@query("types_properties", """
SELECT 'Person' AS type, 'name' AS key, count(*) AS n_entities, CAST(0 AS BIGINT) AS n_refs FROM customer
UNION ALL SELECT 'Person', 'custom:publish', count(*), 0 FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'Person', 'knows', count(*), count(*) FROM customer WHERE c_custkey % 10 = 7
UNION ALL SELECT 'RepositoryObject', 'custom:publish', count(*), 0 FROM nation WHERE n_nationkey % 4 = 1
UNION ALL SELECT 'RepositoryObject', 'hasPart', count(DISTINCT c_nationkey), count(*) FROM customer
UNION ALL SELECT 'RepositoryCollection', 'hasPart', count(DISTINCT n_regionkey), count(*) FROM nation
UNION ALL SELECT 'Dataset', 'hasPart', 1, count(*) FROM region""")
def types_properties(spark, d):
    return graph.inspect(*_graph(spark, d))


@query("flatten_persons", """SELECT '#c' || c.c_custkey AS id, c.c_name AS name, CASE WHEN c.c_custkey % 3 = 0 THEN CASE WHEN c.c_custkey % 2 = 0 THEN 'true' ELSE 'false' END END AS "custom:publish", k.c_name AS knows_name
FROM customer c LEFT JOIN customer k ON k.c_custkey = c.c_custkey * 2 AND c.c_custkey % 10 = 7""")
def flatten_persons(spark, d):
    return graph.table_of(*_graph(spark, d), "Person", ["name", graph.PUBLISH], {"knows": ["name"]})


def _sheet(spark, d):
    return _t(spark, d, "supplier").select(F.concat(F.lit("#c"), F.col("s_suppkey").cast("string")).alias("@id"), F.col("s_suppkey").alias("row_no"), F.col("s_name").alias("title"), F.when(F.col("s_suppkey") % 2 == 0, "Ann Lee, Bo/[Cy]").alias("who"))


@query("merge_by_id", """
WITH s AS (SELECT '#c' || s_suppkey AS id, s_name, s_suppkey FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer))
SELECT id, 'label' AS key, 0 AS ord, s_name AS value, NULL AS ref FROM s
UNION ALL SELECT id, 'author', k, NULL, r FROM s, (VALUES (0, '#ann_lee'), (1, '#bo'), (2, '#cy')) v(k, r) WHERE s_suppkey % 2 = 0""")
def merge_by_id(spark, d):
    e, p = _graph(spark, d)
    out = graph.merge_sheet(e, p, _sheet(spark, d), [{"source": "title", "target": "label"}, {"source": "who", "target": "author", "type": "Person"}])
    return out["prop"].where("key in ('label', 'author')").select("id", "key", "ord", "value", "ref")


@query("unknown_properties", "SELECT '#c' || c_custkey AS id, 'custom:publish' AS key FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT '#n' || n_nationkey, 'custom:publish' FROM nation WHERE n_nationkey % 4 = 1")
def unknown_properties(spark, d):
    known = spark.createDataFrame([("hasPart",), ("name",), ("knows",)], "key string")
    return graph.unknown_properties(*_graph(spark, d), known)


@query("set_geometry", """
SELECT '#location-place-' || n_nationkey AS id, '.latitude' AS key, CAST(CAST(n_nationkey AS DOUBLE) AS VARCHAR) AS value FROM nation
UNION ALL SELECT '#location-place-' || n_nationkey, '.longitude', CAST(CAST(n_regionkey AS DOUBLE) AS VARCHAR) FROM nation
UNION ALL SELECT '#location-place-' || n_nationkey, 'asWKT', 'POINT(' || CAST(n_regionkey AS DOUBLE) || ' ' || CAST(n_nationkey AS DOUBLE) || ')' FROM nation""")
def set_geometry(spark, d):
    e, p = _graph(spark, d)
    places = _t(spark, d, "nation").select(F.concat(F.lit("#place-place-"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("latitude"), F.col("n_regionkey").cast("double").alias("longitude"))
    return graph.set_geometry(e, p, places)[1].where("id like '#location-%'").select("id", "key", "value")


@query("custom_properties", "SELECT 'arcp://name,custom/terms#publish' AS id, 'Publish' AS value")
def custom_properties(spark, d):
    return graph.custom_properties(*_graph(spark, d))[1].where("id like 'arcp:%'").select("id", "value")


@query("collection_members", "SELECT './' AS id, 'pcdm:hasMember' AS key, '#n' || n_nationkey AS ref FROM nation WHERE n_regionkey = 1")
def collection_members(spark, d):
    e, p = _graph(spark, d)
    n = _t(spark, d, "nation").where("n_regionkey = 1").select(F.lit("./").alias("id"), F.concat(F.lit("#n"), F.col("n_nationkey").cast("string")).alias("ref"))
    wanted = n.union(spark.createDataFrame([("./", "#nowhere")], "id string, ref string"))
    return graph.apply_membership(e, p, wanted)[0].where("key = 'pcdm:hasMember'").select("id", "key", "ref")


@query("merge_graphs", """
WITH n AS (SELECT n_nationkey FROM nation)
SELECT count(*) FILTER (s_suppkey NOT IN (SELECT c_custkey FROM customer)) AS added, count(*) FILTER (s_suppkey IN (SELECT c_custkey FROM customer)) AS enriched, CAST(0 AS BIGINT) AS remapped FROM supplier""")
def merge_graphs(spark, d):
    e, p = _graph(spark, d)
    s = _t(spark, d, "supplier").withColumn("id", F.concat(F.lit("#c"), F.col("s_suppkey").cast("string")))
    se = s.select("id", F.array(F.lit("Person")).alias("types"))
    sp = s.select("id", F.lit("name").alias("key"), F.lit(0).alias("ord"), F.col("s_name").alias("value"), F.lit(None).cast("string").alias("ref"))
    return graph.merge_graphs(e, p, se, sp)[2]


# -- transcripts: conversations as lines ---------------------------------------------------------------------------------------------

_LINE = "upper(role) || ': ' || regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')"


def _as_transcripts(spark, d):
    c = _t(spark, d, "conversations")
    line = F.concat(F.upper("role"), F.lit(": "), F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"])
    body = c.groupBy(F.col("conv_id").cast("string").alias("doc")).agg(F.array_join(ordered, "\n").alias("b"))
    return body.select("doc", F.concat(F.lit("Transcript: x\nSpeakers:\nUSER: Una (guest) #una\nASSISTANT: Abe #abe\nSYSTEM: Sys\nPRELIMINARIES\nMAIN\n"), "b").alias("text"))


@query("turns", f"""
WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS doc, turn, role, rank() OVER (PARTITION BY conv_id ORDER BY turn, {_LINE}) AS row_no, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS text FROM conversations)
SELECT doc, CAST(row_no AS INTEGER) AS row_no, '' AS turn_number, CASE role WHEN 'user' THEN '#una' WHEN 'assistant' THEN '#abe' ELSE 'SYSTEM' END AS speaker_id,
  translate(text, '“”‘’—–', '""''''--') AS text, 'MAIN' AS section FROM t""")
def turns(spark, d):
    return transcripts.parse(_as_transcripts(spark, d))["rows"].drop("line_no")


@query("speakers", """SELECT DISTINCT CAST(conv_id AS VARCHAR) AS doc, s.* FROM conversations,
(VALUES ('USER', 'Una', 'guest', '#una'), ('ASSISTANT', 'Abe', NULL, '#abe'), ('SYSTEM', 'Sys', NULL, 'SYSTEM')) s(code, name, demographic, resolved)""")
def speakers(spark, d):
    return transcripts.parse(_as_transcripts(spark, d))["speakers"].select("doc", "code", "name", "demographic", "resolved")


@query("issue_tally", "SELECT 'speaker-id-missing' AS kind, count(DISTINCT conv_id) AS n FROM conversations")
def issue_tally(spark, d):
    return transcripts.issue_tally(transcripts.parse(_as_transcripts(spark, d))["speaker_diagnostics"])


@query("chat_export", f"""
WITH t AS (SELECT conv_id, turn, upper(role) AS code, {_LINE} AS l, translate(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), '“”‘’—–', '""''''--') AS text FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS doc, '@Participants: USER Participant, ASSISTANT Participant, SYSTEM Participant' || chr(10) || '@ID: eng|c1|USER|||guest||Participant|||' || chr(10) || '@ID: eng|c1|ASSISTANT|||||Participant|||' || chr(10)
  || '@ID: eng|c1|SYSTEM|||||Participant|||' || chr(10) || '@Begin' || chr(10) || string_agg('*' || code || ': ' || text, chr(10) ORDER BY turn, l) || chr(10) || '@End' || chr(10) AS text
FROM t GROUP BY conv_id""")
def chat_export(spark, d):
    p = transcripts.parse(_as_transcripts(spark, d))
    return transcripts.chat_text(p["rows"], p["speakers"], "eng", "c1")


@query("transcript_csv", f"""
WITH t AS (SELECT conv_id, turn, {_LINE} AS l, CASE role WHEN 'user' THEN '#una' WHEN 'assistant' THEN '#abe' ELSE 'SYSTEM' END AS who,
  translate(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), '“”‘’—–', '""\'\'--') AS x FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS doc, 'turnNumber,speakerID,text,section' || chr(10) || string_agg(',' || who || ',' || CASE WHEN regexp_matches(x, '[,"]') THEN '"' || replace(x, '"', '""') || '"' ELSE x END || ',MAIN', chr(10) ORDER BY turn, l) || chr(10) AS text
FROM t GROUP BY conv_id""".replace("\\'", "''"))
def transcript_csv(spark, d):
    return transcripts.csv_text(transcripts.parse(_as_transcripts(spark, d))["rows"])


GRAMMAR = {
    "version": 1, "name": "numbered", "regions": {"layout": {"header": False, "speakers": False}, "main": {"sectionPattern": "^== .*$"}}, "ignore": ["^%.*"], "strip": [{"pattern": "[(][^()]*[)]"}],
    "turnRow": {"pattern": r"^(?<turn>\d+)\t(?<speaker>[a-z]+): (?<text>.*)$", "rowStart": r"^(?<turn>\d+)\t"},
}


def _numbered(spark, d):
    """Each turn as a numbered row that is followed by a comment and a wrapped line, below a section line."""
    c = _t(spark, d, "conversations")
    row = F.concat(F.col("turn").cast("string"), F.lit("\t"), "role", F.lit(": "), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), F.lit(" (x)\n% note\n  tail"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", row.alias("l")))), lambda x: x["l"])
    return c.groupBy(F.col("conv_id").cast("string").alias("doc")).agg(F.concat(F.lit("== A\n"), F.array_join(ordered, "\n")).alias("text"))


#: Turns as the grammar reads them: what the strip rule leaves of a text; a row without any text lacks the blank that its pattern wants.
_STRIPPED = r"""
SELECT conv_id, turn, role, trim(regexp_replace(regexp_replace(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')), '[(][^()]*[)]', '', 'g'), ' +', ' ', 'g')) AS l FROM conversations"""


@query("grammar_turns", f"""
SELECT CAST(conv_id AS VARCHAR) AS doc, CAST(turn AS VARCHAR) AS turn_number, CASE WHEN l = '' THEN '' ELSE '#' || role END AS speaker_id, CASE WHEN l = '' THEN role || ':' ELSE l END || ' tail' AS text, '== A' AS section
FROM ({_STRIPPED})""")
def grammar_turns(spark, d):
    return grammar.rows(grammar.parse(grammar.read_lines(_numbered(spark, d)), GRAMMAR)).select("doc", "turn_number", "speaker_id", "text", "section")


@query("grammar_trial", f"""
WITH s AS (SELECT CAST(conv_id AS VARCHAR) AS doc, l, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, l) AS k FROM ({_STRIPPED}))
SELECT doc, CASE WHEN l = '' THEN 'main:malformed' ELSE 'main' END AS role, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT doc, 'ignore', count(*) FROM s GROUP BY doc
UNION ALL SELECT doc, 'main:continuation', count(*) FROM s GROUP BY doc UNION ALL SELECT doc, 'main:marker', 1 FROM s GROUP BY doc""")
def grammar_trial(spark, d):
    """What the grammar finds in each document."""
    return grammar.trial(grammar.read_lines(_numbered(spark, d)), GRAMMAR)[0].select("doc", "role", "n")


@query("grammar_roles", f"""
WITH s AS ({_STRIPPED})
SELECT role, n FROM (SELECT CASE WHEN l = '' THEN 'main:malformed' ELSE 'main' END AS role, count(*) AS n FROM s GROUP BY ALL
UNION ALL SELECT 'ignore', count(*) FROM s UNION ALL SELECT 'main:continuation', count(*) FROM s UNION ALL SELECT 'main:marker', count(DISTINCT conv_id) FROM s)""")
def grammar_roles(spark, d):
    return grammar.parse(grammar.read_lines(_numbered(spark, d)), GRAMMAR).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def _coded(spark, d, numbered: bool):
    """doc, line_no, line of half of the conversations, numbered or coded, each turn followed by a comment; and four marked turns."""
    c = _t(spark, d, "conversations").where(F.col("conv_id") % 2 == (0 if numbered else 1)).select(F.col("conv_id").cast("string").alias("doc"), "turn", F.coalesce("role", F.lit("?")).alias("role"), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("text"))
    n = F.col("turn").cast("string")
    line = F.concat(n, F.lit("\t"), "role", F.lit(": "), "text") if numbered else F.concat(F.lit("["), "role", F.lit("-"), n, F.lit("] "), "text")
    lines = c.select("doc", F.explode(F.array(F.struct((F.col("turn") * 2).alias("line_no"), line.alias("line")), F.struct((F.col("turn") * 2 + 1).alias("line_no"), F.lit("% note").alias("line")))).alias("l")).select("doc", "l.*")
    marked = []
    for r in c.orderBy("doc", "turn", "role", "text").limit(4).collect():
        spans, at, text = [], 0, ""
        for before, field, value in [("", "turn", str(r.turn)), ("\t", "speaker", r.role), (": ", "text", r.text)] if numbered else [("[", "speaker", r.role), ("-", "turn", str(r.turn)), ("] ", "text", r.text)]:
            text += before + value
            at = len(text)
            spans.append({"field": field, "start": at - len(value), "end": at})
        marked.append({"line": text, "spans": spans})
    return lines, marked


@query("induced_turns", r"""
SELECT CAST(conv_id AS VARCHAR) AS doc, CAST(turn AS VARCHAR) AS turn_number, '#' || coalesce(role, '?') AS speaker_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text
FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL""")
def induced_turns(spark, d):
    """Turns of two transcript layouts, by row patterns induced from four marked turns each and tried on all lines."""
    out = []
    for numbered in (True, False):
        lines, marked = _coded(spark, d, numbered)
        row = induction.induce(lines.where("line <> '% note'"), marked) if marked else {"pattern": "^$"}
        g = {"version": 1, "name": "induced", "regions": {"layout": {"header": False, "speakers": False, "markers": False}}, "ignore": ["^% note$"], "turnRow": row}
        out.append(grammar.rows(grammar.parse(lines.where("doc IS NOT NULL AND line_no IS NOT NULL"), g)).select("doc", "turn_number", "speaker_id", "text"))
    return out[0].unionByName(out[1])


# -- names and places ------------------------------------------------------------------------------------------------------------------

PEOPLE = ["The Heat", "Wh Ha", "De la", "Tion Er", "Les des", "La que"]


@query("name_match", f"""
WITH n AS (SELECT unnest([{', '.join(f"'{p}'" for p in PEOPLE)}]) AS name)
SELECT doc_id AS doc, name FROM documents, n WHERE regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}])' || replace(name, ' ', '\\s+') || '($|[^\\p{{L}}\\p{{N}}])')""")
def name_match(spark, d):
    lines = spark.createDataFrame(list(enumerate(PEOPLE)), "line_no long, line string")
    docs = spread(_t(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"))
    return names.find_names(docs, names.people_list(lines)).select("doc", "name")


@query("tagged_names")
def tagged_names(spark, d):
    """Names in all documents by a tagger. Its list are the runs of two or more capitalised words that two documents share; it finds others that stand like them. SQL can't express it."""
    docs = spread(_t(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"))
    seen = names.candidate_names(docs).where("name LIKE '% %'").groupBy(names.name_key("name").alias("key")).agg(F.min("name").alias("name"), F.countDistinct("doc").alias("n"))
    return tagger.recognise(docs, tagger.fit(docs, seen.where("n > 1").select("name", "key")))


@query("place_rank", """SELECT 'nation_' || n_nationkey AS name, n_name AS matched, CAST(n_nationkey AS DOUBLE) AS latitude, CAST(n_regionkey AS DOUBLE) AS longitude, true AS exact, 400 AS rank FROM nation""")
def place_rank(spark, d):
    n = _t(spark, d, "nation")
    g = n.select(F.col("n_nationkey").cast("long").alias("record_no"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("latitude"), F.col("n_regionkey").cast("double").alias("longitude"),
                 F.lit("").alias("region"), F.lit("").alias("kind"), F.lit("keys").alias("provider"), F.lit(0).alias("provider_order"))
    wanted = n.select(F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("name"))
    return names.resolve_places(wanted, g).select("name", "matched", "latitude", "longitude", "exact", "rank")


@query("language_in_filename", """SELECT CAST(page_id AS VARCHAR) AS id, '#AUSTLANG_' || code AS language_id, code, label AS name
FROM pages, (VALUES ('E1', 'example'), ('T2', 'tionsh'), ('X-3', 'html')) l(code, label)
WHERE regexp_matches(replace(url, '/', '-'), '(?i)\\b' || label || '\\b')""")
def language_in_filename(spark, d):
    langs = spark.createDataFrame([("E1", "example", []), ("T2", "tionsh", []), ("X-3", "html", [])], "code string, name string, alternate_names array<string>")
    files = _t(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), F.concat(F.replace("url", F.lit("/"), F.lit("-")), F.lit(".txt")).alias("path"))
    return names.languages_in_names(files, langs)


@query("entity_ids", "SELECT s_suppkey, '#' || replace(trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-'), '-', '_') AS person, '#place-' || trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS place FROM supplier")
def entity_ids(spark, d):
    return _t(spark, d, "supplier").select("s_suppkey", graph.entity_id("Person", F.col("s_name")).alias("person"), graph.entity_id("Place", F.col("s_name")).alias("place"))




@query("people_list", "WITH k AS (SELECT o_orderkey, 'P ' || (o_custkey % 50) AS name FROM orders) SELECT DISTINCT name, lower(name) AS key FROM k")
def people_list(spark, d):
    lines = _t(spark, d, "orders").select(F.col("o_orderkey").alias("line_no"), F.concat(F.lit(" P  "), (F.col("o_custkey") % 50).cast("string"), F.lit(" ")).alias("line"))
    return names.people_list(lines)


@query("candidate_names", r"""
WITH p AS (SELECT doc_id AS doc, regexp_replace(text, '(\p{L})[''’]s\b', '\1', 'g') AS t FROM documents),
q AS (SELECT doc, regexp_replace(t, '(?:\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Dame|Rev|Fr)\.?[ \t\n\x0B\f\r]+)+(\p{Lu})', '\1', 'g') AS t FROM p),
r AS (SELECT doc, list_filter(regexp_extract_all(t, '\p{Lu}[\p{L}\p{M}''’-]*(?:[ \t]+\p{Lu}[\p{L}\p{M}''’-]*)*'), lambda x: length(regexp_replace(x, '\P{L}', '', 'g')) >= 4) AS l FROM q)
SELECT DISTINCT doc, unnest(l) AS name FROM r""")
def candidate_names(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return names.candidate_names(docs).select("doc", "name")
