"""Registered queries over files that they write themselves, and over further operators on texts and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squash
from ..operators import charts, cleaning, formats, graph, names, selection, topics
from ..sources import readers, sinks
from .corpus_queries import _LINES, _TERMS, _TRIM, _WS, documents
from .staging import fresh_dir, spread

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


def _ref(kind: str, key: str):
    return F.concat(F.lit(kind), F.col(key).cast("string"))


_NONE = lambda kind: F.lit(None).cast(kind)


# -- files -----------------------------------------------------------------------------------------------------------------------------


@query("csv_loader", "SELECT coalesce(role, '') AS speaker, coalesce(text, '') AS text, count(*) AS n FROM conversations GROUP BY ALL")
def csv_loader(spark, d):
    """Turns written as a folder of CSV files, each with its header, and read as a corpus."""
    path = fresh_dir(spark, "csv")
    sinks.write_csv(_t(spark, d, "conversations").select("conv_id", F.col("role").alias("speakerID"), "text").repartition(3, "conv_id"), path)
    return readers.csv_corpus(spark, path).groupBy("speaker", "text").agg(F.count(F.lit(1)).alias("n"))


@query("csv_cells", "SELECT n_nationkey || ' ' || n_name || ' ' || n_regionkey AS text, '' AS speaker, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS line_no FROM nation")
def csv_cells(spark, d):
    """A file for each region; all cells are the text, rows are numbered in their file."""
    path = fresh_dir(spark, "csv")
    n = _t(spark, d, "nation")
    for (region,) in sorted(n.select("n_regionkey").distinct().collect()):
        sinks.write_csv(n.where(F.col("n_regionkey") == region).orderBy("n_nationkey").coalesce(1), f"{path}/{region}")
    parts = [readers.csv_corpus(spark, f"{path}/{r}") for (r,) in sorted(n.select("n_regionkey").distinct().collect())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("text", "speaker", "line_no")


@query("text_loader", f"SELECT x AS text, count(*) AS n FROM (SELECT unnest(string_split(replace(coalesce(text, ''), chr(13), ' '), chr(10))) AS x FROM conversations) WHERE {_TRIM % 'x'} <> '' GROUP BY x")
def text_loader(spark, d):
    """Texts as plain files, read as lines that aren't blank."""
    path = fresh_dir(spark, "txt")
    _t(spark, d, "conversations").select(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(" ")).alias("value")).write.text(path)
    return readers.text_lines(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


_FEELINGS = {"ECONOMY": "Joy", "PROMO": "surprise", "STANDARD": " trust", "MEDIUM": "NEGATIVE", "LARGE": "fear", "SMALL": "positive"}


@query("lexicon_loader", "SELECT lower(p_name) AS word, " + ", ".join(f"max(CASE WHEN p_type = '{k}' THEN 1 ELSE 0 END) AS {c.strip().lower()}" for k, c in _FEELINGS.items()) + " FROM part GROUP BY lower(p_name)")
def lexicon_loader(spark, d):
    """Parts' names, their types as categories, written as a lexicon file and read again."""
    path = fresh_dir(spark, "lexicon")
    feelings = F.create_map(*[F.lit(x) for kv in _FEELINGS.items() for x in kv])
    sinks.write_csv(_t(spark, d, "part").select(F.col("p_name").alias("Word"), feelings[F.col("p_type")].alias("SENTIMENT")), path)
    return readers.lexicon_csv(spark, path).select("word", *[c.strip().lower() for c in _FEELINGS.values()])


@query("decoded_files", "SELECT c_custkey, c_name || ' é 日 😀' AS text FROM customer")
def decoded_files(spark, d):
    """Contents in the encodings that a byte order mark names, and without one."""
    text = F.concat("c_name", F.lit(" é 日 😀"))
    made = [F.concat(F.unhex(F.lit(mark)), F.encode(text, code)) for mark, code in (("", "UTF-8"), ("EFBBBF", "UTF-8"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE"))]
    content = F.element_at(F.array(*made), (F.col("c_custkey") % 4 + 1).cast("int"))
    return _t(spark, d, "customer").select("c_custkey", readers.decode(content).alias("text"))


@query("graph_round_trip", """SELECT '#s' || s_suppkey AS id, 'name' AS key, 0 AS ord, s_name || ' "x"' AS value, NULL AS ref FROM supplier
UNION ALL SELECT '#s' || s_suppkey, 'nation', 0, NULL, '#n' || s_nationkey FROM supplier UNION ALL SELECT '#s' || s_suppkey, 'nation', 1, NULL, '#n' || (s_nationkey + 1) FROM supplier""")
def graph_round_trip(spark, d):
    """A metadata graph written as JSON and read again."""
    s = _t(spark, d, "supplier")
    entity = s.select(_ref("#s", "s_suppkey").alias("id"), F.array(F.lit("Person"), F.lit("Agent")).alias("types"))
    name = s.select(_ref("#s", "s_suppkey").alias("id"), F.lit("name").alias("key"), F.lit(0).alias("ord"), F.concat("s_name", F.lit(' "x"')).alias("value"), _NONE("string").alias("ref"))
    links = s.select(_ref("#s", "s_suppkey").alias("id"), F.lit("nation").alias("key"), F.explode(F.array(F.struct(F.lit(0).alias("ord"), _ref("#n", "s_nationkey").alias("ref")), F.struct(F.lit(1).alias("ord"), F.concat(F.lit("#n"), (F.col("s_nationkey") + 1).cast("string")).alias("ref")))).alias("l"))
    prop = name.unionByName(links.select("id", "key", "l.ord", _NONE("string").alias("value"), "l.ref"))
    path = fresh_dir(spark, "graph")
    graph.to_json(entity, prop).select(F.concat(F.lit('{"@graph":['), "json", F.lit("]}")).alias("value")).write.text(path)
    return graph.from_json(spark.read.text(path).withColumnRenamed("value", "text"))[1].select("id", "key", "ord", "value", "ref")


def _zip(*members: tuple[str, str]) -> str:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members:
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue().hex().upper()


_TYPES = ("[Content_Types].xml", "<Types/>")
#: content, extension, public identifier, media type, warning. Junk before a PDF, archives told apart by their members whatever the name says, three formats in one container
#: format, a mark far inside, text with and without an extension that says so, and what nothing knows.
_FILES = [
    (b"junk \n%PDF-1.4 body %%EOF\n".hex(), "pdf", "fmt/18", "application/pdf", None), (b"%PDF-1.7\n%%EOF".hex(), "txt", "fmt/276", "application/pdf", "extension mismatch"), (b"%PDF-1.7 without an end".hex(), "pdf", "fmt/14", "application/pdf", "match on extension only"),
    (_zip(_TYPES, ("word/document.xml", "<w/>")), "docx", "fmt/412", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", None),
    (_zip(_TYPES, ("xl/workbook.xml", "<x/>")), "docx", "fmt/214", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "extension mismatch"),
    (_zip(_TYPES, ("old/word/document.xml", "xl/workbook.xml")), "zip", "x-fmt/263", "application/zip", None),
    (_zip(("mimetype", "application/vnd.oasis.opendocument.text"), ("content.xml", "<o/>")), "odt", "fmt/291", "application/vnd.oasis.opendocument.text", None),
    (b"RIFF\x10\0\0\0WAVEfmt \x10\0\0\0\x01\0".hex(), "wav", "fmt/141", "audio/x-wav", None), (b"RIFF\x10\0\0\0WAVEJUNK".hex(), "WAV", "fmt/6", "audio/x-wav", None), (b"RIFF\x10\0\0\0WEBPVP8 ".hex(), "webp", "fmt/566", "image/webp", None),
    ((b"x" * 257 + b"ustar\0").hex(), "tar", "x-fmt/265", "application/x-tar", None), (b"\xff\xd8\xff\xe1\0\x10Exif\0".hex(), "jpg", "fmt/645", "image/jpeg", None), (bytes.fromhex("D0CF11E0A1B11AE1").hex(), "doc", "fmt/111", "https://www.nationalarchives.gov.uk/PRONOM/fmt/111", None),
    (b"a,b\n1,2\n".hex(), "csv", "x-fmt/18", "text/csv", None), (b"some words\n".hex(), "notes", "x-fmt/111", "text/plain", "match on text only; extension mismatch"), (b"\x00\x01\x02".hex(), "png", "fmt/11", "image/png", "match on extension only"), (b"\x00\x01\x02".hex(), "zzz", None, None, None),
]
_SQL_FILES = ", ".join("(" + ", ".join(str(k) if n == 0 else "NULL" if v is None else f"'{v}'" for n, v in enumerate([k, *row[1:]])) + ")" for k, row in enumerate(_FILES))


@query("file_formats", f"""SELECT 'd/' || s_suppkey || '.' || ext AS path, puid, encoding_format, warning FROM supplier JOIN (VALUES {_SQL_FILES}) f(i, ext, puid, encoding_format, warning) ON s_suppkey % {len(_FILES)} = i WHERE puid IS NOT NULL""")
def file_formats(spark, d):
    """Files made from keys, told by their bytes."""
    i = (F.col("s_suppkey") % len(_FILES) + 1).cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(m[k]) for m in _FILES]), i)
    files = _t(spark, d, "supplier").select(F.concat(F.lit("d/"), F.col("s_suppkey").cast("string"), F.lit("."), pick(1)).alias("path"), F.unhex(pick(0)).alias("content"))
    return formats.encoding_formats(formats.identify(formats.edges_of_content(files))).drop("name")


# -- cleaning ----------------------------------------------------------------------------------------------------------------------


def _clean(spark, d, **options):
    pages = _t(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("text"))
    return pages.select("page_id", cleaning.clean(F.col("text"), cleaning.Options(**options), spark).alias("text"))


_JS = _WS[1:-2]


@query("clean_numbers", "SELECT page_id, regexp_replace(coalesce(html, ''), '[0-9]+', '', 'g') AS text FROM pages")
def clean_numbers(spark, d):
    return _clean(spark, d, prebuilt=["numbers"])


@query("clean_punct", f"SELECT page_id, regexp_replace(coalesce(html, ''), '[^\\p{{L}}\\p{{N}}{_JS}]', '', 'g') AS text FROM pages")
def clean_punct(spark, d):
    return _clean(spark, d, prebuilt=["punct"])


@query("clean_speakers", f"""SELECT conv_id, turn, regexp_replace('[' || upper(role) || '_1]: <S' || turn || '> ' || coalesce(text, ''), '(\\[[A-Z0-9_]+\\][{_JS}]*:?|<[A-Z0-9$_-]+>[{_JS}]*(<#>[{_JS}]*)?)', '', 'g') AS text FROM conversations""")
def clean_speakers(spark, d):
    c = _t(spark, d, "conversations")
    said = F.concat(F.lit("["), F.upper("role"), F.lit("_1]: <S"), F.col("turn").cast("string"), F.lit("> "), F.coalesce("text", F.lit("")))
    return c.select("conv_id", "turn", cleaning.clean(said, cleaning.Options(["speaker"]), spark).alias("text"))


@query("clean_custom", "SELECT page_id, replace(regexp_replace(regexp_replace(coalesce(html, ''), 'e[rn]', '', 'g'), '[qz]u?', '', 'g'), 'ion', 'ION') AS text FROM pages")
def clean_custom(spark, d):
    """Custom patterns in their order, one that doesn't compile left out; then a literal replacement."""
    return _clean(spark, d, custom="e[rn]\n(\n\n [qz]u? ", replacements=[cleaning.Replacement("ion", "ION")])


@query("clean_whitespace", f"SELECT page_id, {_TRIM % (_LINES % 'coalesce(html, chr(32))')} AS text FROM pages")
def clean_whitespace(spark, d):
    return _clean(spark, d, whitespace=True)


@query("clean_files", r"""
WITH p AS (SELECT page_id, 'in/' || page_id || '.x.txt' AS path, CASE WHEN page_id % 5 = 0 THEN NULL ELSE coalesce(html, '') END AS t FROM pages),
c AS (SELECT *, regexp_replace(coalesce(t, ''), '<[^>]*>', '', 'g') AS text FROM p)
SELECT path, 'done/' || page_id || '.x_new.txt' AS target, text, CASE WHEN t IS NULL THEN 'error' ELSE 'cleaned' END AS status FROM c""")
def clean_files(spark, d):
    """A row for each file, also for one that couldn't be read."""
    k = F.col("page_id")
    files = _t(spark, d, "pages").select(F.concat(F.lit("in/"), k.cast("string"), F.lit(".x.txt")).alias("path"), F.when(k % 5 != 0, F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("content"))
    return cleaning.clean_files(files, cleaning.Options(["tags"]), folder="done", naming="suffix", suffix="_new").select("path", "target", "text", "status")


@query("destination_prefix", r"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a b/c/x_' || page_id || '.md' ELSE 'x_untitled.txt' END AS target FROM pages")
def destination_prefix(spark, d):
    k = F.col("page_id")
    path = F.when(k % 2 == 0, F.concat(F.lit("//a b\\c\\"), k.cast("string"), F.lit(".md"))).otherwise(F.lit("///"))
    return _t(spark, d, "pages").select("page_id", cleaning.destination(path, folder=" ", naming="prefix", prefix="x_").alias("target"))


@query("timecodes", f"""
WITH t AS (SELECT conv_id, turn, coalesce(text, '') || ' (12:3) a ( ~7:{{}} ) b (~' || turn || ':05 ) (x:1)' AS s FROM conversations)
SELECT conv_id, turn, regexp_replace(s, '\\([{_JS}]*~?[0-9]+:[0-9]+[{_JS}]*\\)', '', 'g') AS text, len(regexp_extract_all(s, '\\([{_JS}]*~?[0-9]+:[0-9]+[{_JS}]*\\)')) AS n FROM t""")
def timecodes(spark, d):
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" (12:3) a ( ~7:{} ) b (~"), F.col("turn").cast("string"), F.lit(":05 ) (x:1)"))
    text, found = cleaning.strip_timecodes(said)
    return _t(spark, d, "conversations").select("conv_id", "turn", text.alias("text"), F.size(found).cast("long").alias("n"))


# -- selection ---------------------------------------------------------------------------------------------------------------------


@query("contains_any", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '12') OR contains(lower(c_mktsegment), '12')")
def contains_any(spark, d):
    return selection.contains(_t(spark, d, "customer"), " 12 ", ["c_name", "c_mktsegment"]).select("c_custkey", "c_name")


@query("select_many", """WITH s AS (SELECT min(source) AS a, max(source) AS b FROM documents)
SELECT source || '#' || doc_id AS id, source, doc_id AS line_no, '' AS speaker, coalesce(text, '') AS text, 1 AS branch FROM documents, s WHERE source = a
UNION ALL SELECT source || '#' || doc_id, source, doc_id, '', coalesce(text, ''), 2 FROM documents, s WHERE source = b
UNION ALL SELECT 'nation#' || n_nationkey, 'nation', n_nationkey, '', n_name, 0 FROM nation""")
def select_many(spark, d):
    docs = documents(spark, d)
    low, high = docs.agg(F.min("source"), F.max("source")).first()
    table = _t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return selection.select_many(docs, {"nation": (table, "n_nationkey")}, ["nation", low, high], {"nation": ["n_name"]}).select("id", "source", "line_no", "speaker", "text", F.col("branch").cast("int").alias("branch"))


@query("plot_rows", f"SELECT c_custkey, nullif({_TRIM % 'x'}, '') IS NULL AS missing, x FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_name END AS x FROM customer) WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, true, NULL FROM customer WHERE c_custkey % 3 = 0")
def plot_rows(spark, d):
    """Blank cells are missing values."""
    t = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_name")).alias("x"))
    return charts.plot_rows(t).select("c_custkey", F.col("x").isNull().alias("missing"), "x")


@query("chart_points", "SELECT c_custkey, c_name AS label, CAST(c_acctbal AS DOUBLE) AS value FROM customer WHERE c_custkey % 4 <> 0")
def chart_points(spark, d):
    t = _t(spark, d, "customer").withColumn("y", F.when(F.col("c_custkey") % 4 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")))
    return charts.chart_points(t, "c_custkey", "c_name", "y")


@query("chart_preview", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS c_name FROM customer ORDER BY customer.c_custkey LIMIT 200")
def chart_preview(spark, d):
    """The rows that are shown beside a chart, the first 200."""
    t = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("c_name"))
    return charts.preview(t, "c_custkey")


@query("fixed_decimals", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE format('{:.1f}', floor(c_acctbal * 10 + 0.5) / 10) END AS b FROM customer")
def fixed_decimals(spark, d):
    t = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("b"))
    return sinks.fixed(t, 1, ["b"])


# -- topics ------------------------------------------------------------------------------------------------------------------------

#: topic weights made from keys
_WEIGHTS = "SELECT o_orderkey AS id, CAST(unnest([0, 1, 2]) AS INTEGER) AS topic, CAST(unnest([o_custkey % 5, o_orderkey % 5, 2]) AS DOUBLE) AS weight FROM orders"


def _weights(spark, d):
    w = [F.col("o_custkey") % 5, F.col("o_orderkey") % 5, F.lit(2)]
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.posexplode(F.array(*[x.cast("double") for x in w])).alias("topic", "weight"))
    return rows


@query("topic_assign", f"SELECT id, topic, weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, topic) AS r FROM ({_WEIGHTS})) WHERE r = 1")
def topic_assign(spark, d):
    return topics.assign(_weights(spark, d))


@query("topic_shares", f"SELECT topic, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, topic) AS r FROM ({_WEIGHTS})) WHERE r = 1 GROUP BY topic")
def topic_shares(spark, d):
    return topics.topic_shares(topics.assign(_weights(spark, d))).withColumn("share", F.round("share", 6))


@query("topic_topterms", """SELECT topic, CAST(r AS INTEGER) AS rank, term, weight FROM (SELECT CAST(c_nationkey AS INTEGER) AS topic, c_name AS term, floor(c_acctbal / 500) AS weight,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 500) DESC, c_custkey) AS r FROM customer) WHERE r <= 7""")
def topic_topterms(spark, d):
    w = _t(spark, d, "customer").select(F.col("c_nationkey").alias("topic"), F.col("c_name").alias("term"), F.col("c_custkey").alias("term_id"), F.floor(F.col("c_acctbal") / 500).cast("double").alias("weight"))
    return topics.top_terms(w, 7)


@query("source_vocabulary", f"""WITH {_TERMS.replace("SELECT doc_id AS id", "SELECT source AS id")} SELECT term, n, n_docs FROM v""")
def source_vocabulary(spark, d):
    """Vocabulary of sources as documents, from their lines."""
    terms = topics.tokens(selection.topic_rows(documents(spark, d)).select("id", "text"))
    return topics.vocabulary(terms, 3, 2).select("term", "n", "n_docs")


# -- graphs ------------------------------------------------------------------------------------------------------------------------

#: orders as files, each below one of three folders; customers refer to them
_LINKS = "SELECT '#c' || o_custkey AS id, 'hasPart' AS key, CAST(o_orderkey AS INTEGER) AS ord, CASE o_orderkey % 3 WHEN 0 THEN './out/' WHEN 1 THEN 'out2/' ELSE '' END || 'f' || o_orderkey AS ref FROM orders"


def _files(spark, d):
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.concat(F.when(k % 3 == 0, "./out/").when(k % 3 == 1, "out2/").otherwise(""), F.lit("f"), k.cast("string")).alias("file"))
    people = o.select(_ref("#c", "o_custkey").alias("id")).distinct().select("id", F.array(F.lit("Person")).alias("types"))
    entity = people.unionByName(o.select(F.col("file").alias("id"), F.array(F.lit("File")).alias("types")))
    prop = o.select(_ref("#c", "o_custkey").alias("id"), F.lit("hasPart").alias("key"), F.col("o_orderkey").cast("int").alias("ord"), _NONE("string").alias("value"), F.col("file").alias("ref"))
    return entity, prop


@query("reverse_refs", f"SELECT ref AS id, key, id AS source FROM ({_LINKS})")
def reverse_refs(spark, d):
    return graph.reverse(_files(spark, d)[1])


@query("remove_outputs", f"SELECT id, key, ord, ref FROM ({_LINKS}) WHERE NOT starts_with(regexp_replace(ref, '^\\./', ''), 'out/')")
def remove_outputs(spark, d):
    return graph.remove_outputs(*_files(spark, d), ["./out/"])[1].select("id", "key", "ord", "ref")


@query("local_files", f"SELECT DISTINCT regexp_replace(ref, '^\\./', '') AS path, right(ref, 1) IN ('0', '5') AS missing FROM ({_LINKS})")
def local_files(spark, d):
    entity, prop = _files(spark, d)
    there = _t(spark, d, "orders").where(~F.right(F.col("o_orderkey").cast("string"), F.lit(1)).isin("0", "5"))
    k = F.col("o_orderkey")
    there = there.select(F.concat(F.when(k % 3 == 0, "out/").when(k % 3 == 1, "out2/").otherwise(""), F.lit("f"), k.cast("string")).alias("path"))
    found, missing = graph.local_files(entity, prop, there)
    return found.select("path", F.lit(False).alias("missing")).unionByName(missing.select("path", F.lit(True).alias("missing")))


_DOTTED = [f"n{k}" for k in range(0, 25, 2)]


@query("replace_dot_slash", f"""
WITH r AS (SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'n' ELSE './n' END || s_nationkey AS ref FROM supplier UNION ALL SELECT s_suppkey, './n' || s_nationkey FROM supplier)
SELECT DISTINCT '#s' || s_suppkey AS id, CASE WHEN ref[3:] IN ({', '.join(f"'{x}'" for x in _DOTTED)}) AND starts_with(ref, './') THEN ref[3:] ELSE ref END AS ref FROM r""")
def replace_dot_slash(spark, d):
    s, n = _t(spark, d, "supplier"), F.col("s_nationkey")
    refs = F.array(F.concat(F.when(n % 2 == 0, "n").otherwise("./n"), n.cast("string")), F.concat(F.lit("./n"), n.cast("string")))
    prop = s.select(_ref("#s", "s_suppkey").alias("id"), F.lit("nation").alias("key"), _NONE("string").alias("value"), F.posexplode(refs).alias("ord", "ref")).select("id", "key", "ord", "value", "ref")
    entity = prop.select(F.col("ref").alias("id")).distinct().select("id", F.array(F.lit("Place")).alias("types"))
    return graph.replace_dot_slash(entity, prop, _DOTTED)[1].select("id", "ref")


@query("seed_root", """SELECT './' AS id, 'k' || n_nationkey AS key, CASE WHEN n_nationkey % 4 = 0 THEN 'own' ELSE n_name END AS value FROM nation WHERE n_nationkey > 0
UNION ALL SELECT './', 'k0', 'own' FROM nation WHERE n_nationkey = 0""")
def seed_root(spark, d):
    """What our root lacks is taken from another graph's root."""
    n = _t(spark, d, "nation")
    row = lambda t, value: t.select(F.lit("./").alias("id"), _ref("k", "n_nationkey").alias("key"), F.lit(0).alias("ord"), value.alias("value"), _NONE("string").alias("ref"))
    ours = row(n.where("n_nationkey % 4 = 0"), F.lit("own"))
    return graph.seed_root(ours, row(n, F.col("n_name"))).select("id", "key", "value")


@query("counted_messages", "SELECT o_orderpriority || ' ' || o_orderstatus AS message, count(*) AS n FROM orders GROUP BY ALL ORDER BY min(o_orderkey) LIMIT 40")
def counted_messages(spark, d):
    m = _t(spark, d, "orders").select(F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("message"), F.col("o_orderkey").alias("ord"))
    return graph.counted_messages(m).select("message", "n")


@query("merge_settings", """SELECT DISTINCT p_brand AS type, p_type AS key, coalesce(p_size_ok, false) AS selected FROM (SELECT p_brand, p_type, bool_or(p_size = 1) AS p_size_ok FROM part GROUP BY ALL)""")
def merge_settings(spark, d):
    """Choices made before stay; what is new is unselected."""
    p = _t(spark, d, "part")
    found = p.select(F.col("p_brand").alias("type"), F.col("p_type").alias("key")).distinct()
    settings = p.where("p_size = 1").select(F.col("p_brand").alias("type"), F.col("p_type").alias("key"), F.lit(True).alias("selected")).distinct()
    return graph.merge_settings(found, settings)


@query("prefixes", "SELECT 'p' || n_regionkey AS prefix, 'https://x.org/' || min(n_nationkey) AS uri FROM nation GROUP BY n_regionkey UNION ALL SELECT 'c', 'http://c.org/'")
def prefixes(spark, d):
    """The first of each prefix counts, from an @context object or plain pairs."""
    n = _t(spark, d, "nation")
    rows = n.select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("p"), F.col("n_regionkey").cast("string"), F.lit(":")).alias("key"), _ref("https://x.org/", "n_nationkey").alias("value"))
    context = spark.createDataFrame([(-1, "@context", '{"c": "http://c.org/"}'), (-2, "note", "no address")], "ord int, key string, value string")
    return graph.prefixes(rows.unionByName(context))


@query("relabel", "SELECT '#n' || n_nationkey AS id, CASE n_nationkey WHEN 1 THEN 'One' WHEN 2 THEN 'Two' ELSE n_name END AS value FROM nation")
def relabel(spark, d):
    n = _t(spark, d, "nation")
    prop = n.select(_ref("#n", "n_nationkey").alias("id"), F.lit("name").alias("key"), F.lit(0).alias("ord"), F.col("n_name").alias("value"), _NONE("string").alias("ref"))
    return graph.relabel(prop, {"#n1": "One", "#n2": "Two"}).select("id", "value")


@query("rows_of_csv", "SELECT s_suppkey, o_orderkey FROM supplier JOIN orders ON s_suppkey % 100 = o_custkey % 100")
def rows_of_csv(spark, d):
    table = _t(spark, d, "supplier").select("s_suppkey", F.concat((F.col("s_suppkey") % 100).cast("string"), F.lit(".csv")).alias("path"))
    rows = _t(spark, d, "orders").select("o_orderkey", F.concat((F.col("o_custkey") % 100).cast("string"), F.lit(".csv")).alias("path"))
    return graph.rows_of_csv(table, rows).select("s_suppkey", "o_orderkey")


@query("unlisted_names", "SELECT DISTINCT c_custkey AS doc, 'P ' || (c_custkey % 50) AS name FROM customer WHERE c_custkey % 50 >= 20")
def unlisted_names(spark, d):
    """Names that aren't on the list of people."""
    lines = spark.range(20).select(F.col("id").alias("line_no"), F.concat(F.lit(" p   "), F.col("id").cast("string")).alias("line"))
    found = _t(spark, d, "customer").select(F.col("c_custkey").alias("doc"), F.concat(F.lit("P "), (F.col("c_custkey") % 50).cast("string")).alias("name"))
    return names.without_listed(found, names.people_list(lines))


_PEOPLE = "SELECT o_orderkey, 'Ann ' || (o_custkey % 40) AS name FROM orders"


@query("link_names", f"""
WITH n AS ({_PEOPLE}), k AS (SELECT 'f' || o_orderkey AS id, '#ann_' || (replace(name, 'Ann ', '')) AS ref FROM n)
SELECT DISTINCT id, ref FROM k""")
def link_names(spark, d):
    """A Person for each name, linked once to each file that mentions it; some persons and links exist already."""
    o = spread(_t(spark, d, "orders"))
    found = o.select(_ref("f", "o_orderkey").alias("doc"), F.concat(F.lit("Ann "), (F.col("o_custkey") % 40).cast("string")).alias("name"))
    twice = found.unionByName(found)
    there = spark.range(0, 40, 4).select(F.concat(F.lit("#ann_"), F.col("id").cast("string")).alias("id"), F.array(F.lit("Person")).alias("types"))
    have = o.where("o_custkey % 40 = 8").select(_ref("f", "o_orderkey").alias("id"), F.lit("mentions").alias("key"), F.lit(0).alias("ord"), _NONE("string").alias("value"), F.lit("#ann_8").alias("ref"))
    return names.link_names(there, have, twice, "mentions", "Person")[1].where("key = 'mentions'").select("id", "ref")


@query("squashed", "SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '" + _WS + "', ' ', 'g'), ' ') AS text FROM conversations")
def squashed(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", squash(F.coalesce("text", F.lit(""))).alias("text"))
