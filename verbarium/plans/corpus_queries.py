"""Registered queries over texts, and the SQL that must give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stopwords import ENGLISH
from ..functions.text import TOKEN
from ..operators import cleaning, collocation, concordance, ngrams, selection, sentiment, text_index, topics, variational
from .staging import fresh_dir, spread

TOKEN_SQL = TOKEN.replace("'", "''")
TOKENS = f"list_transform(regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}'), lambda x: lower(x))"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return selection.corpus(_documents(spark, d), order="doc_id")


def conversations(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/conversations.parquet")
    return selection.corpus(t, source="conv_id", order="turn", speaker="role")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


# -- tokens and n-grams ------------------------------------------------------------------------------------------------------------


@query("token_freq", f"SELECT token, count(*) AS f FROM (SELECT unnest({TOKENS}) AS token FROM documents) GROUP BY token")
def token_freq(spark, d):
    return ngrams.unigrams(documents(spark, d))


def _ngram_sql(n: int) -> str:
    return f"""
WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents),
p AS (SELECT doc_id, t, unnest(generate_series(1, len(t) - {n - 1})) AS k FROM t WHERE len(t) >= {n}),
g AS (SELECT doc_id, k - 1 AS pos, array_to_string(t[k:k + {n - 1}], ' ') AS ngram FROM p)
SELECT ngram, count(*) AS n_count, CAST(min({{'line': doc_id, 'pos': pos}}).line AS BIGINT) AS first_line, CAST(min({{'line': doc_id, 'pos': pos}}).pos AS BIGINT) AS first_pos
FROM g GROUP BY ngram"""


for _n in (1, 2, 3, 4, 5):
    QUERIES[f"ngram_{_n}"] = lambda spark, d, n=_n: ngrams.count_ngrams(documents(spark, d), n)
    SQL[f"ngram_{_n}"] = _ngram_sql(_n)


def _assoc_sql(stop: bool) -> str:
    words = ", ".join(f"'{w}'" for w in ENGLISH)
    keep = f"AND split_part(ngram, ' ', 1) NOT IN ({words}) AND split_part(ngram, ' ', 2) NOT IN ({words})" if stop else ""
    return f"""
WITH b AS ({_ngram_sql(2)}), u AS (SELECT token, count(*) AS f FROM (SELECT unnest({TOKENS}) AS token FROM documents) GROUP BY token),
n AS (SELECT CAST(sum(f) AS BIGINT) AS n FROM u)
SELECT ngram, n_count, first_line, first_pos, round(log2(n_count / (CAST(x.f AS DOUBLE) * y.f / n)), 6) AS mi,
       round((n_count - CAST(x.f AS DOUBLE) * y.f / n) / sqrt(greatest(n_count, 1)), 6) AS t
FROM b JOIN u x ON x.token = split_part(ngram, ' ', 1) JOIN u y ON y.token = split_part(ngram, ' ', 2), n
WHERE n_count >= 2 {keep}"""


@query("bigram_assoc", _assoc_sql(False))
def bigram_assoc(spark, d):
    return _rounded(ngrams.analyze(documents(spark, d), 2, 2), "mi", "t")


@query("bigram_ranked", f"SELECT ngram, n_count, mi, t FROM ({_assoc_sql(False)}) ORDER BY n_count DESC, first_line, first_pos LIMIT 200")
def bigram_ranked(spark, d):
    """The 200 most frequent bigrams, ties by first appearance."""
    return _rounded(ngrams.ranked(ngrams.analyze(documents(spark, d), 2, 2)).limit(200).select("ngram", "n_count", "mi", "t"), "mi", "t")


@query("bigram_nostop", _assoc_sql(True))
def bigram_nostop(spark, d):
    return _rounded(ngrams.analyze(documents(spark, d), 2, 2, ENGLISH), "mi", "t")


# -- concordance -------------------------------------------------------------------------------------------------------------------

_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def _kwic_sql(pattern: str, table: str, window: int = 5) -> str:
    side = lambda x: f"list_filter(regexp_split_to_array({x}, '{_WS}'), lambda w: w <> '')"
    return f"""
WITH d AS ({table}), m AS (SELECT *, string_split(regexp_replace(text, '{pattern}', chr(57344) || '\\0' || chr(57345), 'g'), chr(57344)) AS parts FROM d WHERE regexp_matches(text, '{pattern}')),
e AS (SELECT *, unnest(generate_series(1, len(parts) - 1)) AS k FROM m),
f AS (SELECT *, string_split(parts[k + 1], chr(57345))[1] AS keyword, replace(array_to_string(parts[1:k], ''), chr(57345), '') AS l,
      string_split(parts[k + 1], chr(57345))[2] || replace(array_to_string(parts[k + 2:], ''), chr(57345), '') AS r FROM e),
g AS (SELECT *, {side("l")} AS lw, {side("r")} AS rw FROM f WHERE keyword <> '')
SELECT source, line_no, CAST(k AS INTEGER) AS match_no, speaker, array_to_string(lw[greatest(len(lw) - {window - 1}, 1):], ' ') AS "left", keyword, array_to_string(rw[1:{window}], ' ') AS "right" FROM g"""


_CONV = "SELECT CAST(conv_id AS VARCHAR) AS source, turn AS line_no, role AS speaker, text FROM conversations"
_DOCS = "SELECT source, doc_id AS line_no, '' AS speaker, text FROM documents"


@query("kwic_fixed", _kwic_sql("(?i)tion", _CONV))
def kwic_fixed(spark, d):
    return concordance.search(conversations(spark, d), "tion")


@query("kwic_glob", _kwic_sql("(?is)th.ion", _CONV, 3))
def kwic_glob(spark, d):
    return concordance.search(conversations(spark, d), "th?ion", "glob", window=3)


@query("kwic_regex", _kwic_sql("(?i)[aeiou]{3}nd?", _DOCS))
def kwic_regex(spark, d):
    return concordance.search(documents(spark, d), "[aeiou]{3}nd?", "regex")


@query("kwic_wholeword", _kwic_sql(r"\bWas\b", _DOCS, 4))
def kwic_wholeword(spark, d):
    return concordance.search(documents(spark, d), "Was", whole_word=True, case_sensitive=True, window=4)


# -- collocation -------------------------------------------------------------------------------------------------------------------

NODES = ["the", "und", "was"]
_STREAM = f"""
t AS (SELECT source, doc_id, {TOKENS} AS t FROM documents),
o AS (SELECT source, doc_id, t, CAST(coalesce(sum(len(t)) OVER (ORDER BY source, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM t),
s AS (SELECT off + unnest(generate_series(0, len(t) - 1)) AS pos, unnest(t) AS token FROM o WHERE len(t) > 0),
u AS (SELECT token, count(*) AS f FROM s GROUP BY token), n AS (SELECT CAST(sum(f) AS BIGINT) AS N FROM u)"""


def _colloc_sql() -> str:
    nodes = ", ".join(f"'{w}'" for w in NODES)
    choose = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
    lp = lambda x: f"({choose('(a + b)', x)} + {choose('(c + d)', f'(a + c - {x})')} - {choose('(a + b + c + d)', '(a + c)')})"
    cell = lambda x, r, k: f"CASE WHEN {x} > 0 AND ({r}) * ({k}) > 0 THEN {x} * ln({x} / (({r}) * ({k}) / (a + b + c + d))) ELSE 0 END"
    return f"""
WITH {_STREAM},
h AS (SELECT pos, token AS node FROM s WHERE token IN ({nodes})),
w AS (SELECT node, pos + k AS pos FROM h, (SELECT unnest([-5, -4, -3, -2, -1, 1, 2, 3, 4, 5]) AS k)),
c0 AS (SELECT node, token AS collocate, count(*) AS O FROM w JOIN s USING (pos) GROUP BY ALL HAVING count(*) >= 3),
r AS (SELECT c0.*, x.f AS f_node, y.f AS f_collocate, N FROM c0 JOIN u x ON x.token = node JOIN u y ON y.token = collocate, n),
q AS (SELECT *, CAST(f_node AS DOUBLE) * f_collocate / N AS E, CAST(O AS DOUBLE) AS a, CAST(greatest(f_node - O, 0) AS DOUBLE) AS b, CAST(greatest(f_collocate - O, 0) AS DOUBLE) AS c,
      CAST(greatest(N - f_node - f_collocate + O, 0) AS DOUBLE) AS d FROM r),
z AS (SELECT *, (a + b) * (a + c) / (a + b + c + d) AS mean, (a + b) * (a + c) * (c + d) * (b + d) / ((a + b + c + d) * (a + b + c + d) * greatest(a + b + c + d - 1, 1)) AS var FROM q),
y AS (SELECT *, (abs(a - mean) - 0.5) / sqrt(var) AS zz FROM z),
x AS (SELECT *, abs(zz) / sqrt(2) AS ax, 1 / (1 + 0.3275911 * (abs(zz) / sqrt(2))) AS tt FROM y)
SELECT node, collocate, O, round(E, 6) AS E, round(O / E, 6) AS OE, round(log2(O / E), 6) AS MI, round(log2(O * a / E), 6) AS MI2, round(log2(a * a * a / E), 6) AS MI3,
  round(2 * ({cell('a', 'a + b', 'a + c')} + {cell('b', 'a + b', 'b + d')} + {cell('c', 'c + d', 'a + c')} + {cell('d', 'c + d', 'b + d')}), 4) AS G2,
  round((O - E) / sqrt(O), 6) AS tscore, round(a / f_node - c / greatest(N - f_node, 1), 6) AS DeltaP12, round(a / f_collocate - b / greatest(N - f_collocate, 1), 6) AS DeltaP21,
  round(CASE WHEN a + b + c + d > 2000 THEN least(1.0, greatest(0.0, 2 * (1 - 0.5 * (1 + CASE WHEN zz < 0 THEN -1 ELSE 1 END *
     (1 - ((((1.061405429 * tt - 1.453152027) * tt + 1.421413741) * tt - 0.284496736) * tt + 0.254829592) * tt * exp(-ax * ax))))))
   ELSE least(1.0, list_sum(list_transform(generate_series(CAST(greatest(0, a - d) AS BIGINT), CAST(least(a + b, a + c) AS BIGINT)), lambda v: CASE WHEN {lp('v')} <= {lp('a')} + 1e-12 THEN exp({lp('v')}) ELSE 0 END))) END, 6) AS FisherP,
  f_node, f_collocate, N
FROM x"""


_MEASURES = ["E", "OE", "MI", "MI2", "MI3", "tscore", "DeltaP12", "DeltaP21", "FisherP"]


@query("collocations", _colloc_sql())
def collocations(spark, d):
    rows = collocation.collocations(documents(spark, d), NODES, min_freq=3)
    return _rounded(rows, *_MEASURES).withColumn("G2", F.round("G2", 4))


@query("collocations_topn", f"""
WITH r AS ({_colloc_sql()}), k AS (SELECT node, collocate, tscore, row_number() OVER (PARTITION BY node ORDER BY tscore DESC, collocate) AS rank FROM r)
SELECT node, collocate, tscore, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 20""")
def collocations_topn(spark, d):
    rows = _rounded(collocation.collocations(documents(spark, d), NODES, min_freq=3), "tscore")
    return collocation.top(rows, "tscore").select("node", "collocate", "tscore", "rank")


# -- cleaning ----------------------------------------------------------------------------------------------------------------------


def _pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.coalesce("html", F.lit("")).alias("text"))


@query("clean_tags", "SELECT page_id, regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g') AS text FROM pages")
def clean_tags(spark, d):
    return _pages(spark, d).select("page_id", cleaning.clean(F.col("text"), cleaning.Options(["tags"]), spark).alias("text"))


_TRIM = f"regexp_replace(regexp_replace(%s, '^{_WS}', ''), '{_WS}$', '')"
_LINES = f"""array_to_string(list_transform(string_split(regexp_replace(regexp_replace(%s, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)),
  lambda x: {_TRIM % 'x'}), chr(10))"""
_ALL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g'),
  '(?i)https?://[^\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+|www[.][^\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', '', 'g'),
  '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}', '', 'g'), '(\d+)-(\d+)', '\2/\1', 'g'), 'Thre', 'X$', 'g')"""


@query("clean_all", f"SELECT page_id, {_TRIM % (_LINES % f'lower({_ALL})')} AS text FROM pages")
def clean_all(spark, d):
    o = cleaning.Options(["emails", "urls", "tags"], [], [cleaning.Replacement(r"(\d+)-(\d+)", "$2/$1", True), cleaning.Replacement("Thre", "X$")], True, True)
    return _pages(spark, d).select("page_id", cleaning.clean(F.col("text"), o, spark).alias("text"))


_UNITS = "(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


@query("clean_stats", f"""
WITH c AS (SELECT doc_id, coalesce(text, '') AS a, regexp_replace(coalesce(text, ''), '[^\\p{{L}}\\p{{N}} ]', '', 'g') AS b FROM documents),
l AS (SELECT doc_id, CAST({_UNITS.format('a')} AS BIGINT) AS original_length, CAST({_UNITS.format('b')} AS BIGINT) AS cleaned_length FROM c)
SELECT doc_id, original_length, cleaned_length, original_length - cleaned_length AS removed,
  CASE WHEN original_length > 0 THEN floor(CAST(original_length - cleaned_length AS DOUBLE) / original_length * 100 * 10 + 0.5) / 10 ELSE 0.0 END AS percent_removed FROM l""")
def clean_stats(spark, d):
    t = _documents(spark, d)
    return cleaning.clean_documents(t, cleaning.Options(["nonalpha"])).select("doc_id", "original_length", "cleaned_length", "removed", "percent_removed")


@query("characters", """SELECT character, 'U+' || upper(lpad(to_hex(unicode(character)), 4, '0')) AS code, count(*) AS n
FROM (SELECT unnest(string_split(coalesce(text, ''), '')) AS character FROM documents) WHERE character <> '' GROUP BY character""")
def characters(spark, d):
    return cleaning.characters(_documents(spark, d))


@query("clean_targets", r"SELECT page_id, 'out/' || regexp_replace(f, '(\.[^.]+)?$', '') || '_v2' || regexp_extract(f, '(\.[^.]+)$', 1) AS target FROM (SELECT page_id, regexp_extract(coalesce(nullif(regexp_extract(url, '([^/]*)$', 1), ''), 'untitled.txt'), '(.*)', 1) AS f FROM pages)")
def clean_targets(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", cleaning.destination(F.col("url"), "/out/", naming="suffix", suffix="_v2").alias("target"))


# -- lexicon -----------------------------------------------------------------------------------------------------------------------

#: an invented lexicon
LEXICON = [("the", "joy"), ("the", "positive"), ("was", "sadness"), ("was", "negative"), ("und", "trust"), ("que", "fear"), ("le", "anger"), ("a", "surprise"), ("in", "anticipation"), ("de", "disgust")]
_LEX = "(VALUES " + ", ".join(f"('{w}', '{c}')" for w, c in LEXICON) + ") AS l(word, category)"
_FLAGS = ", ".join(f"max(CASE WHEN category = '{c}' THEN 1 ELSE 0 END) AS {c}" for c in sentiment.CATEGORIES)
_ANNOTATED = f"""
t AS (SELECT source, doc_id, {TOKENS} AS t FROM documents),
o AS (SELECT source, t, CAST(coalesce(sum(len(t)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM t),
s AS (SELECT source AS section, off + unnest(generate_series(1, len(t))) AS token_index, unnest(t) AS token FROM o WHERE len(t) > 0),
l AS (SELECT word, {_FLAGS} FROM {_LEX} GROUP BY word),
a AS (SELECT section, token_index, token, {', '.join(f'coalesce({c}, 0) AS {c}' for c in sentiment.CATEGORIES)} FROM s LEFT JOIN l ON word = token)"""


def _annotated(spark, d):
    return sentiment.annotate(documents(spark, d), sentiment.lexicon(spark.createDataFrame(LEXICON, "word string, category string")))


@query("sentiment_tokens", f"WITH {_ANNOTATED} SELECT * FROM a")
def sentiment_tokens(spark, d):
    return _annotated(spark, d)


_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}_n, floor(CAST(sum({c}) AS DOUBLE) / count(*) * 100 * 10 + 0.5) / 10 AS {c}_pct" for c in sentiment.CATEGORIES)


@query("sentiment_summary", f"WITH {_ANNOTATED} SELECT section, count(*) AS total, {_SUMS} FROM a GROUP BY section")
def sentiment_summary(spark, d):
    return sentiment.summary(_annotated(spark, d))


# -- topics ------------------------------------------------------------------------------------------------------------------------

_TERMS = f"""e AS (SELECT doc_id AS id, unnest({TOKENS}) AS term FROM documents),
k AS (SELECT * FROM e WHERE length(term) > 1 AND regexp_matches(term, '\\p{{L}}')),
v AS (SELECT term, count(*) AS n, count(DISTINCT id) AS n_docs FROM k GROUP BY term HAVING count(*) >= 3 AND count(DISTINCT id) >= 2)"""


def _texts(spark, d):
    return _documents(spark, d).select(F.col("doc_id").alias("id"), "text")


def _terms(spark, d):
    return topics.tokens(_texts(spark, d))


@query("vocabulary", f"WITH {_TERMS} SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, term, n, n_docs FROM v")
def vocabulary(spark, d):
    return topics.vocabulary(_terms(spark, d), 3, 2)


@query("vocabulary_dropped", f"WITH {_TERMS} SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT id FROM k JOIN v USING (term))")
def vocabulary_dropped(spark, d):
    terms = _terms(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"))
    return topics.dropped(docs, topics.encode(terms, topics.vocabulary(terms, 3, 2)))


@query("lda_topterms")
def lda_topterms(spark, d):
    return topics.top_terms(variational.fit_texts(_texts(spark, d), 4, iterations=10).terms)


#: words of three of the corpus's languages
SEEDS = [("german", ["und", "der", "die"]), ("french", ["les", "une", "dans"]), ("english", ["the", "and", "that"])]


@query("seeded_topics")
def seeded_topics(spark, d):
    """How many documents each seeded topic, and the residual one, has."""
    model = variational.fit_texts(_texts(spark, d), seeds=SEEDS, iterations=10)
    names = F.element_at(F.array(*map(F.lit, model.names)), F.col("topic") + 1)
    return topics.topic_shares(topics.assign(model.documents)).select("topic", names.alias("name"), "n", F.round("share", 6).alias("share"))


# -- selection ---------------------------------------------------------------------------------------------------------------------


@query("sources", "SELECT DISTINCT source FROM documents")
def source_list(spark, d):
    return selection.sources(documents(spark, d))


@query("table_documents", "SELECT 'nation#' || n_nationkey AS id, 'nation' AS source, CAST(n_nationkey AS BIGINT) AS line_no, '' AS speaker, CAST(n_name AS VARCHAR) || ' ' || n_regionkey AS text FROM nation")
def table_documents(spark, d):
    t = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")
    return selection.select_documents(documents(spark, d), {"nation": (t, "n_nationkey")}, "nation", ["n_name", "n_regionkey"])


@query("topic_documents", f"WITH g AS (SELECT source, min(doc_id) AS line_no, string_agg(coalesce(text, ''), ' ' ORDER BY doc_id) AS t FROM documents GROUP BY source) SELECT source AS id, source, source AS label, line_no, {_TRIM % 't'} AS text FROM g WHERE t <> ''")
def topic_documents(spark, d):
    return selection.topic_documents(documents(spark, d))


# -- keyword in context over an index ------------------------------------------------------------------------------------------------

#: a part of words, words side by side, a glob, a whole word
_INDEXED = [("ouen", "(?i)ouen", {}), ("the er", "(?i)the er", {}), ("th?ngand*est", r"(?i)th[\s\S]ngand[\s\S]*est", {"match": "glob"}), ("Was", r"\bWas\b", {"whole_word": True, "case_sensitive": True})]


@query("kwic_index", "\nUNION ALL\n".join(f"SELECT {k} AS query, * FROM ({_kwic_sql(pattern, _DOCS, 4)})" for k, (_, pattern, _) in enumerate(_INDEXED)))
def kwic_index(spark, d):
    """Searches of an index of all documents."""
    index = text_index.build(documents(spark, d), fresh_dir(spark, "index"), folders=16)
    return reduce(DataFrame.unionByName, [index.search(q, window=4, **options).select(F.lit(k).alias("query"), "*") for k, (q, _, options) in enumerate(_INDEXED)])
