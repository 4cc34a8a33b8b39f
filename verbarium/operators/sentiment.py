"""Lexicon annotation: which categories of a word-category lexicon each token of a section has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import round_half_up
from ..plans.staging import running
from .ngrams import tokenize

#: fixed value: the ten categories
CATEGORIES = "anger anticipation disgust fear joy sadness surprise trust negative positive".split()


class LexiconError(ValueError):
    """A lexicon that can't be used."""


def lexicon(rows: DataFrame) -> DataFrame:
    """word and ten 0/1 flags from rows (word, category); fails on a blank word or an unknown category."""
    clean = rows.select(F.lower(F.trim("word")).alias("word"), F.lower(F.trim("category")).alias("category"))
    bad = clean.where((F.coalesce("word", F.lit("")) == "") | ~F.coalesce(F.col("category").isin(CATEGORIES), F.lit(False))).limit(1).collect()
    if bad:
        raise LexiconError(f"bad lexicon row: {bad[0].word!r}, {bad[0].category!r}")
    return clean.groupBy("word").agg(*[F.max((F.col("category") == c).cast("int")).alias(c) for c in CATEGORIES])


def section_tokens(docs: DataFrame, section: str = "source", renamed: dict[str, str] | None = None) -> DataFrame:
    """section, token_index (from 1), token. Sections are sources, or renamed ones; equal names merge, in the order of (source, line_no).

    A text's tokens never reach over its end, so each text is tokenised by itself; the index adds the sizes of the section's earlier texts,
    a sum over texts, not tokens.
    """
    name = F.col(section)
    if renamed:
        pairs = F.create_map(*[F.lit(x) for kv in renamed.items() for x in kv])
        name = F.coalesce(pairs[name], name)
    name = F.when(F.coalesce(F.trim(name), F.lit("")) == "", "untitled").otherwise(name)
    rows = docs.select(name.alias("section"), "source", "line_no", tokenize("text").alias("t"))
    sizes = running(rows.withColumn("n", F.size("t").cast("long")), ["section"], ["source", "line_no"], "n")
    return sizes.select("section", "before", F.posexplode("t").alias("k", "token")).select("section", (F.col("before") + F.col("k") + 1).alias("token_index"), "token")


def annotate(docs: DataFrame, words: DataFrame, section: str = "source", renamed: dict[str, str] | None = None) -> DataFrame:
    """section, token_index, token and the flags: a row for each token."""
    joined = section_tokens(docs, section, renamed).join(words.withColumnRenamed("word", "token"), "token", "left")
    return joined.select("section", "token_index", "token", *[F.coalesce(c, F.lit(0)).alias(c) for c in CATEGORIES])


def summary(annotated: DataFrame) -> DataFrame:
    """section, total, and for each category its number and percentage with one decimal."""
    sums = annotated.groupBy("section").agg(F.count(F.lit(1)).alias("total"), *[F.sum(c).cast("long").alias(f"{c}_n") for c in CATEGORIES])
    pct = {f"{c}_pct": F.when(F.col("total") > 0, round_half_up(F.col(f"{c}_n") / F.col("total") * 100, 1)).otherwise(0.0) for c in CATEGORIES}
    return sums.withColumns(pct)


def visible(rows: DataFrame, categories: list[str]) -> DataFrame:
    """Only the columns of some categories."""
    hidden = {c for k in CATEGORIES if k not in categories for c in (k, f"{k}_n", f"{k}_pct")}
    return rows.select(*[c for c in rows.columns if c not in hidden])
