"""Tokens, n-grams and bigram association."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stopwords import ENGLISH
from ..functions.text import TOKEN, round_half_up, units


def tokenize(text: Column | str, case_sensitive: bool = False) -> Column:
    """Words with inner apostrophes and hyphens, in order."""
    found = F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return found if case_sensitive else F.transform(found, F.lower)


def topic_tokens(text: Column | str) -> Column:
    """Lower-cased tokens of at least two UTF-16 units that hold a letter."""
    return F.filter(tokenize(text), is_topic_token)


def is_topic_token(t: Column) -> Column:
    return (units(t) > 1) & t.rlike(r"\p{L}")


def token_table(docs: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """source, line_no, pos, token: a row for each token; tokens of a row are found once."""
    return docs.select("source", "line_no", F.posexplode(tokenize("text", case_sensitive)).alias("pos", "token"))


def ngrams(docs: DataFrame, n: int, case_sensitive: bool = False) -> DataFrame:
    """line_no, pos, ngram: windows of n tokens; none crosses documents."""
    t = docs.select("line_no", tokenize("text", case_sensitive).alias("t"))
    grams = F.expr(f"if(size(t) >= {n}, transform(sequence(0, size(t) - {n}), i -> array_join(slice(t, i + 1, {n}), ' ')), cast(array() as array<string>))")
    return t.select("line_no", F.posexplode(grams).alias("pos", "ngram"))


def count_ngrams(docs: DataFrame, n: int, case_sensitive: bool = False, place_bits: int = 24) -> DataFrame:
    """ngram, n_count, first_line, first_pos. The first place as one number keeps the aggregate in a hash table: `place_bits` of it are for the position in
    the text, the others for the line number. A place that doesn't fit is an error, which says so; 31 bits hold every position there can be."""
    line, pos, low = F.col("line_no"), F.col("pos").cast("long"), 1 << place_bits
    fits = (line >= 0) & (line < 1 << (63 - place_bits)) & (pos < low)
    place = F.when(fits, line * F.lit(low) + pos).otherwise(F.raise_error(F.lit(f"a place doesn't fit {place_bits} bits of position and {63 - place_bits} of line number; choose other place_bits")).cast("long"))
    counted = ngrams(docs, n, case_sensitive).groupBy("ngram").agg(F.count(F.lit(1)).alias("n_count"), F.min(place).alias("first"))
    return counted.select("ngram", "n_count", F.shiftright("first", place_bits).alias("first_line"), (F.col("first") % low).alias("first_pos"))


def unigrams(docs: DataFrame, case_sensitive: bool = False) -> DataFrame:
    return docs.select(F.explode(tokenize("text", case_sensitive)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("f"))


def analyze(docs: DataFrame, n: int = 2, min_freq: int = 1, stopwords: list[str] | None = None, case_sensitive: bool = False) -> DataFrame:
    """ngram, n_count, first_line, first_pos, and for bigrams mi and t.

    Pairs are counted before they meet the unigram counts, so a frequent word is looked up once for each distinct pair, not for each
    occurrence. The number of tokens is one row. Counts of single words and the total aren't filtered by stop words.
    """
    counted = count_ngrams(docs, n, case_sensitive).where(F.col("n_count") >= min_freq)
    if stopwords:
        banned = F.array(*[F.lit(w) for w in stopwords])
        counted = counted.where(~F.arrays_overlap(F.split(F.lower("ngram"), " "), banned))
    if n != 2:
        return counted
    words = unigrams(docs, case_sensitive)
    total = words.agg(F.sum("f").alias("n_tokens"))
    left, right = words.select(F.col("token").alias("w1"), F.col("f").alias("f1")), words.select(F.col("token").alias("w2"), F.col("f").alias("f2"))
    pairs = counted.withColumn("w1", F.substring_index("ngram", " ", 1)).withColumn("w2", F.substring_index("ngram", " ", -1))
    joined = pairs.join(left, "w1").join(right, "w2").withColumn("n_tokens", total.scalar())
    return joined.select("ngram", "n_count", "first_line", "first_pos", *[c.alias(k) for k, c in association("n_count", "f1", "f2", "n_tokens").items()])


def association(o: str, f1: str, f2: str, n: str) -> dict[str, Column]:
    """Mutual information and t-score of a pair from its count, its words' counts and the number of tokens."""
    e = F.col(f1).cast("double") * F.col(f2) / F.col(n)
    return {"mi": F.when(e > 0, F.log2(F.col(o) / e)), "t": (F.col(o) - e) / F.sqrt(F.greatest(F.col(o).cast("double"), F.lit(1.0)))}


def ranked(rows: DataFrame, by: str = "n_count") -> DataFrame:
    """Largest first, nulls last, ties by first appearance."""
    return rows.orderBy(F.desc_nulls_last(by), "first_line", "first_pos")


def shown(rows: DataFrame) -> DataFrame:
    """As exported: two decimals."""
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), F.format_string("%.2f", round_half_up(F.col(c), 2))).otherwise("") for c in ("mi", "t") if c in rows.columns})


ENGLISH_STOPWORDS = ENGLISH
