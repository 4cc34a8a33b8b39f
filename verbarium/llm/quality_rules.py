"""Quality rules combined by weak supervision, in DataFrame functions only.

Every rule votes good (1), bad (-1) or abstains (0) on a text. Expectation-maximisation over the votes estimates, for each rule, how often
it votes what on good and on bad texts (its accuracy), without labels; the posterior probability of "good" given all votes then
replaces the filter in which every rule must pass. The table of vote patterns on which the estimation works has at most 3^RULES rows
whatever the size of the corpus, and counts all texts.

Defined cases: null and empty texts have no words and fail the base rules; repeated rows are judged alike, each; a posterior of exactly the threshold
keeps; texts of any length are read whole; where no text passes the base rules (an empty table), the expectations stand; null doc_ids keep their row;
extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_kept, stage, text_col

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Share of good texts expected beforehand, and the number of texts that such expectations count as, whatever the size of the table.
PRIOR, WEIGHT = 0.85, 500.0
ROUNDS = 500


def base_features(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and counts that only the rules use.

    Repeated 5-word windows are looked for inside the row. Equal windows have equal 64-bit hashes, so only texts with a repeated hash
    sort their windows (as strings, so the count is exact); then word positions are covered from sorted window starts.
    """
    t = docs.select("doc_id", text_col().alias("text"))
    # two passes over the text: without white space, and without small letters too; the other counts are of what that leaves
    t = t.withColumn("word_chars", F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", ""))).withColumn("rest", F.regexp_replace("text", r"[a-z\x20\x09-\x0D]+", ""))
    t = t.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    t = t.withColumn("lines", F.expr(r"filter(split(text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')")).withColumn("n", F.size("words"))
    t = t.withColumn(
        "hashes",
        F.expr("if(n > 5, transform(sequence(0, n - 5), i -> xxhash64(words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4])), cast(array() as array<bigint>))"),
    )
    t = t.withColumn("windows", F.expr("if(size(array_distinct(hashes)) < size(hashes), sort_array(transform(sequence(0, n - 5), i -> struct(array_join(slice(words, i + 1, 5), ' ') as w, i as p))), null)"))
    t = t.withColumn(
        "starts",
        F.expr("if(windows is null, null, sort_array(transform(filter(sequence(0, n - 5), k -> (k > 0 and windows[k].w = windows[greatest(k - 1, 0)].w) or (k < n - 5 and windows[k].w = windows[least(k + 1, n - 5)].w)), k -> windows[k].p)))"),
    )
    repeats = "coalesce(aggregate(starts, struct(cast(-5 as int) as last, cast(0 as bigint) as total), (a, p) -> struct(p as last, a.total + least(5, p - a.last) as total), a -> a.total), 0)"
    return t.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.length(F.regexp_replace("rest", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(repeats).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.length(F.regexp_replace("rest", r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        (F.col("word_chars") - F.length("rest")).cast("long").alias("n_lower"),
        F.length(F.regexp_replace("rest", r"[^!?]+", "")).cast("long").alias("n_shouts"),
        F.length(F.regexp_replace("rest", r"[^0-9]+", "")).cast("long").alias("n_digits"),
        F.length(F.regexp_replace("rest", r"[^.,;:]+", "")).cast("long").alias("n_stops"),
    )


def rules() -> dict[str, tuple[Column, tuple[float, float], tuple[float, float]]]:
    """Votes from the columns of base_features(), and what is expected of each rule beforehand: P(good, bad vote | good text) and
    P(good, bad vote | bad text). Each rule looks at another property. Most see trouble or abstain: that a text has no symbols says little for it.
    Two see signs of running prose."""
    c, abstain = F.col, F.lit(0)
    per_word = lambda x: c(x) / F.greatest(c("n_words"), F.lit(1))
    letters = F.greatest(c("n_upper") + c("n_lower"), F.lit(1))
    upper, mean = c("n_upper") / letters, per_word("word_chars")
    # distinct words of running text fall about with the root of its length
    variety = c("n_distinct") / F.greatest(F.sqrt(c("n_words").cast("double")), F.lit(1.0))
    trouble, seen = ((0.0, 0.004), (0.0, 0.3)), ((0.7, 0.02), (0.3, 0.3))
    bad = lambda when: F.when(when, -1).otherwise(abstain)
    calm = (per_word("n_symbols") < 0.02) & (per_word("n_shouts") < 0.05) & (upper < 0.15)
    return {
        "symbols": (bad(per_word("n_symbols") > 0.1), *trouble),
        "capitals": (bad((upper > 0.3) & (letters > 20)), *trouble),
        "shouts": (bad(per_word("n_shouts") > 0.15), *trouble),
        "lines": (bad((c("n_lines") >= 4) & (c("n_dup_lines") > 0.5 * c("n_lines"))), *trouble),
        "variety": (bad(F.when(c("n_words") >= 50, variety < 2.0).otherwise(c("n_distinct") < 0.6 * c("n_words"))), *trouble),
        "length": (bad((mean < 2.5) | (mean > 14)), *trouble),
        "digits": (bad(c("n_digits") > 0.5 * c("word_chars")), *trouble),
        "stops": (F.when((c("n_words") >= 50) & (c("n_stops") == 0), -1).when(per_word("n_stops").between(0.01, 0.4), 1).otherwise(abstain), *seen),
        "calm": (F.when(calm, 1).otherwise(abstain), (0.9, 0.0), (0.4, 0.0)),
    }


#: votes in the order of the expectations
VOTES = (1, -1, 0)


def fit(patterns: list[tuple[tuple[int, ...], int]], expected: list[tuple[tuple[float, float], tuple[float, float]]], rounds: int = ROUNDS, prior: float = PRIOR, weight: float = WEIGHT) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation over counted vote patterns: the share of good texts, and for each rule {vote: (P(vote | good),
    P(vote | bad))}. What is expected beforehand counts as `weight` texts, so that of two ways to split the texts the one is found
    in which "good" means good; the votes then move each rule's probabilities, its accuracy, from there, and outgrow the expectations as texts grow.
    Ends when the share of good texts stands still, or after `rounds`."""
    start = [{v: (g[k] if k < 2 else 1 - sum(g), b[k] if k < 2 else 1 - sum(b)) for k, v in enumerate(VOTES)} for g, b in expected]
    start = [{v: (max(g, 1e-4), max(b, 1e-4)) for v, (g, b) in t.items()} for t in start]
    table, share = [dict(t) for t in start], prior
    held = (1 + weight * share, 1 + weight * (1 - share))
    for _ in range(rounds):
        sums = [{v: [held[0] * t[v][0], held[1] * t[v][1]] for v in t} for t in start]
        good, bad = held
        for votes, n in patterns:
            p = posterior(votes, share, table)
            good += n * p
            bad += n * (1 - p)
            for s, v in zip(sums, votes):
                s[v][0] += n * p
                s[v][1] += n * (1 - p)
        before, share = share, good / (good + bad)
        table = [{v: (s[v][0] / sum(x[0] for x in s.values()), s[v][1] / sum(x[1] for x in s.values())) for v in s} for s in sums]
        if abs(share - before) < 1e-10:
            break
    return share, table


def posterior(votes: tuple[int, ...], prior: float, table: list[dict[int, tuple[float, float]]]) -> float:
    z = math.log(prior / (1 - prior)) + sum(math.log(t[v][0] / t[v][1]) for t, v in zip(table, votes))
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior, votes.

    Features are computed once and staged (a hundred bytes a text); the counted patterns decide the rules' weights, and the posterior
    is a column expression of the votes. Texts that fail the base rules have no part in the estimation.
    """
    named = rules()
    f = stage(base_features(docs), "quality")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    f = f.withColumn("base_failed", failed).withColumn("votes", F.array(*[v[0].cast("int") for v in named.values()]))
    counted = f.where(~F.col("base_failed")).groupBy(*[F.col("votes")[i].alias(f"v{i}") for i in range(len(named))]).count().collect()
    patterns = sorted((tuple(r[:-1]), r[-1]) for r in counted)
    prior, table = fit(patterns, [v[1:] for v in named.values()])
    z = F.lit(math.log(prior / (1 - prior)))
    for i, t in enumerate(table):
        v = F.col("votes")[i]
        z = z + F.when(v == 1, math.log(t[1][0] / t[1][1])).when(v == -1, math.log(t[-1][0] / t[-1][1])).otherwise(math.log(t[0][0] / t[0][1]))
    f = f.withColumn("posterior", (1 / (1 + F.exp(-z))))
    return f.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"), "posterior", "votes",
    )


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns, each judged by its own text."""
    return rows_kept(docs, lambda rows: quality_rules(rows).where("kept"))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
