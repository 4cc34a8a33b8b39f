"""Collocation: what occurs within a span of node words, with association measures.

All documents form one stream of tokens, so spans cross documents. Positions come from a running sum over the documents' token counts
(a small table), never over tokens, and only tokens near the ends of documents are joined by position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import running, stage
from .ngrams import token_table, tokenize

#: fixed value: the columns of the result, in order
COLUMNS = "node collocate O E OE MI MI2 MI3 G2 tscore DeltaP12 DeltaP21 FisherP f_node f_collocate N".split()
EXACT = 2000


def parse_nodes(nodes: str | list[str]) -> list[str]:
    """Distinct lower-cased node words in their order."""
    parts = nodes.split(",") if isinstance(nodes, str) else nodes
    return list(dict.fromkeys(x.strip().lower() for x in parts if x.strip()))


def stream(docs: DataFrame, ignore_case: bool = True) -> DataFrame:
    """position, token of all tokens: documents in the order of (source, line_no)."""
    counts = docs.select("source", "line_no", F.size(tokenize("text", True)).cast("long").alias("n"))
    offsets = running(counts, [], ["source", "line_no"], "n").select("source", "line_no", F.col("before").alias("offset"))
    tokens = token_table(docs, not ignore_case)
    return tokens.join(offsets, ["source", "line_no"]).select((F.col("offset") + F.col("pos")).alias("position"), "token")


def token_rows(docs: DataFrame, ignore_case: bool = True) -> DataFrame:
    """source, line_no, t: the tokens of each text, found once and staged, as several passes read them."""
    return stage(docs.select("source", "line_no", tokenize("text", not ignore_case).alias("t")), "tokens")


def cooccurrences(docs: DataFrame, nodes: list[str], left: int, right: int, ignore_case: bool = True) -> DataFrame:
    """node, collocate, O: each hit counts every token of its span but itself; overlapping spans count twice."""
    return _cooccurrences(token_rows(docs, ignore_case), nodes, left, right)


def _cooccurrences(rows: DataFrame, nodes: list[str], left: int, right: int) -> DataFrame:
    """cooccurrences() of token_rows(). Inside a document a span is a slice of its tokens, counted in the task that reads it. Only what crosses a document's ends is
    joined: offsets of hits near an end with tokens near an end, by position in the stream.
    """
    wide = max(left, right)
    found = F.array(*map(F.lit, nodes))
    hits = F.expr("filter(transform(t, (x, i) -> struct(x as node, i as at)), h -> array_contains(nodes, h.node))")
    # the tokens of a span, without the hit itself
    span = F.expr(f"transform(hits, h -> struct(h.node as node, concat(slice(t, greatest(h.at - {left}, 0) + 1, least(h.at, {left})), slice(t, h.at + 2, {right})) as c))")
    inside = rows.withColumn("nodes", found).withColumn("hits", hits).where(F.size("hits") > 0).select(F.explode(span).alias("s")).select(F.col("s.node").alias("node"), F.explode("s.c").alias("collocate"))
    inside = inside.groupBy("node", "collocate").agg(F.count(F.lit(1)).alias("O"))
    edge = F.expr(f"transform(filter(sequence(0, size(t) - 1), i -> i < {wide} or i >= size(t) - {wide}), i -> struct(i as at, t[i] as token))")
    ends = rows.where(F.size("t") > 0).select("source", "line_no", F.size("t").alias("n"), F.explode(edge).alias("e")).select("source", "line_no", "n", "e.*")
    counts = rows.select("source", "line_no", F.size("t").cast("long").alias("n"))
    offsets = running(counts, [], ["source", "line_no"], "n").select("source", "line_no", "before")
    tokens = ends.join(offsets, ["source", "line_no"]).select((F.col("before") + F.col("at")).alias("position"), "token", "at", "n")
    beyond = F.filter(F.sequence(F.lit(-left), F.lit(right)), lambda k: ((F.col("at") + k) < 0) | ((F.col("at") + k) >= F.col("n")))
    across = tokens.where(F.col("token").isin(nodes)).select(F.col("token").alias("node"), F.explode(F.transform(beyond, lambda k: F.col("position") + k)).alias("position"))
    across = across.join(tokens.select("position", F.col("token").alias("collocate")), "position").groupBy("node", "collocate").agg(F.count(F.lit(1)).alias("O"))
    return inside.union(across).groupBy("node", "collocate").agg(F.sum("O").alias("O"))


def collocations(docs: DataFrame, nodes: str | list[str], span_left: int = 5, span_right: int = 5, min_freq: int = 1, ignore_case: bool = True) -> DataFrame:
    """COLUMNS of every pair with O >= min_freq; node words that don't occur give none."""
    wanted = parse_nodes(nodes)
    tokens = token_rows(docs, ignore_case)
    freq = stage(tokens.select(F.explode("t").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("f")), "frequencies")
    total = freq.agg(F.sum("f").alias("N"))
    pairs = _cooccurrences(tokens, wanted, span_left, span_right).where(F.col("O") >= min_freq)
    f1 = freq.where(F.col("token").isin(wanted)).select(F.col("token").alias("node"), F.col("f").alias("f_node"))
    f2 = freq.select(F.col("token").alias("collocate"), F.col("f").alias("f_collocate"))
    rows = pairs.join(f1, "node").join(f2, "collocate").withColumn("N", total.scalar())
    return measures(rows)


def _finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def measures(rows: DataFrame) -> DataFrame:
    """COLUMNS from node, collocate, O, f_node, f_collocate, N."""
    o, f1, f2, n = (F.col(c).cast("double") for c in ("O", "f_node", "f_collocate", "N"))
    rows = rows.withColumn("E", F.when(n > 0, f1 * f2 / n))
    zero = F.lit(0.0)
    rows = rows.withColumn("a", o).withColumn("b", F.greatest(f1 - o, zero)).withColumn("c", F.greatest(f2 - o, zero)).withColumn("d", F.greatest(n - f1 - f2 + o, zero))
    e = F.col("E")
    on = (e > 0) & (o > 0)
    return rows.withColumns(
        {
            "OE": F.when(e > 0, o / e), "MI": F.when(on, F.log2(o / e)), "MI2": F.when(on, F.log2(o * o / e)), "MI3": F.when(on, F.log2(o * o * o / e)), "G2": g2("a", "b", "c", "d"),
            "tscore": F.when(o > 0, (o - e) / F.sqrt(o)), "DeltaP12": o / f1 - F.col("c") / F.greatest(n - f1, F.lit(1.0)), "DeltaP21": o / f2 - F.col("b") / F.greatest(n - f2, F.lit(1.0)),
            "FisherP": fisher("a", "b", "c", "d"),
        }
    ).select(*COLUMNS)


def g2(a: str, b: str, c: str, d: str) -> Column:
    """Log-likelihood ratio of a 2 x 2 table; empty cells count 0."""
    a_, b_, c_, d_ = (F.col(x) for x in (a, b, c, d))
    total = a_ + b_ + c_ + d_
    parts = []
    for cell, row, column in ((a_, a_ + b_, a_ + c_), (b_, a_ + b_, b_ + d_), (c_, c_ + d_, a_ + c_), (d_, c_ + d_, b_ + d_)):
        expected = row * column / total
        parts.append(F.when((cell > 0) & (expected > 0), cell * F.ln(cell / expected)).otherwise(0.0))
    return 2 * (parts[0] + parts[1] + parts[2] + parts[3])


def log_factorials(most: int = EXACT) -> list[float]:
    return [math.lgamma(k + 1) for k in range(most + 1)]


def fisher(a: str, b: str, c: str, d: str) -> Column:
    """Two-tailed exact test; a normal approximation with continuity correction where the cells sum to more than EXACT."""
    a_, b_, c_, d_ = (F.col(x).cast("long") for x in (a, b, c, d))
    total, row, column = a_ + b_ + c_ + d_, a_ + b_, a_ + c_
    table = F.array(*[F.lit(x) for x in log_factorials()])

    def choose(n: Column, k: Column) -> Column:
        f = lambda x: F.element_at(table, (x + 1).cast("int"))
        return F.when((k >= 0) & (k <= n), f(n) - f(k) - f(n - k)).otherwise(float("-inf"))

    low, high = F.greatest(F.lit(0).cast("long"), row - (total - column)), F.least(row, column)
    log_p = lambda x: choose(row, x) + choose(total - row, column - x) - choose(total, column)
    observed = log_p(a_)
    exact = F.aggregate(F.sequence(low, high), F.lit(0.0), lambda s, x: s + F.when(log_p(x) <= observed + 1e-12, F.exp(log_p(x))).otherwise(0.0))
    n, r, k, x = total.cast("double"), row.cast("double"), column.cast("double"), a_.cast("double")
    mean = r * k / n
    variance = r * k * (n - r) * (n - k) / (n * n * F.greatest(n - 1, F.lit(1.0)))
    z = (F.abs(x - mean) - 0.5) / F.sqrt(variance)
    approx = F.greatest(F.lit(0.0), 2 * (1 - normal_cdf(z)))
    approx = F.when(variance == 0, F.when(x == mean, 1.0).otherwise(0.0)).otherwise(approx)
    return F.least(F.lit(1.0), F.when(total > EXACT, approx).otherwise(exact))


#: fixed values: Abramowitz and Stegun 7.1.26
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + ERF_P * x)
    poly = F.lit(0.0)
    for k in reversed(ERF):
        poly = (poly + k) * t
    erf = 1 - poly * F.exp(-x * x)
    return 0.5 * (1 + F.when(z < 0, -1).otherwise(1) * erf)


def top(rows: DataFrame, measure: str, n: int = 20) -> DataFrame:
    """The first n of each node by a measure, nulls left out: rank, and width relative to the largest value."""
    by = Window.partitionBy("node").orderBy(F.desc(measure), "collocate")
    ranked = rows.where(F.col(measure).isNotNull()).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)
    most = F.max(F.abs(measure)).over(Window.partitionBy("node"))
    return ranked.withColumn("width", F.when(most > 0, F.abs(measure) / most).otherwise(0.0))


def ordered(rows: DataFrame, by: str) -> DataFrame:
    """By a measure (largest first, nulls last) or by words in locale order."""
    if by in ("node", "collocate"):
        return rows.orderBy(F.expr(f"collate(`{by}`, 'UNICODE')"), "node", "collocate")
    return rows.orderBy(F.desc_nulls_last(by), "node", "collocate")
