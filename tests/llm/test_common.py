"""Joins that meet hot keys, and rows that stay by their place."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from verbarium.llm.common import join_groups, rows_kept
from verbarium.plans.staging import stage


def test_join_groups_is_a_join(spark):
    rows = stage(spark.range(5000).select(F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 900).cast("string"))).alias("key"), F.col("id").alias("v")), "rows")
    groups = stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least")), "groups")
    want = Counter(map(tuple, rows.join(groups, "key").select("key", "v", "n", "least").collect()))
    for small in (None, F.length("key") < 2, F.length("key") < 100):
        got = join_groups(rows, groups, "key", "n", small=small).select("key", "v", "n", "least")
        assert Counter(map(tuple, got.collect())) == want
    empty = join_groups(rows.where("false"), groups.where("false"), "key", "n")
    assert empty.count() == 0 and set(empty.columns) == {"key", "v", "n", "least"}


def test_rows_stay_by_place(spark, odd, none):
    """Repeated rows and rows without doc_id are rows like any other; all columns come back."""
    kept = rows_kept(odd, lambda rows: rows.where("text is not null and length(text) > 2 and text not like 'x%'"))
    want = Counter(map(str, odd.where("text is not null and length(text) > 2 and text not like 'x%'").collect()))
    assert kept.columns == odd.columns and Counter(map(str, kept.collect())) == want and max(want.values()) == 2
    assert rows_kept(odd, lambda rows: rows.where("false")).count() == 0 and rows_kept(none, lambda rows: rows).count() == 0
    first = rows_kept(odd.repartition(5), lambda rows: rows.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text"))
    assert Counter(r.text for r in first.collect()) == Counter({r.text: 1 for r in odd.collect()})
