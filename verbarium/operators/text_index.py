"""A positional inverted index for keyword in context, so that a search reads what may match instead of the whole corpus.

An index is a folder of four tables. `texts`: the corpus, each row with a place (a number) and a part. `postings`: for each term, place and block of 4,096 positions the term's positions in the
block, as distances from its start (small numbers, which Parquet packs to a few bits). `grams`: the terms by every three characters of theirs (very long terms under one mark); `terms`: each term, for shorter pieces. Each is laid out in folders by part or by the
hash of its key, written in ranges of (folder, term, place), so a term that is everywhere spans many tasks and files.

A query is taken apart into pieces of word characters. A piece that the query bounds on both sides is a term; others are looked up by their k-grams and compared with the
terms found. Pieces that follow each other must stand side by side, by their positions; what a glob's `*` or `?` separates must be in the same text. Only the folders of these terms, and then of the texts
that remain, are read; the texts are verified by the ordinary search, which makes the rows. Queries without word characters, and regular expressions, scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import ship, stage
from . import concordance

TERM = r"[\p{L}\p{M}\p{N}_]+"
BLOCK = 4096
FOLDERS = 64

#: Tasks that a folder is written by, and postings that a worker sends on at once.
SPREAD, ROWS = 8, 50_000

#: A term with more characters stands under one mark instead of its k-grams, of which it would have three for each character; all of these are compared with a piece.
GRAM, MOST_CHARS, LONG = 3, 64, ""


def fold(text: Column) -> Column:
    """Letters that a case-insensitive pattern takes for one another, as one."""
    return F.replace(F.lower(F.upper(text)), F.lit("̇"), F.lit(""))


def _folder(*keys: str, folders: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(folders)).cast("int")


@dataclass(frozen=True)
class Piece:
    text: str
    segment: int  # pieces of a segment stand side by side
    offset: int
    open_left: bool  # more characters of the term may come before
    open_right: bool
    gram: str  # of its k-grams the one in the middle
    folders: tuple[int, ...]  # where the piece is as a term, the gram, and the long terms


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text its terms with their positions by block; a text's own, so nothing moves for it."""
    for batch in batches:
        place, part, words = (batch.column(c) for c in ("place", "part", "words"))
        places, parts = place.to_pylist(), part.to_pylist()
        out: tuple[list, ...] = ([], [], [], [], [])
        for k in range(batch.num_rows):
            found: dict[tuple[str, int], list[int]] = {}
            for pos, term in enumerate(words[k].as_py()):
                found.setdefault((term, pos // BLOCK), []).append(pos % BLOCK)
            for (term, block), offsets in found.items():
                for column, value in zip(out, (term, places[k], parts[k], block, offsets)):
                    column.append(value)
            if len(out[0]) > ROWS or k == batch.num_rows - 1:
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int16()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["term", "place", "text_part", "block", "offsets"])
                out = ([], [], [], [], [])


def build(docs: DataFrame, path: str, folders: int = FOLDERS) -> TextIndex:
    """Writes the index of `docs` (with a column text) to a new folder."""
    spark = docs.sparkSession
    ship(spark)
    placed = docs.withColumn("place", F.monotonically_increasing_id())
    placed.withColumn("part", _folder("place", folders=folders)).repartition("part").write.partitionBy("part").parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")
    words = F.regexp_extract_all(fold(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0))
    lists = texts.select("place", "part", words.alias("words")).mapInArrow(_lists, "term string, place long, text_part int, block int, offsets array<short>")
    salt = F.pmod("place", F.lit(SPREAD))  # a term that is everywhere is written by several tasks
    lists.withColumn("folder", _folder("term", folders=folders)).repartition("folder", salt).sortWithinPartitions("folder", "term", "place").write.partitionBy("folder").parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").select("term").distinct().write.parquet(f"{path}/terms")
    terms = spark.read.parquet(f"{path}/terms").where(F.length("term") >= GRAM)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("term") - (GRAM - 1)), lambda k: F.substring(F.col("term"), k, F.lit(GRAM))))
    by_gram = terms.select("term", F.explode(F.when(F.length("term") > MOST_CHARS, F.array(F.lit(LONG))).otherwise(grams)).alias("gram")).withColumn("folder", _folder("gram", folders=folders))
    by_gram.repartition("folder").sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(f"{path}/grams")
    return TextIndex(spark, path, folders)


class TextIndex:
    def __init__(self, spark: SparkSession, path: str, folders: int = FOLDERS):
        self.spark, self.path, self.folders = spark, path, folders

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def pieces(self, query: str, match: str) -> list[Piece]:
        """What of a query can be looked up."""
        segments = re.split(r"[*?]+", query) if match == "glob" else [query]
        rows = self.spark.createDataFrame(list(enumerate(segments)), "no int, v string").withColumn("v", fold(F.col("v")))
        rows = rows.withColumns({"cut": F.regexp_extract_all("v", F.lit(TERM), F.lit(0)), "starts": F.col("v").rlike("^" + TERM), "ends": F.col("v").rlike(TERM + r"\z")})
        middle = lambda x: F.substring(x, F.greatest(F.floor((F.length(x) - GRAM) / 2).cast("int"), F.lit(0)) + 1, F.lit(GRAM))
        folder = lambda x: F.pmod(F.xxhash64(x), F.lit(self.folders)).cast("int")
        each = F.transform("cut", lambda x: F.struct(x.alias("text"), middle(x).alias("gram"), F.array(folder(x), folder(middle(x)), folder(F.lit(LONG))).alias("folders")))
        found = rows.select("no", "starts", "ends", each.alias("each")).collect()
        return [Piece(x.text, r.no, k, k == 0 and r.starts, k == len(r.each) - 1 and r.ends, x.gram, tuple(x.folders)) for r in found for k, x in enumerate(r.each)]

    def terms(self, piece: Piece) -> DataFrame:
        """folder, term: the terms that a piece can be in."""
        if not piece.open_left and not piece.open_right:
            return self.table("postings").where((F.col("folder") == piece.folders[0]) & (F.col("term") == piece.text)).select("folder", "term").distinct()
        held = self.table("terms")
        if len(piece.text) >= GRAM:
            held = self.table("grams").where(F.col("folder").isin(*piece.folders[1:]) & F.col("gram").isin(piece.gram, LONG)).select("term")
        if piece.open_left and piece.open_right:
            held = held.where(F.contains("term", F.lit(piece.text)))
        else:
            held = held.where(F.endswith("term", F.lit(piece.text)) if piece.open_left else F.startswith("term", F.lit(piece.text)))
        return held.withColumn("folder", _folder("term", folders=self.folders)).select("folder", "term")

    def candidates(self, query: str, match: str = "fixed") -> DataFrame | None:
        """place, part of the texts that may match; None where the index can't tell."""
        pieces = self.pieces(query, match) if match in ("fixed", "glob") else []
        if not pieces:
            return None
        each = [self.terms(p).withColumns({"segment": F.lit(p.segment), "piece": F.lit(p.offset)}) for p in pieces]
        terms = stage(reduce(DataFrame.unionByName, each), "terms")
        folders = [r.folder for r in terms.select("folder").distinct().collect()]  # of all folders at most
        found = self.table("postings").where(F.col("folder").isin(folders)).join(terms, ["folder", "term"])
        sizes = {s: sum(p.segment == s for p in pieces) for s in {p.segment for p in pieces}}
        alone = [s for s, n in sizes.items() if n == 1]
        both = found.where(F.col("segment").isin(alone)).select("place", "text_part", "segment").distinct()
        if len(alone) < len(sizes):
            joint = found.where(~F.col("segment").isin(alone)).select("place", "text_part", "segment", "piece", "block", F.explode("offsets").alias("o"))
            first = (F.col("block") * BLOCK + F.col("o") - F.col("piece")).alias("first")
            sized = F.create_map(*[F.lit(x) for s, n in sizes.items() for x in (s, n)])
            side = joint.groupBy("place", "text_part", "segment", first).agg(F.countDistinct("piece").alias("n")).where(F.col("n") == sized[F.col("segment")])
            both = both.unionByName(side.select("place", "text_part", "segment"))
        met = both.groupBy("place", "text_part").agg(F.countDistinct("segment").alias("n")).where(F.col("n") == len(sizes))
        return met.select("place", F.col("text_part").alias("part"))

    def texts(self, query: str, match: str = "fixed") -> DataFrame:
        """The rows of the corpus that may match; only their folders are read."""
        named = self.candidates(query, match)
        if named is None:
            return self.table("texts")
        named = stage(named, "candidates")
        parts = [r.part for r in named.select("part").distinct().collect()]  # of all folders at most
        return self.table("texts").where(F.col("part").isin(parts)).join(named.select("place"), "place", "left_semi")

    def search(self, query: str, match: str = "fixed", whole_word: bool = False, case_sensitive: bool = False, window: int = 5) -> DataFrame:
        """The rows of concordance.search()."""
        return concordance.search(self.texts(query, match), query, match, whole_word, case_sensitive, window)
