"""Text cleaning: seven prebuilt rules, custom patterns, replacements, lower case, white space, always in that order."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import JS_SPACE, PatternError, check_pattern, java_pattern, java_replacement, literal_pattern, round_half_up, trim, units

#: fixed values: the prebuilt patterns, in the order in which they are applied
RULES = {
    "tags": "<[^>]*>",
    "nonalpha": r"[^\p{L}\p{N} ]",
    "punct": rf"[^\p{{L}}\p{{N}}{JS_SPACE}]",
    "numbers": r"[0-9]+",
    "urls": rf"(?i)https?://[^{JS_SPACE}]+|www[.][^{JS_SPACE}]+",
    "emails": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}",
    "speaker": rf"(\[[A-Z0-9_]+\][{JS_SPACE}]*:?|<[A-Z0-9$_-]+>[{JS_SPACE}]*(<#>[{JS_SPACE}]*)?)",
}


@dataclass
class Replacement:
    find: str
    replace: str = ""
    is_regex: bool = False
    ignore_case: bool = False


@dataclass
class Options:
    prebuilt: list[str] = field(default_factory=list)
    custom: list[str] | str = field(default_factory=list)
    replacements: list[Replacement] = field(default_factory=list)
    lowercase: bool = False
    whitespace: bool = False


def custom_patterns(custom: list[str] | str) -> list[str]:
    lines = custom.split("\n") if isinstance(custom, str) else custom
    return [x.strip() for x in lines if x.strip()]


def _usable(spark, pattern: str, flags: str = "") -> str | None:
    try:
        java = java_pattern(pattern, flags)[0]
    except PatternError:
        return None
    return java if spark is None or check_pattern(spark, java) is None else None


def clean(text: Column, options: Options, spark=None) -> Column:
    """The cleaned text as one expression. Patterns that don't compile are left out (asked of `spark`, if given)."""
    out = F.coalesce(text, F.lit(""))
    for name, pattern in RULES.items():
        if name in options.prebuilt:
            out = F.regexp_replace(out, pattern, "")
    for pattern in custom_patterns(options.custom):
        if (java := _usable(spark, pattern)) is not None:
            out = F.regexp_replace(out, java, "")
    for r in options.replacements:
        if r.find == "":
            continue
        if r.is_regex:
            if (java := _usable(spark, r.find, "i" if r.ignore_case else "")) is not None:
                out = F.regexp_replace(out, java, java_replacement(r.replace))
        elif r.ignore_case:
            verbatim = r.replace.replace("\\", r"\\").replace("$", r"\$")
            out = F.regexp_replace(out, "(?iu)" + literal_pattern(r.find), verbatim)
        else:
            out = F.replace(out, F.lit(r.find), F.lit(_static_replacement(r.find, r.replace)))
    if options.lowercase:
        out = F.lower(out)
    if options.whitespace:
        out = F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), "\n{3,}", "\n\n")
        out = trim(F.array_join(F.transform(F.split(out, "\n"), trim), "\n"))
    return out


def _static_replacement(find: str, replace: str) -> str:
    """Dollar patterns in the replacement of a literal stand for things that are known beforehand."""
    return replace.replace("$$", "\0").replace("$&", find).replace("\0", "$")


def stats(before: Column, after: Column) -> dict[str, Column]:
    a, b = units(F.coalesce(before, F.lit(""))), units(F.coalesce(after, F.lit("")))
    removed = F.greatest(a - b, F.lit(0)).cast("long")
    percent = F.when(a > 0, round_half_up(removed / a * 100, 1)).otherwise(0.0)
    return {"original_length": a, "cleaned_length": b, "removed": removed, "percent_removed": percent}


def clean_documents(df: DataFrame, options: Options, text: str = "text") -> DataFrame:
    """`df` with its text cleaned, and the four figures of stats()."""
    done = df.withColumn("_cleaned", clean(F.col(text), options, df.sparkSession))
    return done.withColumns(stats(F.col(text), F.col("_cleaned"))).withColumn(text, F.col("_cleaned")).drop("_cleaned")


def destination(path: Column, folder: str = "cleaned", placement: str = "copy", naming: str = "preserve", suffix: str = "_cleaned", prefix: str = "cleaned_") -> Column:
    """Where the cleaned copy of a file goes."""
    source = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", "")
    if placement == "overwrite":
        return source
    name = F.regexp_extract(source, r"([^/]*)\z", 1)
    name = F.when(name == "", "untitled.txt").otherwise(name)
    extension = F.regexp_extract(name, r"(\.[^.]+)\z", 1)
    base = F.substring(name, F.lit(1), F.length(name) - F.length(extension))
    target = F.concat(base, F.lit(suffix or "_cleaned"), extension) if naming == "suffix" else F.concat(F.lit(prefix or "cleaned_"), name) if naming == "prefix" else name
    into = (folder or "").replace("\\", "/").strip().strip("/")
    if into:
        return F.concat(F.lit(into + "/"), target)
    parent = F.regexp_extract(source, r"^(.*)/[^/]*\z", 1)
    return F.when(parent == "", target).otherwise(F.concat(parent, F.lit("/"), target))


def clean_files(files: DataFrame, options: Options, **where) -> DataFrame:
    """path, content -> path, target, text, figures, status: a row for each file, also for one that fails."""
    rows = files.withColumn("text", F.when(F.col("content").isNotNull(), F.col("content").cast("string")))
    out = clean_documents(rows, options)
    return out.select("path", destination(F.col("path"), **where).alias("target"), "text", "original_length", "cleaned_length", "removed", "percent_removed",
                      F.when(F.col("content").isNull(), "error").otherwise("cleaned").alias("status"))


def manifest(options: Options, figures: list[dict]) -> str:
    """A record of what was done, for the folder of the results."""
    return json.dumps({"options": asdict(options), "files": figures}, ensure_ascii=False, indent=2)


def straighten(x: Column) -> Column:
    """Trimmed, with typographic quotes and dashes as ASCII ones."""
    return F.translate(trim(x), "“”‘’—–", "\"\"''--")


TIMECODE = rf"\([{JS_SPACE}]*~?[0-9]+:[0-9]+[{JS_SPACE}]*\)"


def strip_timecodes(x: Column) -> tuple[Column, Column]:
    """The text without time codes, and the time codes."""
    return F.regexp_replace(x, TIMECODE, ""), F.regexp_extract_all(x, F.lit(TIMECODE), F.lit(0))


def characters(df: DataFrame, text: str = "text") -> DataFrame:
    """character, code (U+XXXX), n, of all code points, in order."""
    each = df.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "")).alias("character")).where("character <> ''")
    counted = each.groupBy("character").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("character", F.format_string("U+%04X", F.ascii("character")).alias("code"), "n")


def named_characters(df: DataFrame, text: str = "text") -> DataFrame:
    """characters() with Unicode names; the few distinct characters alone pass through Python."""
    @F.pandas_udf("string")
    def name(c: pd.Series) -> pd.Series:
        import unicodedata

        return c.map(lambda x: unicodedata.name(x, ""))

    return characters(df, text).withColumn("name", name("character"))
