"""Validation of metadata graphs against a profile: rules of classes, compiled to one aggregate over the property table and one join.

A rule says of a class's property how many values it has, of what kind, and of which classes what it refers to is. All conditions of a profile that look at a single value
(kinds, target classes, listed values, patterns) become one flag each, whatever number of rules uses them; the property table is read once and counts every flag for each entity and property,
first in the map tasks, so an entity with a third of all properties is one row for each of these from then on. The obligations of each entity, that is the rules of its
classes, meet those counts by one join. Profiles are documents written by people: their rules are a bounded list (`MOST_RULES`) and the only thing broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RULES = 10_000

#: What a value must look like to be of a kind. `entity`: a reference; all others: a value of this form; `any`: either.
KINDS: dict[str, str | None] = {
    "any": None,
    "entity": None,
    "text": r"(?s).*",
    "number": r"[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?",
    "integer": r"[+-]?[0-9]+",
    "boolean": "true|false|True|False",
    "date": r"[0-9]{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12][0-9]|3[01])(T[0-9:.]+(Z|[+-][0-9]{2}:?[0-9]{2})?)?)?)?",
    "url": r"[a-zA-Z][a-zA-Z0-9+.-]*:[^ ]+",
}
PROBLEMS = ("missing", "too many", "kind", "target", "dangling", "value", "pattern", "unknown property")


@dataclass(frozen=True)
class Rule:
    cls: str
    key: str
    least: int = 0
    most: int | None = None
    kind: str = "any"
    targets: tuple[str, ...] = ()  # a reference's entity has one of these classes
    values: tuple[str, ...] = ()
    pattern: str | None = None  # of the whole value


@dataclass(frozen=True)
class Profile:
    rules: tuple[Rule, ...]
    parents: dict[str, tuple[str, ...]] = field(default_factory=dict)  # class: the classes whose rules it takes over
    closed: frozenset[str] = frozenset()  # classes whose entities have no other properties than those of their rules
    least: dict[str, int] = field(default_factory=dict)  # entities of a class that the graph has at least
    outside: tuple[str, ...] = ("http:", "https:")  # beginnings of references that leave the graph

    def __post_init__(self) -> None:
        if len(self.rules) > MOST_RULES:
            raise ValueError(f"a profile has at most {MOST_RULES} rules")
        for r in self.rules:
            if r.kind not in KINDS:
                raise ValueError(f"{r.cls}.{r.key}: unknown kind {r.kind}")
            if r.least < 0 or (r.most is not None and r.most < r.least):
                raise ValueError(f"{r.cls}.{r.key}: from {r.least} to {r.most} values")

    def lineage(self, cls: str) -> list[str]:
        """The class and all that it takes rules from."""
        out = [cls]
        for c in out:
            out += [p for p in self.parents.get(c, ()) if p not in out]
        return out

    def classes(self) -> set[str]:
        return {r.cls for r in self.rules} | set(self.parents) | {p for ps in self.parents.values() for p in ps} | self.closed | set(self.least)

    def descendants(self, classes: Iterable[str]) -> tuple[str, ...]:
        """The classes that count as one of `classes`."""
        wanted = set(classes)
        return tuple(sorted(wanted | {c for c in self.classes() if wanted & set(self.lineage(c))}))


def profile_of(rows: DataFrame, **more: object) -> Profile:
    """A profile from a table of rules: class, property, min, max, kind, targets, values (both separated by `|`), pattern."""
    found = rows.limit(MOST_RULES + 1).collect()
    split = lambda s: tuple(x.strip() for x in (s or "").split("|") if x.strip())
    rules = (Rule(r["class"], r["property"], int(r["min"] or 0), None if r["max"] is None else int(r["max"]), r["kind"] or "any", split(r["targets"]), split(r["values"]), r["pattern"]) for r in found)
    return Profile(tuple(sorted(rules, key=repr)), **more)


def _flags(profile: Profile) -> dict[tuple, Column]:
    """The profile's conditions on single values, each once: true where the value breaks it."""
    value, ref, types = F.col("value"), F.col("ref"), F.coalesce("target_types", F.array().cast("array<string>"))
    outside = F.lit(False)
    for start in profile.outside:
        outside = outside | F.coalesce(ref.startswith(start), F.lit(False))
    out: dict[tuple, Column] = {("dangling",): ref.isNotNull() & F.col("target_types").isNull() & ~outside}
    for r in profile.rules:
        if r.kind == "entity":
            out["kind", r.kind] = ref.isNull()
        elif r.kind != "any":
            out["kind", r.kind] = ref.isNotNull() | ~F.coalesce(value.rlike(f"^(?:{KINDS[r.kind]})$"), F.lit(False))
        if r.targets:
            wanted = profile.descendants(r.targets)
            out["target", r.targets] = ref.isNotNull() & F.col("target_types").isNotNull() & ~F.arrays_overlap(types, F.array(*map(F.lit, wanted)))
        if r.values:
            out["value", r.values] = ~F.coalesce(F.coalesce("value", "ref").isin(*r.values), F.lit(False))
        if r.pattern:
            out["pattern", r.pattern] = ~F.coalesce(F.coalesce("value", "ref").rlike(rf"\A(?:{r.pattern})\z"), F.lit(False))
    return out


def _counts(entity: DataFrame, prop: DataFrame, flags: dict[tuple, Column]) -> DataFrame:
    """id, key, n, broken (for each flag the number of values that break it); values without text or reference aren't counted."""
    stated = prop.where(F.col("ref").isNotNull() | (F.trim(F.coalesce("value", F.lit(""))) != "")).select("id", "key", "value", "ref")
    targets = entity.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("types"))).alias("target_types")).withColumnRenamed("id", "target")
    met = stated.where("ref IS NOT NULL").join(targets, F.col("ref") == F.col("target"), "left").drop("target")
    met = met.unionByName(stated.where("ref IS NULL").withColumn("target_types", F.lit(None).cast("array<string>")))
    each = met.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f).alias(f"f{k}") for k, f in enumerate(flags.values())])
    return each.select("id", "key", "n", F.array(*[f"f{k}" for k in range(len(flags))]).alias("broken"))


def validate(entity: DataFrame, prop: DataFrame, profile: Profile) -> DataFrame:
    """id, class, property, problem, found (how many values), expected: a row for each rule that an entity breaks, and for each way in which it does.

    `problem` is one of PROBLEMS, or `too few entities` of a class (id null). An entity of several classes keeps the rules of each; a rule that two of
    its classes share through a parent is checked once, for the parent."""
    spark = entity.sparkSession
    flags = _flags(profile)
    number = {name: k for k, name in enumerate(flags)}
    rows = []
    for r in profile.rules:
        tests = [("dangling", ("dangling",), "an entity of the graph")] if r.kind == "entity" or r.targets else []
        tests += [("kind", ("kind", r.kind), r.kind)] if r.kind != "any" else []
        tests += [("target", ("target", r.targets), "|".join(r.targets))] if r.targets else []
        tests += [("value", ("value", r.values), "|".join(r.values))] if r.values else []
        tests += [("pattern", ("pattern", r.pattern), r.pattern)] if r.pattern else []
        rows.append((r.cls, r.key, r.least, r.most, [(p, number[f], e) for p, f, e in tests]))
    rules = spark.createDataFrame(rows, "class string, key string, least long, most long, tests array<struct<problem: string, flag: int, expected: string>>")
    above = spark.createDataFrame([(c, p) for c in sorted(profile.classes()) for p in profile.lineage(c)] or [("", "")], "type string, class string")
    typed = entity.where("id IS NOT NULL").select("id", F.explode("types").alias("type"))
    of_class = typed.join(F.broadcast(above), "type").select("id", "class").distinct()
    owed = of_class.join(F.broadcast(rules), "class")  # at most MOST_RULES rows
    counts = _counts(entity, prop, flags)
    met = owed.join(counts, ["id", "key"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    none = F.lit(None).cast("struct<problem: string, found: bigint, expected: string>")
    said = lambda problem, found, expected: F.struct(F.lit(problem).alias("problem") if isinstance(problem, str) else problem.alias("problem"), found.cast("long").alias("found"), expected.cast("string").alias("expected"))
    few = F.when(F.col("n") < F.col("least"), said("missing", F.col("n"), F.concat(F.lit("at least "), F.col("least")))).otherwise(none)
    many = F.when(F.col("n") > F.col("most"), said("too many", F.col("n"), F.concat(F.lit("at most "), F.col("most")))).otherwise(none)
    broken = F.transform("tests", lambda t: said(t["problem"], F.get("broken", t["flag"]), t["expected"]))
    all_ = F.filter(F.concat(F.array(few, many), broken), lambda x: x["found"].isNotNull() & ((x["problem"].isin("missing", "too many")) | (x["found"] > 0)))
    out = met.select("id", "class", F.col("key").alias("property"), F.explode(all_).alias("v")).select("id", "class", "property", "v.*")
    if profile.closed:
        out = out.unionByName(_unknown(of_class, counts, profile))
    if profile.least:
        out = out.unionByName(_too_few(of_class, profile))
    return out


def _unknown(of_class: DataFrame, counts: DataFrame, profile: Profile) -> DataFrame:
    """Properties of entities of closed classes that no rule of any of their classes names."""
    spark = of_class.sparkSession
    names = spark.createDataFrame([(r.cls, r.key) for r in profile.rules], "class string, key string").distinct()
    known = of_class.join(F.broadcast(names), "class").select("id", "key").distinct()
    shut = of_class.where(F.col("class").isin(*profile.closed)).groupBy("id").agg(F.min("class").alias("class"))
    return shut.join(counts, "id").join(known, ["id", "key"], "left_anti").select(
        "id", "class", F.col("key").alias("property"), F.lit("unknown property").alias("problem"), F.col("n").alias("found"), F.lit("a property of the profile").alias("expected")
    )


def _too_few(of_class: DataFrame, profile: Profile) -> DataFrame:
    wanted = of_class.sparkSession.createDataFrame(sorted(profile.least.items()), "class string, least long")
    have = of_class.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    met = F.broadcast(wanted).join(have, "class", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).where("n < least")
    none = F.lit(None).cast("string")
    return met.select(none.alias("id"), "class", none.alias("property"), F.lit("too few entities").alias("problem"), F.col("n").alias("found"), F.concat(F.lit("at least "), F.col("least")).alias("expected"))


def message() -> Column:
    """A sentence for a row of validate()."""
    where = F.when(F.col("id").isNull(), F.col("class")).otherwise(F.concat("id", F.lit(" ("), "class", F.lit(")"), F.coalesce(F.concat(F.lit(": "), "property"), F.lit(""))))
    return F.concat(where, F.lit(": "), "problem", F.lit(", "), F.col("found").cast("string"), F.lit(" found, expected "), "expected")


def conforms(violations: DataFrame) -> DataFrame:
    """One row: ok, issues."""
    return violations.agg(F.count(F.lit(1)).alias("issues")).select((F.col("issues") == 0).alias("ok"), "issues")
