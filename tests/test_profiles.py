from __future__ import annotations

import re

import pytest

from verbarium.operators import profiles as P

ENTITIES = [
    ("#a", ["Person"]), ("#b", ["Person", "Place"]), ("#c", ["Author"]), ("#d", ["Work"]), ("#e", ["Work"]), ("#f", []), (None, ["Person"]), ("#g", ["Place"]), ("#g", ["Place", "Town"]), ("#h", None),
]
PROPS = [
    ("#a", "name", 0, "Ann", None), ("#a", "name", 1, "Anna", None), ("#a", "born", 0, "1990-02", None), ("#b", "name", 0, " ", None), ("#b", "born", 0, "soon", None), ("#b", "lat", 0, "x", None),
    ("#c", "name", 0, "C", None), ("#c", "site", 0, "not a url", None), ("#c", "site", 1, "https://c.example", None), ("#c", "born", 0, None, "#a"),
    ("#d", "by", 0, None, "#c"), ("#d", "by", 1, None, "#g"), ("#d", "by", 2, None, "#nobody"), ("#d", "by", 3, None, "https://elsewhere"), ("#d", "by", 4, "someone", None), ("#d", "kind", 0, "essay", None),
    ("#e", "kind", 0, "Novel", None), ("#e", "extra", 0, "1", None), ("#f", "name", 0, "f", None), ("#lost", "name", 0, "x", None), ("#g", None, 0, "x", None), ("#g", "lat", 0, "1.5e3", None), ("#e", "pages", 0, "12", None), ("#d", "pages", 0, "12.5", None),
]
PROFILE = P.Profile(
    rules=(
        P.Rule("Person", "name", 1, 1, "text"), P.Rule("Person", "born", kind="date"), P.Rule("Author", "site", 1, None, "url"), P.Rule("Place", "lat", 1, 1, "number"),
        P.Rule("Work", "by", 1, 4, "entity", targets=("Person",)), P.Rule("Work", "kind", 1, 1, values=("novel", "essay"), pattern="[a-z]+"), P.Rule("Work", "pages", kind="integer"),
    ),
    parents={"Author": ("Person",)}, closed=frozenset({"Work"}), least={"Place": 2, "Town": 1, "Ship": 1},
)


def tables(spark, entities=ENTITIES, props=PROPS):
    return spark.createDataFrame(entities, "id string, types array<string>"), spark.createDataFrame(props, "id string, key string, ord int, value string, ref string")


def brute(entities, props, profile):
    classes = {}
    for i, types in entities:
        for t in types or []:
            if i is not None:
                classes.setdefault(i, set()).update(profile.lineage(t))
    own = {}
    for i, types in entities:
        own.setdefault(i, set()).update(types or [])
    out = []
    for i, named in classes.items():
        for r in profile.rules:
            if r.cls not in named:
                continue
            values = [(v, ref) for j, k, _, v, ref in props if (j, k) == (i, r.key) and (ref is not None or (v or "").strip())]
            found = []
            if len(values) < r.least:
                found.append(("missing", len(values)))
            if r.most is not None and len(values) > r.most:
                found.append(("too many", len(values)))
            outside = lambda ref: ref.startswith(profile.outside)
            if r.kind == "entity" or r.targets:
                found.append(("dangling", sum(ref is not None and ref not in own and not outside(ref) for _, ref in values)))
            if r.kind == "entity":
                found.append(("kind", sum(ref is None for _, ref in values)))
            elif r.kind != "any":
                found.append(("kind", sum(ref is not None or not re.fullmatch(P.KINDS[r.kind], v) for v, ref in values)))
            if r.targets:
                found.append(("target", sum(ref in own and not any(set(r.targets) & set(profile.lineage(t)) for t in own[ref]) for _, ref in values if ref is not None)))
            if r.values:
                found.append(("value", sum((v or ref) not in r.values for v, ref in values)))
            if r.pattern:
                found.append(("pattern", sum(not re.fullmatch(r.pattern, v or ref) for v, ref in values)))
            out += [(i, r.cls, r.key, p, n) for p, n in found if n or p == "missing"]
        if named & profile.closed:
            known = {r.key for r in profile.rules if r.cls in named}
            keys = {k for j, k, _, v, ref in props if j == i and k is not None and k not in known and (ref or (v or "").strip())}
            out += [(i, min(named & profile.closed), k, "unknown property", sum(1 for j, q, _, v, ref in props if (j, q) == (i, k))) for k in keys]
    for c, least in profile.least.items():
        n = sum(c in named for named in classes.values())
        if n < least:
            out.append((None, c, None, "too few entities", n))
    return sorted(out, key=str)


def test_validation_against_brute_force(spark):
    rows = P.validate(*tables(spark), PROFILE).collect()
    got = sorted(((r.id, r["class"], r.property, r.problem, r.found) for r in rows), key=str)
    assert got == brute(ENTITIES, PROPS, PROFILE)
    assert {r.problem for r in rows} == {*P.PROBLEMS, "too few entities"}


def test_the_property_table_is_read_once(spark, tmp_path):
    entity, prop = tables(spark)
    prop.write.parquet(f"{tmp_path}/prop")
    entity.write.parquet(f"{tmp_path}/entity")
    profile = P.Profile(tuple(P.Rule("Person", f"k{n}", 0, 1, "number") for n in range(50)))
    plan = P.validate(spark.read.parquet(f"{tmp_path}/entity"), spark.read.parquet(f"{tmp_path}/prop"), profile)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("key#") and plan.count("Relation [id") <= 4  # the two halves of the property table, and the entities twice


def test_conforming_and_empty_graphs(spark):
    entity, prop = tables(spark, [("#a", ["Person"])], [("#a", "name", 0, "Ann", None)])
    out = P.validate(entity, prop, P.Profile((P.Rule("Person", "name", 1, 1),)))
    assert P.conforms(out).first() == (True, 0)
    assert P.validate(entity.limit(0), prop.limit(0), P.Profile(())).count() == 0
    bad = P.validate(entity, prop.limit(0), P.Profile((P.Rule("Person", "name", 1, 1),)))
    assert bad.select(P.message().alias("m")).first().m == "#a (Person): name: missing, 0 found, expected at least 1"
    assert P.conforms(bad).first() == (False, 1)


def test_profiles_as_tables(spark):
    rows = spark.createDataFrame([("Work", "by", 1, 4, "entity", "Person | Group", None, None), ("Person", "name", None, None, None, "", "a|b", "[ab]")], "class string, property string, min int, max int, kind string, targets string, values string, pattern string")
    assert set(P.profile_of(rows).rules) == {P.Rule("Work", "by", 1, 4, "entity", ("Person", "Group")), P.Rule("Person", "name", values=("a", "b"), pattern="[ab]")}
    for wrong in (P.Rule("A", "b", kind="odd"), P.Rule("A", "b", 2, 1), P.Rule("A", "b", -1)):
        with pytest.raises(ValueError):
            P.Profile((wrong,))
    assert P.Profile((), {"A": ("B",), "B": ("C", "A")}).lineage("A") == ["A", "B", "C"]
