"""Graphs, names and places, charts, readers and writers, stages, streams."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from verbarium.operators import charts, documents, graph, names
from verbarium.plans import stages
from verbarium.plans.staging import running, shared_dir
from verbarium.sources import readers, sinks
from verbarium.streaming import text as streaming


@pytest.fixture
def make(spark):
    def f(entities, props):
        e = spark.createDataFrame([(i, t if isinstance(t, list) else [t]) for i, t in entities], graph.ENTITY)
        p = [(i, k, n, None if isinstance(v, tuple) else v, v[0] if isinstance(v, tuple) else None) for n, (i, k, v) in enumerate(props)]
        return e, spark.createDataFrame(p, graph.PROP)

    return f


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


# -- graphs ------------------------------------------------------------------------------------------------------------------------


def test_json_round_trip(spark):
    j = {"@graph": [{"@id": "./", "@type": "Dataset", "name": ["a \"b\"", "c"], "hasPart": {"@id": "x.txt"}}, {"@id": "x.txt", "@type": ["File", "Y"], "size": 3}]}
    e, p = graph.from_json(spark.createDataFrame([(json.dumps(j),)], "text string"))
    assert {r.id: r.types for r in e.collect()} == {"./": ["Dataset"], "x.txt": ["File", "Y"]}
    assert sorted((r.id, r.key, r.ord, r.value, r.ref) for r in p.collect()) == [("./", "hasPart", 0, None, "x.txt"), ("./", "name", 0, 'a "b"', None), ("./", "name", 1, "c", None), ("x.txt", "size", 0, "3", None)]
    back = {r.id: json.loads(r.json) for r in graph.to_json(e, p).collect()}
    assert back["./"] == {"@id": "./", "@type": ["Dataset"], "name": ['a "b"', "c"], "hasPart": [{"@id": "x.txt"}]}
    assert [(r.id, r.key, r.source) for r in graph.reverse(p).collect()] == [("x.txt", "hasPart", "./")]


def test_remove_outputs(make):
    e, p = make([("./", "Dataset"), ("./_outputs/csv/a.csv", "File"), ("_outputs/csv2/b.csv", "File"), ("#n", "Annotation"), ("#m", "Annotation")], [("./", "hasPart", ("_outputs/csv/a.csv",)), ("./", "hasPart", ("_outputs/csv2/b.csv",)), ("#n", "annotationBody", ("./_outputs/csv/a.csv",)), ("#m", "annotationBody", ("_outputs/csv2/b.csv",))])
    e2, p2 = graph.remove_outputs(e, p, ["_outputs/csv"])
    assert ids(e2) == ["#m", "./", "_outputs/csv2/b.csv"] and sorted(r.ref for r in p2.collect()) == ["_outputs/csv2/b.csv"] * 2


def test_replace_dot_slash(make):
    e, p = make([("./a", "File"), ("a", "File"), ("./", "Dataset")], [("./", "hasPart", ("./a",)), ("./", "hasPart", ("a",))])
    e, p = graph.replace_dot_slash(e, p, ["a"])
    assert ids(e) == ["./", "a"] and [r.ref for r in p.collect()] == ["a"]


def test_clear_scan(make):
    e, p = make([("./", "Dataset"), ("ro-crate-metadata.json", "CreativeWork"), ("f.txt", "File"), ("#p", "Person"), ("#q", "Person"), ("#r", "Place"), ("#s", "Place")], [("./", "hasPart", ("f.txt",)), ("f.txt", "author", ("#p",)), ("#p", "home", ("#r",)), ("./", "author", ("#q",)), ("#q", "home", ("#s",))])
    assert ids(graph.clear_scan(e, p)[0]) == ["#q", "#s", "./", "ro-crate-metadata.json"]


def test_merge_graphs(make, spark):
    a = make([("./", "Dataset"), ("#x", "Person")], [("#x", "name", "X"), ("#x", "age", "1")])
    b = make([("./", "Dataset"), ("#x", "Person"), ("#y", "Person")], [("#x", "name", "Z"), ("#y", "memberOf", ("./",)), ("./", "name", "root"), ("#x", "note", " ")])
    e, p, counts = graph.merge_graphs(*a, *b, root="arcp://r")
    assert ids(e) == ["#x", "#y", "./"] and tuple(counts.first()) == (1, 1, 1)
    assert sorted((r.id, r.key, r.value or r.ref) for r in p.collect()) == [("#x", "age", "1"), ("#x", "name", "Z"), ("#y", "memberOf", "arcp://r")]
    seeded = graph.seed_root(make([], [("./", "name", "mine")])[1], make([], [("./", "name", "theirs"), ("./", "license", "L"), ("./", "hasPart", ("x",))])[1])
    assert sorted((r.key, r.value) for r in seeded.collect()) == [("license", "L"), ("name", "mine")]
    wanted = spark.createDataFrame([("#x", "#y"), ("#x", "#none"), ("#y", "#none")], "id string, ref string")
    p2, missing = graph.apply_membership(e, make([], [("#x", "pcdm:hasMember", ("#old",)), ("#y", "pcdm:hasMember", ("#old",))])[1], wanted)
    assert sorted((r.id, r.ref) for r in p2.collect()) == [("#x", "#y"), ("#y", "#old")] and missing.count() == 2


def test_warnings(make, spark):
    e, p = make([("./", "Dataset"), ("#a", "X")], [("./", "hasPart", ("#a",)), ("./", "about", ("#b",)), ("./", "license", ("http://l",)), ("#a", "odd", "1"), ("#a", "rdfs:label", "1")])
    assert [(r.key, r.ref) for r in graph.dangling(e, p).collect()] == [("about", "#b")]
    known = spark.createDataFrame([("hasPart",), ("about",), ("license",)], "key string")
    assert [r.key for r in graph.unknown_properties(e, p, known).collect()] == ["odd"]
    m = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b")], "ord int, message string")
    assert [(r.message, r.n) for r in graph.counted_messages(m).collect()] == [("b", 2), ("a", 1)]


def test_publish(make):
    e = [("./", "Dataset")] + [(x, "RepositoryCollection") for x in "AB"] + [(x, "RepositoryObject") for x in ("a1", "a2", "b1", "m")] + [(x, "File") for x in ("f1", "f2", "f3")]
    p = [("./", "hasPart", ("A",)), ("./", "pcdm:hasMember", ("B",)), ("A", "hasPart", ("a1",)), ("A", "hasPart", ("a2",)), ("B", "hasPart", ("b1",)), ("a2", "custom:publish", "False"), ("A", "custom:publish", " TRUE "), ("b1", "hasPart", ("f1",)),
         ("f2", "isPartOf", ("b1",)), ("f2", "custom:publish", "true"), ("A", "hasPart", ("m",)), ("B", "hasPart", ("m",)), ("m", "hasPart", ("f3",)), ("f3", "hasPart", ("A",))]
    out = {r.id: r.kept for r in graph.publish_subset(*make(e, p)).collect()}
    # m is first met below B, as hasPart of the root comes before pcdm:hasMember; so it is published with A
    assert out == {"A": True, "a1": True, "a2": False, "m": True, "f3": True, "B": True, "b1": True, "f1": False, "f2": True}
    kept, props = graph.published(*make(e, p))
    assert ids(kept) == ["./", "A", "B", "a1", "b1", "f2", "f3", "m"] and not [r for r in props.collect() if r.ref in ("a2", "f1")]


def test_publish_takes_the_first_path_of_a_depth_first_walk(make):
    import random

    for seed in range(4):
        r = random.Random(seed)
        n = 25
        links = sorted({(a, b) for a, b in ((r.randrange(n), r.randrange(1, n)) for _ in range(60)) if a != b})
        own = {k: r.choice([True, False]) for k in range(1, n) if r.random() < 0.3}
        name = lambda k: "./" if k == 0 else f"#{k}"
        props = [(name(a), "hasPart", (name(b),)) for a, b in links] + [(name(k), "custom:publish", str(v)) for k, v in own.items()]
        seen, parent, keep = set(), {}, set()

        def visit(k, inherited, up):
            if k in seen:
                return
            seen.add(k)
            parent[k] = up
            now = own.get(k, inherited)
            if k and now:
                keep.add(k)
            for a, b in links:
                if a == k:
                    visit(b, now, k)

        visit(0, None, None)
        for k in list(keep):
            while parent[k] and parent[k] not in keep:
                k = parent[k]
                keep.add(k)
        got = graph.publish_subset(*make([(name(k), "X") for k in range(n)], props)).collect()
        assert {r_.id for r_ in got if r_.kept} == {name(k) for k in keep} and {r_.id for r_ in got} == {name(k) for k in seen - {0}}


def test_publish_never_stops_short(make):
    chain = ["./", "a", "b", "c"]
    props = [(x, "hasPart", (y,)) for x, y in zip(chain, chain[1:])] + [("a", "custom:publish", "true"), ("c", "custom:publish", "false")]
    with pytest.raises(ValueError):
        graph.publish_subset(*make([(x, "X") for x in chain], props), most_depth=2)
    assert {r.id: r.kept for r in graph.publish_subset(*make([(x, "X") for x in chain], props)).collect()} == {"a": True, "b": True, "c": False}


def test_publish_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    from verbarium.plans import ranking

    n, rounds = 100_000, []
    staged = ranking.stage
    monkeypatch.setattr(ranking, "stage", lambda df, name: rounds.append(name) or staged(df, name))
    ident = lambda c: F.concat(F.lit("#"), c.cast("string"))
    k = spark.range(1, n + 1)
    up = F.when(F.col("id") == 1, "./").otherwise(ident(F.col("id") - 1))
    none = F.lit(None).cast("string")
    entity = k.select(ident(F.col("id")).alias("id"), F.array(F.lit("X")).alias("types"))
    link = k.select(up.alias("id"), F.lit("hasPart").alias("key"), F.lit(0).alias("ord"), none.alias("value"), ident(F.col("id")).alias("ref"))
    flags = spark.createDataFrame([("#10", "true"), (f"#{n // 2}", "false"), (f"#{n // 2 + 5}", "true"), (f"#{n // 2 + 9}", "false")], "id string, value string")
    link = link.union(flags.select("id", F.lit(graph.PUBLISH).alias("key"), F.lit(0).alias("ord"), "value", none.alias("ref")))
    out = graph.publish_subset(entity, link)
    assert out.agg(F.count(F.lit(1)), F.max("depth"), F.sum(F.col("kept").cast("int")), F.sum(F.col("effective").cast("int"))).first()[:] == (n, n, n // 2 + 8, n // 2 - 10 + 4)
    assert len(rounds) <= 2 * 19


def test_publish_ignores_what_hangs_on_rings_elsewhere(make):
    props = [("./", "hasPart", ("a",)), ("a", "custom:publish", "true"), ("x", "hasPart", ("y",)), ("y", "hasPart", ("x",)), ("y", "hasPart", ("z",)), ("gone", "hasPart", ("w",)), ("z", "hasPart", ("m",)), ("a", "hasPart", ("m",))]
    got = graph.publish_subset(*make([(x, "X") for x in ["./", *"axyzwm"]], props)).collect()
    assert {(r.id, r.parent, r.depth, r.kept) for r in got} == {("a", "./", 1, True), ("m", "a", 2, True)}


def test_long_custom_properties_stay_apart(make):
    long = ["z" * 1500 + x for x in "ab"]
    _, p = graph.custom_properties(*make([("x", "File")], [("x", f"custom:{k}", "1") for k in long]))
    assert {r.value for r in p.where("key = 'name'").collect()} == {"Z" + k[1:] for k in long}


def test_sheets_and_geometry(make, spark):
    e, p = make([("f1", "File"), ("f2", "File"), ("#ann", "Person")], [("f1", "name", "old")])
    sheet = spark.createDataFrame([(1, "f1", "one", "Ann / Bo", "Mount Isa"), (2, "f1", "two", " ", None), (3, "f9", "x", "", "")], "row_no long, `@id` string, title string, who string, place string")
    out = graph.merge_sheet(e, p, sheet, [{"source": "title", "target": "name"}, {"source": "who", "target": "author", "type": "Person"}, {"source": "place", "target": "about", "type": "Place"}, {"source": "gone", "target": "x"}])
    assert ids(out["entity"]) == ["#ann", "#bo", "#place-mount-isa", "f1", "f2"] and ids(out["unmatched"]) == ["f9"] and ids(out["unmatched_files"]) == ["f2"] and out["missing"].count() == 1
    got = sorted((r.id, r.key, r.value or r.ref) for r in out["prop"].collect())
    assert ("f1", "name", "two") in got and ("f1", "author", "#ann") in got and ("f1", "author", "#bo") in got and ("f1", "name", "old") not in got and ("#place-mount-isa", "name", "Mount Isa") in got
    places = spark.createDataFrame([("#place-mount-isa", "Mount Isa", -20.7, 139.5), ("#place-x", "X", None, 1.0)], "id string, name string, latitude double, longitude double")
    e2, p2, n = graph.set_geometry(out["entity"], out["prop"], places)
    assert n.first().enriched == 1 and "#location-mount-isa" in ids(e2) and {(r.id, r.value) for r in p2.where("key = 'asWKT'").collect()} == {("#location-mount-isa", "POINT(139.5 -20.7)")}
    rows = spark.createDataFrame([(0, "@context", '{"a": "http://a/"}'), (1, "a:", "http://other/"), (2, "b", "https://b/"), (3, "c", "text")], "ord int, key string, value string")
    assert {(r.prefix, r.uri) for r in graph.prefixes(rows).collect()} == {("a", "http://a/"), ("b", "https://b/")}
    e3, p3 = graph.custom_properties(*make([("x", "File")], [("x", "custom:fileSize_kb", "1")]))
    assert "File Size kb" in {r.value for r in p3.where("key = 'name'").collect()} and e3.count() == 2


def test_tables(make, spark):
    e, p = make([("#o", "Obj"), ("#k", "Obj"), ("#p", "Person"), ("t.txt", "File")], [("#o", "name", "n1"), ("#o", "name", "n2"), ("#o", "author", ("#p",)), ("#p", "name", "Ann"), ("#o", "ldac:mainText", ("./t.txt",))])
    texts = spark.createDataFrame([("t.txt", "two  words")], "path string, text string")
    t = {r.id: r for r in graph.table_of(e, p, "Obj", ["name"], {"author": ["name"]}, texts, "ldac:mainText", True).collect()}
    assert (t["#o"]["name"], t["#o"]["author_name"], t["#o"]["text"], t["#k"]["name"]) == ("n1; n2", "Ann", "two words", None)
    found = [(r.type, r.key) for r in graph.inspect(e, p).collect()]
    assert graph.default_text_property(found, "Obj") == "ldac:mainText"
    settings = spark.createDataFrame([("Obj", "name", True)], "type string, key string, selected boolean")
    assert {(r.key, r.selected) for r in graph.merge_settings(graph.inspect(e, p), settings).where("type = 'Obj'").collect()} == {("name", True), ("author", False), ("ldac:mainText", False)}
    here, gone = graph.local_files(e, p, spark.createDataFrame([("t.txt",)], "path string"))
    assert here.count() == 1 and gone.count() == 0
    assert graph.relabel(p, {"#p": "Bo"}).where("id = '#p'").first().value == "Bo"


# -- names and places --------------------------------------------------------------------------------------------------------------


def test_names(spark):
    lines = spark.createDataFrame(list(enumerate(["\ufeffOlga D’Arcy", "   ", "# who came", "Timo  Berg", "Ina", "Olga", "OLGA", "Per Holm"])), "line_no int, line string")
    people = names.people_list(lines)
    docs = spark.createDataFrame([("d", "Then olga d'ARCY sat by Timo\nBerg at Inari; Ina's boat. Olga rowed. Per sang."), ("e", None)], "doc string, text string")
    assert [r.name for r in names.find_names(docs, people).orderBy("first_pos").collect()] == ["Olga D’Arcy", "Timo Berg", "Ina", "Olga"]
    found = names.candidate_names(spark.createDataFrame([("d", "Mrs. Mary Grant's home, Palm Island. Dr M. at Ayr")], "doc string, text string"))
    assert [r.name for r in found.orderBy("first_pos").collect()] == ["Mary Grant", "Palm Island"]
    assert [r.name for r in names.without_listed(found, names.people_list(spark.createDataFrame([(0, "mary grant")], "line_no int, line string"))).collect()] == ["Palm Island"]


def test_link_names(make, spark):
    e, p = make([("#john_smith", "Person")], [("f", "mentions", ("#x",))])
    found = spark.createDataFrame([("f", "John Smith"), ("f", "Mary O'Brien"), ("f", "John Smith"), ("g", "Mary O'Brien")], "doc string, name string")
    e, p, counts = names.link_names(e, p, found, "mentions", "Person")
    assert tuple(counts.first()) == (1, 1, 3) and ids(e) == ["#john_smith", "#mary_o_brien", "f", "g"]
    assert sorted((r.id, r.ord, r.ref) for r in p.where("key = 'mentions'").collect()) == [("f", 0, "#x"), ("f", 1, "#john_smith"), ("f", 2, "#mary_o_brien"), ("g", 0, "#mary_o_brien")]


GAZETTEER = [
    (0, "Cairns", -17.0, 145.7, "QLD", "County", "GA", 0), (1, "Cairns", -16.9, 145.8, "Queensland", "Populated place", "GA", 0), (2, "Cairns", -37.0, 144.0, "VIC", "Parish", "GA", 0), (3, "Dyirbal Creek", -17.5, 145.5, "QLD", "Stream", "GHAP", 1),
    (4, "Garnet Mountain", -17.6, 145.1, "QLD", "Mountain", "GA", 0), (5, "No place", None, 1.0, "QLD", "Town", "GA", 0), (6, "Mt Garnet", -17.7, 145.2, "QLD", "Town", "GHAP", 1),
]


def test_places(spark):
    g = spark.createDataFrame(GAZETTEER, "record_no long, name string, latitude double, longitude double, region string, kind string, provider string, provider_order int")
    ask = spark.createDataFrame([("cairns",), ("Dyirbal",), ("Mount Garnet",), ("Nowhere",), ("No place",)], "name string")
    out = {r.name: r for r in names.resolve_places(ask, g).collect()}
    assert set(out) == {"cairns", "Dyirbal", "Mount Garnet"}
    assert (out["cairns"].latitude, out["cairns"].exact, out["cairns"].rank) == (-16.9, True, 405) and (out["Dyirbal"].matched, out["Dyirbal"].exact) == ("Dyirbal Creek", False)
    assert out["Mount Garnet"].matched == "Mt Garnet" and out["Mount Garnet"].wkt == "POINT(145.2 -17.7)"
    assert {r.latitude for r in names.resolve_places(ask, g, "Victoria").where("name = 'cairns'").collect()} == {-37.0}
    assert {r.name for r in names.resolve_places(ask, g, exact_only=True).collect()} == {"cairns", "Mount Garnet"}
    cache = names.resolve_places(ask.where("name = 'cairns'"), g).withColumn("provider", F.lit("cached"))
    both, new = names.with_cache(ask, cache, g)
    assert {(r.name, r.provider) for r in both.collect()} == {("cairns", "cached"), ("Dyirbal", "GHAP"), ("Mount Garnet", "GHAP")} and new.count() == 2
    v = spark.createDataFrame([("mt ISA",), ("Palm lsland",), ("Foo Mountain",), ("",)], "n string").select("n", names.variants(F.col("n")).alias("v"))
    assert {r.n: r.v for r in v.collect()} == {"mt ISA": ["Mt Isa", "Mount Isa", "Isa Mountain"], "Palm lsland": ["Palm Island"], "Foo Mountain": ["Foo Mountain", "Mount Foo", "Mt Foo"], "": []}
    payload = spark.createDataFrame([('{"features": [{"properties": {"name": "A", "state": "QLD"}, "geometry": {"coordinates": [1.5, -2.5]}}]}',), ('{"results": [{"placename": "B", "latitude": 1.0, "longitude": 2.0}]}',)], "json string")
    assert sorted((r.name, r.latitude, r.longitude) for r in names.flatten_records(payload, "GA").collect()) == [("A", -2.5, 1.5), ("B", 1.0, 2.0)]


def test_languages_in_names(spark):
    langs = spark.createDataFrame([("Y1", "Dyirbal", ["Jirrbal"]), ("E2", "North", []), ("K3", "Kuku Yalanji", None)], "code string, name string, alternate_names array<string>")
    files = spark.createDataFrame([("1", "a/Dyirbal_x dyirbal.txt"), ("2", "kuku yalanji story.cha"), ("3", "North.txt"), ("4", "x Jirrbal.doc"), ("5", "Dyirbals.txt")], "id string, path string")
    assert sorted((r.id, r.language_id) for r in names.languages_in_names(files, langs).collect()) == [("1", "#AUSTLANG_Y1"), ("2", "#AUSTLANG_K3")]
    assert len(names.languages_in_names(files, langs, True).collect()) == 3


# -- charts ------------------------------------------------------------------------------------------------------------------------


def test_charts(spark):
    t = spark.createDataFrame([(0, "a", "10"), (1, "b", "20"), (2, "c", "n/a")], "k long, x string, y string")
    g = charts.chart_geometry(t, "y").first()
    assert (g.n_points, g.skipped, g.y_min, g.y_max, g.label_every) == (2, 1, 0, 20, 1) and g.ticks == [0, 5, 10, 15, 20]
    labels = spark.createDataFrame([(4000.0,), (1550.0,), (12.345,), (7.0,), (0.0,)], "v double").select(charts.tick_label(F.col("v")).alias("l"))
    assert [r.l for r in labels.collect()] == ["4k", "1.6k", "12.35", "7", "0"]
    assert charts.default_y(t, "k") == "y" and [r.value for r in charts.chart_points(t, "k", "x", "y").collect()] == [10, 20]
    rows, counts = charts.map_points(spark.createDataFrame([("-33.8", "151.2", "4"), ("unknown", "1", "1"), (None, "", "1"), ("1", "2", "0")], "a string, b string, w string"), "a", "b", "w")
    assert [tuple(r) for r in rows.collect()] == [(-33.8, 151.2, 4.0), (1.0, 2.0, 1.0)] and tuple(counts.first()) == (2, 2)
    x, y = charts.mercator(F.lit(0.0), F.lit(0.0), 2, 1, 1)
    assert tuple(spark.range(1).select(x, y).first()) == (256.0, 256.0)
    assert charts.best_zoom(rows) >= 1 and charts.best_zoom(rows.where("false")) == 0 and charts.best_zoom(rows.limit(1)) == 20
    square = spark.createDataFrame([(0.0, 0.0), (0.0, 45.0), (1.0, 3.0)], "latitude double, longitude double")
    assert charts.best_zoom(square) == 4 and charts.best_zoom(square, target=511) == 3  # an eighth of the world is 512 pixels at zoom 4
    assert charts.plot_rows(spark.createDataFrame([(" ", "x ")], "a string, b string")).first().asDict() == {"a": None, "b": "x "}
    assert charts.time_units("utcyearmonthdatehours") == ["year", "month", "date", "hours"]
    for bad in (lambda: charts.time_units("yearx"), lambda: charts.histogram_arguments({"xType": "nominal"}), lambda: charts.histogram_arguments({"xType": "temporal"})):
        with pytest.raises(ValueError):
            bad()
    assert charts.histogram_arguments({"xType": "quantitative", "step": 5, "nice": True}) == ({"xType": "quantitative", "step": 5}, ["nice is ignored"])
    assert charts.embed_options({"a": {"b": 1, "c": 2}}, {"a": {"c": 3}}) == {"a": {"b": 1, "c": 3}} and charts.color_scale({"x": "red"}) == {"domain": ["x"], "range": ["red"]}
    bars = charts.bar_count(spark.createDataFrame([("b",), ("a",), ("b",), ("z",)], "x string"), "x")
    assert [r.x for r in charts.sorted_bars(bars, "x").collect()][0] == "b" and [r.x for r in charts.sorted_bars(bars, "x", ["z", "a"]).collect()] == ["z", "a", "b"]


def test_plot_configurations(spark):
    made = charts.default_config(["x/ships.csv", "y/ships.csv", "harbours"])
    assert made["plots"]["datasets"] == {"ships": {"source": "x/ships.csv"}, "ships 2": {"source": "y/ships.csv"}, "harbours": {"source": "harbours"}} and charts.check_config(made) == []
    good = {"dataset": {"name": "ships"}, "makeSpec": {"plotFunction": "boxPlot", "args": {"xVar": "port"}}, "plotCardSpan": 2}
    own = {"dataset": {"name": "harbours"}, "customSpec": {"mark": "bar"}, "config": {}, "span": "3"}
    later = {"dataset": {"name": "ships"}, "makeSpec": {"plotFunction": "notYetKnown", "args": {}}, "extra": 1}
    assert charts.check_config({"plots": {**made["plots"], "plotList": [good, own, later]}}) == []
    bad = [{**good, "dataset": {"name": "none"}}, {**good, "dataset": "ships"}, {"dataset": {"name": "ships"}}, {**good, "makeSpec": {"plotFunction": "boxPlot"}}, {**own, "config": []}, {**good, "plotCardSpan": 4}, 5]
    for plot in bad:
        assert len(charts.check_config({"plots": {**made["plots"], "plotList": [plot]}})) == 1, plot
    assert charts.check_config({}) and len(charts.check_config({"plots": {"datasets": [], "plotList": {}, "globalConfig": 1}})) == 3
    t = spark.createDataFrame([("a", 1)], "port string, n int")
    found, missing = charts.bind_datasets({"plots": {"datasets": {"a": "t", "b": {"source": "t"}, "c": {"path": "t"}, "d": {"source": "u"}, "e": None}}}, {"t": t})
    assert list(found) == ["a", "b", "c"] and missing == [("d", "u"), ("e", "")]


def test_box_of_odd_groups(spark):
    rows = [("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 7.0), (None, 1.0), (None, 3.0), ("c", None)]
    got = {r.g: tuple(r)[1:] for r in charts.box(spark.createDataFrame(rows, "g string, y double"), "g", "y").collect()}
    assert got == {"a": (5, 2.0, 3.0, 4.0, 1.0, 4.0), "b": (1, 7.0, 7.0, 7.0, 7.0, 7.0), None: (2, 1.5, 2.0, 2.5, 1.0, 3.0)}


# -- files -------------------------------------------------------------------------------------------------------------------------


def office(**parts) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = office(**{"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>text [sound: a.wav]</w:t><w:tab/><w:t>b</w:t></w:r></w:p>'
                 '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})  # fmt: skip


def test_folder_crate(spark):
    rows = ["p before", "h1 Boats", "p All kinds.", "h2 Sails", "p Red [image: a.png]", "tr mast\tspar", "h3 Ropes", "p Hemp", "h3 Knots", "tr reef\tbowline", "tr bend", "h2 Oars", "p [sound: gone.wav]"]
    blocks = [("sea/x/one.docx", k, *r.split(" ", 1)) for k, r in enumerate(rows)] + [("sea/two.docx", 0, "h2", "Only"), ("land/three.docx", 0, "p", "no heading"), ("land/notes.docx", 0, "h2", "left out")]
    files = spark.createDataFrame([("sea/x/media/a.png",)], "path string")
    entity, prop = documents.folder_crate(spark.createDataFrame(blocks, "path string, order int, tag string, text string"), files)
    e = {r.id: r.types[0] for r in entity.collect()}
    parts = {}
    for r in prop.where("key = 'hasPart'").orderBy("id", "ord").collect():
        parts.setdefault(r.id, []).append(r.ref)
    one = "#sea-x-one-docx"
    assert parts["./"] == ["#derivedContent", "#sourceDocuments"] and parts["#derivedContent"] == ["#land", "#sea"] and parts["#sea"] == ["#sea-two-docx", one]
    assert parts["#sourceDocuments-sea"] == ["sea/two.docx", "sea/x/one.docx"] and parts["#land"] == ["#land-three-docx"]
    chapter = lambda k: f"{one}-chapter-{k}"
    assert parts[one] == [chapter(1), chapter(2), chapter(4)] and parts[chapter(1)] == [f"{chapter(1)}-row-1", "sea/x/media/a.png", chapter(3)] and parts[chapter(3)] == [f"{chapter(3)}-row-1", f"{chapter(3)}-row-2"]
    said = {(r.id, r.key): r.value for r in prop.where("value is not null").collect()}
    assert said[one, "name"] == "Boats" and said["#sea-two-docx", "name"] == "two" and said[chapter(3), "name"] == "Knots" and said[f"{chapter(3)}-row-2", "text"] == "bend" and said[chapter(4), "position"] == "4"
    assert said[one, "text"].startswith("All kinds.\n\n---\n\nSails\n\nRed [image: a.png]\n\n---\n\nRopes\n\nHemp") and said["#land-three-docx", "text"] == ""
    assert e[chapter(2)] == "bibo:Chapter" and e["sea/x/media/a.png"] == "File" and e["#sourceDocuments"] == "custom:SourceDocumentsCollection" and not [i for i in e if "notes" in i]


def test_office_files(spark):
    files = spark.createDataFrame([("a.docx", bytearray(DOCX)), ("bad.docx", bytearray(b"no"))], "path string, content binary")
    blocks = readers.docx(files)
    assert sorted((r.path, r.order, r.tag, r.text) for r in blocks.collect()) == [("a.docx", 0, "h1", "One"), ("a.docx", 1, "p", "text [sound: a.wav]\tb"), ("a.docx", 2, "tr", "x\ty"), ("bad.docx", 0, "error", "")]
    assert readers.docx_text(blocks).first().text == "One\n\ntext [sound: a.wav]\tb\n\nx\ty\n\n"
    assert {(r.order, r.chapter_no, r.chapter) for r in documents.chapters(blocks).where("path = 'a.docx'").collect()} == {(0, 1, "One"), (1, 1, "One"), (2, 1, "One")}
    assert [(r.kind, r.target) for r in documents.media(blocks).collect()] == [("sound", "a.wav")] and documents.preflight(blocks).count() == 2
    e, p = documents.assemble(blocks.where("tag <> 'error'"), "c")
    assert ids(e) == ["#a-docx", "#a-docx-1", "#c", "a.docx"] and p.where("key = 'hasPart'").count() == 1
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = office(**{"xl/workbook.xml": f'<workbook {s} {r}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><x Id="r1" Target="worksheets/s.xml"/></R>',
                     "xl/sharedStrings.xml": f"<sst {s}><si><t>@id</t></si><si><r><t>na</t></r><r><t>me</t></r></si></sst>",
                     "xl/worksheets/s.xml": f'<worksheet {s}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>x</t></is></c><c r="C2"><v>3</v></c></row></sheetData></worksheet>'})
    rows = readers.xlsx(spark.createDataFrame([("b.xlsx", bytearray(book))], "path string, content binary"))
    assert [r.asDict() for r in readers.sheet_table(rows, "S").collect()] == [{"row_no": 2, "@id": "x", "column 2": "", "name": "3"}]


def test_text_readers(spark, tmp_path):
    for name, content in {"a.txt": "S:\r\n\nx".encode("utf-16"), "b.txt": b"\xef\xbb\xbfone", "c.txt": b"\xfe\xff\x00S\x00:", "t.csv": b'text,speakerID\n"a, ""b""",X\n,\n', "l.csv": "\ufeffWord,Sentiment\r\nExcellent,joy\r\n".encode(), "bad.csv": b"word,sentiment\nx,odd\n", "d.cha": b"@Begin\n*CHI:\thello\n\tmore\n*MOT: yes\n@End\n", "c.docx": b"x"}.items():
        (tmp_path / name).write_bytes(content)
    lines = {(r.source, r.line_no, r.text) for r in readers.text_lines(spark, str(tmp_path)).collect()}
    assert lines == {("a.txt", 1, "S:"), ("a.txt", 3, "x"), ("b.txt", 1, "one"), ("c.txt", 1, "S:")}
    assert [(r.speaker, r.text) for r in readers.chat_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [("CHI", "hello more"), ("MOT", "yes")]
    assert [(r.speaker, r.text) for r in readers.csv_corpus(spark, str(tmp_path / "t.csv")).orderBy("line_no").collect()] == [("X", 'a, "b"'), ("", "")]
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.csv").write_text('text,Speaker\nfirst,X\n"two\nlines",Y\n')
    (folder / "b.csv").write_text("speakerID,note,text\nZ,n,third\n")
    (folder / "c.csv").write_text("text,Speaker\n")
    (folder / "d.csv").write_text("m,n\np,q\n")
    broken = tmp_path / "broken.csv"
    broken.write_text('"speaker\nid",text,"no\nte",more\nA,said,n,m\n')
    (r,) = readers.csv_table(spark, str(broken)).collect()
    assert list(r.asDict().values()) == ["A", "said", "n", "m", 1]
    got = sorted((r.source, r.line_no, r.speaker, r.text) for r in readers.csv_corpus(spark, str(folder)).collect())
    assert got == [("a.csv", 1, "X", "first"), ("a.csv", 2, "Y", "two\nlines"), ("b.csv", 1, "Z", "third"), ("d.csv", 1, "", "p q")]
    t = readers.csv_table(spark, str(folder))
    assert sorted(t.columns) == ["Speaker", "m", "n", "note", "row_no", "speakerID", "text"]
    assert [(r.row_no, r.text, r.note, r.Speaker) for r in t.where("note is not null").collect()] == [(1, "third", "n", None)]
    assert [(r.word, r.joy, r.trust) for r in readers.lexicon_csv(spark, str(tmp_path / "l.csv")).collect()] == [("excellent", 1, 0)]
    for bad in ("bad.csv", "t.csv"):
        with pytest.raises(ValueError):
            readers.lexicon_csv(spark, str(tmp_path / bad))
    chosen, skipped = readers.transcript_files(readers.scan_folder(spark, str(tmp_path)))
    assert sorted(r.file_name for r in chosen.collect()) == ["a.txt", "b.txt", "c.docx"] and [r.warning for r in skipped.collect()] == ["skipped: c.txt"]
    assert readers.cleanable(readers.scan_folder(spark, str(tmp_path))).count() == 3 and readers.readable_for_names(readers.scan_folder(spark, str(tmp_path))).count() == 4
    assert readers.merge_config(None, {"mapping": {"a": "b", "c": {"target": "d", "type": "Place"}}}, []) == [{"source": "a", "target": "b", "type": ""}, {"source": "c", "target": "d", "type": "Place"}]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"', None), ("x", "y", 1.005)], "a string, b string, v double").coalesce(1)
    sinks.write_csv(df, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['"a,b","q""",', "a,b,v", "x,y,1.005"]
    texts = spark.createDataFrame([("d1", "one\ntwo"), ("d2", "x")], "doc string, text string")
    skipped = sinks.write_files(texts, str(tmp_path / "files"), existing=spark.createDataFrame([("d2",)], "doc string"))
    assert [r.doc for r in skipped.collect()] == ["d2"] and [r.doc for r in spark.read.text(str(tmp_path / "files")).select("doc").distinct().collect()] == ["d1"]
    assert [r.v for r in sinks.fixed(df, 2, ["v"]).collect()] in (["", "1.00"], ["", "1.01"])
    assert sinks.export_name("concordance", query="The *Économy*!") == "wordfinder-the-conomy.csv" and sinks.export_name("ngrams", n=3) == "ngrams-n3.csv"
    assert sinks.parameters(n=2, nodes=["a", "b"]) == "n: 2\nnodes: a, b"


# -- stages, sums, streams ---------------------------------------------------------------------------------------------------------


def test_stages():
    log = lambda name: lambda c: {"log": [*c.get("log", []), name]}
    taps = [stages.Tap("write", "crate:write", 10, log("write")), stages.Tap("docx", "crate:build", 5, log("docx"), True, lambda c: c.get("docx", False)), stages.Tap("plain", "crate:build", 10, log("plain"), True), stages.Tap("docx", "crate:write", 5, log("docx write"), True, lambda c: c.get("docx", False)),
            stages.Tap("off", "crate:build", 20, log("off"), active=lambda c: False)]
    assert stages.check(taps) == [] and stages.run(taps, {})["log"] == ["plain", "write"] and stages.run(taps, {"docx": True})["log"] == ["docx", "docx write", "write"]
    assert stages.check([*taps, stages.Tap("x", "crate:write", 10, log("x"))]) and stages.check([stages.Tap("y", "odd", 1, log("y"))])
    with pytest.raises(ValueError):
        stages.run([stages.Tap("y", "odd", 1, log("y"))], {})


def test_running_sums(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    want, sums, counts = {}, {}, {}
    for k in range(1000):
        want[k] = (sums.get(k % 3, 0), counts.get(k % 3, 0))
        sums[k % 3], counts[k % 3] = sums.get(k % 3, 0) + k % 7, counts.get(k % 3, 0) + 1
    assert {r.o: (r.before, r.seq) for r in running(df, ["g"], ["o"], "v").collect()} == want
    total = running(df, [], ["o"], "v").where("o = 999").first()
    assert (total.before, total.seq) == (sum(k % 7 for k in range(999)), 999) and shared_dir(spark)


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a b a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 05:00:00", "z"), ("2024-01-01 09:00:00", "end")], "ts string, text string").select(F.col("ts").cast("timestamp"), "text")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming.read_documents(spark, str(tmp_path / "in"), "ts timestamp, text string")
    q = streaming.write(streaming.token_counts(stream, "ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    out = {(r.window.start.hour, r.token, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (0, "a", 3) in out and (0, "b", 1) in out
