"""Metadata graphs as two tables: entity (id, types) and prop (id, key, ord, value, ref); a property has a value or refers to an entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug, trim
from ..plans.ranking import forest_sums, forest_walk
from ..plans.staging import running, stage

ENTITY, PROP = "id string, types array<string>", "id string, key string, ord int, value string, ref string"
#: fixed values: what is structure in a scanned folder
STRUCTURAL = ["File", "RepositoryObject", "RepositoryCollection"]
MEMBERS, MEMBER_OF = ["hasPart", "hasMember", "pcdm:hasMember"], ["isPartOf", "memberOf", "pcdm:memberOf"]
DESCRIPTOR, ROOT = "ro-crate-metadata.json", "./"
PUBLISH = "custom:publish"
#: fixed values: what a root keeps to itself, references that leave the graph, types that only define words, the base of custom properties
ROOT_ONLY = ["hasPart", "pcdm:hasMember", "conformsTo"]
EXTERNAL = ["conformsTo", "license", "encodingFormat", "url", "sameAs", "identifier", "isBasedOn", "citation"]
VOCABULARY = ["rdf:Property", "rdfs:Class", "DefinedTerm", "DefinedTermSet", "ItemList", "PropertyValue"]
CUSTOM_BASE = "arcp://name,custom/terms#"


# -- JSON in and out -----------------------------------------------------------------------------------------------------------------


def from_json(texts: DataFrame, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """entity and prop from JSON-LD texts (one graph each). Values that are no strings keep their JSON spelling."""
    nodes = texts.select(F.explode(F.from_json(F.get_json_object(column, "$['@graph']"), "array<string>")).alias("j"))
    maps = nodes.select(F.from_json("j", "map<string,string>").alias("m"))
    listed = lambda s: F.when(F.ltrim(s).startswith("["), F.from_json(s, "array<string>")).otherwise(F.array(s))
    entity = maps.select(F.col("m")["@id"].alias("id"), F.transform(listed(F.col("m")["@type"]), lambda t: F.regexp_replace(t, '^"|"$', "")).alias("types"))
    pairs = maps.select(F.col("m")["@id"].alias("id"), F.explode("m").alias("key", "raw")).where(~F.col("key").isin("@id", "@type"))
    one = pairs.select("id", "key", F.posexplode(listed(F.col("raw"))).alias("ord", "v"))
    ref = F.get_json_object("v", "$['@id']")
    prop = one.select("id", "key", "ord", F.when(ref.isNull(), F.col("v")).alias("value"), ref.alias("ref"))
    return entity, prop


def to_json(entity: DataFrame, prop: DataFrame) -> DataFrame:
    """id, json: one object for each entity; a graph is their list."""
    item = F.when(F.col("ref").isNotNull(), F.concat(F.lit('{"@id":'), F.to_json(F.struct(F.col("ref").alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("ref").alias("v")))) - 6), F.lit("}")))
    quoted = F.to_json(F.struct(F.coalesce("value", F.lit("")).alias("v")))
    item = item.otherwise(quoted.substr(F.lit(6), F.length(quoted) - 6))
    lists = prop.withColumn("item", item).groupBy("id", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "item"))), lambda x: x["item"]), ",").alias("items"))
    body = lists.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), "key", F.lit('":['), "items", F.lit("]")))), ",").alias("body"))
    head = F.concat(F.lit('{"@id":"'), "id", F.lit('","@type":'), F.to_json("types"))
    return entity.join(body, "id", "left").select("id", F.concat(head, F.when(F.col("body").isNotNull(), F.concat(F.lit(","), "body")).otherwise(""), F.lit("}")).alias("json"))


def reverse(prop: DataFrame) -> DataFrame:
    """Who points at an entity: id, key, source."""
    return prop.where("ref is not null").select(F.col("ref").alias("id"), "key", F.col("id").alias("source"))


# -- removing and renaming -----------------------------------------------------------------------------------------------------------


def plain_id(x: Column | str) -> Column:
    return F.regexp_replace(F.col(x) if isinstance(x, str) else x, r"^\./", "")


def _without(entity: DataFrame, prop: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without some entities (column id) and every reference to them."""
    gone = doomed.select(plain_id("id").alias("g")).distinct()
    e = entity.join(gone, plain_id(entity["id"]) == F.col("g"), "left_anti")
    p = prop.join(gone, plain_id(prop["id"]) == F.col("g"), "left_anti")
    return e, p.join(gone, plain_id(p["ref"]) == F.col("g"), "left_anti")


def remove_outputs(entity: DataFrame, prop: DataFrame, folders: list[str]) -> tuple[DataFrame, DataFrame]:
    """Without the entities below some folders, references to them, and annotations that have no body left."""
    prefixes = [f.removeprefix("./").rstrip("/") + "/" for f in folders]
    below = reduce(lambda a, b: a | b, [plain_id("id").startswith(p) for p in prefixes], F.lit(False))
    e, p = _without(entity, prop, entity.where(below))
    bodies = p.where("key = 'annotationBody'").select("id")
    empty = e.where(F.array_contains("types", "Annotation")).join(bodies, "id", "left_anti")
    return _without(e, p, empty)


def replace_dot_slash(entity: DataFrame, prop: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """Plain ids instead of `./` ones, in entities and references; what becomes equal is merged."""
    fix = lambda c: F.when(F.col(c).isin([f"./{i}" for i in ids]), plain_id(c)).otherwise(F.col(c))
    e = entity.withColumn("id", fix("id")).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("types"))).alias("types"))
    p = prop.withColumns({"id": fix("id"), "ref": fix("ref")})
    return e, p.groupBy("id", "key", "value", "ref").agg(F.min("ord").alias("ord")).select("id", "key", "ord", "value", "ref")


def clear_scan(entity: DataFrame, prop: DataFrame, root: str = ROOT, descriptor: str = DESCRIPTOR, structural: list[str] = STRUCTURAL) -> tuple[DataFrame, DataFrame]:
    """Without structure, the root's members, and then all that nothing refers to, until nothing changes. Each round is staged."""
    kept = F.col("id").isin(root, descriptor)
    e = entity.where(kept | ~F.arrays_overlap("types", F.array(*map(F.lit, structural))))
    p = prop.join(e.select("id"), "id", "left_semi").where(~((F.col("id") == root) & F.col("key").isin(MEMBERS)))
    e, p = stage(e, "entities"), stage(p, "props")
    count = e.count()
    while True:
        used = p.where("ref is not null").select(F.col("ref").alias("id")).distinct()
        e = stage(e.where(kept).unionByName(e.where(~kept).join(used, "id", "left_semi")), "entities")
        p = stage(p.join(e.select("id"), "id", "left_semi"), "props")
        now = e.count()
        if now == count:
            return e, p
        count = now


# -- merging -------------------------------------------------------------------------------------------------------------------------


def seed_root(prop: DataFrame, source: DataFrame, root: str = ROOT, source_root: str = ROOT) -> DataFrame:
    """The root's gaps filled with what the source's root states; structure is left out."""
    new = source.where((F.col("id") == source_root) & ~F.col("key").isin(ROOT_ONLY))
    have = prop.where(F.col("id") == root).select("key").distinct()
    return prop.unionByName(new.join(have, "key", "left_anti").withColumn("id", F.lit(root)).select("id", "key", "ord", "value", "ref"))


def merge_graphs(entity: DataFrame, prop: DataFrame, source_entity: DataFrame, source_prop: DataFrame, root: str = ROOT, source_root: str = ROOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities of the source added or enriched: a property that it states replaces the old one, others stay. memberOf its root becomes memberOf
    ours. The third frame is one row: added, enriched, remapped."""
    skip = [DESCRIPTOR, ROOT, source_root]
    se = source_entity.where(~F.col("id").isin(skip) & F.col("id").isNotNull())
    sp = source_prop.where(~F.col("id").isin(skip) & ((F.trim(F.coalesce("value", F.lit(""))) != "") | F.col("ref").isNotNull()))
    moved = (F.col("key") == "memberOf") & F.col("ref").isin(ROOT, source_root) & (F.col("ref") != root)
    sp = sp.withColumn("moved", moved).withColumn("ref", F.when(moved, root).otherwise(F.col("ref")))
    stated = sp.select("id", "key").distinct()
    e = entity.join(se.select("id", F.col("types").alias("t2")), "id", "full").select("id", F.coalesce("t2", "types").alias("types"))
    p = prop.join(stated, ["id", "key"], "left_anti").unionByName(sp.drop("moved"))
    lists = lambda d: d.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("ord", "value", "ref"))).alias("v"))
    differs = lists(sp.drop("moved")).alias("n").join(lists(prop).alias("o"), ["id", "key"], "left").where(~F.col("n.v").eqNullSafe(F.col("o.v"))).select("id").distinct()
    retyped = se.alias("n").join(entity.alias("o"), "id").where(F.array_sort("n.types") != F.array_sort("o.types")).select("id")
    old = entity.select("id")
    enriched = differs.union(retyped).distinct().join(old, "id", "left_semi").agg(F.count(F.lit(1)).alias("enriched"))
    added = se.join(old, "id", "left_anti").agg(F.count(F.lit(1)).alias("added"))
    counts = sp.agg(F.count_if("moved").alias("remapped"))
    return e, p, counts.select(added.scalar().alias("added"), enriched.scalar().alias("enriched"), "remapped")


def apply_membership(entity: DataFrame, prop: DataFrame, wanted: DataFrame, key: str = "pcdm:hasMember") -> tuple[DataFrame, DataFrame]:
    """wanted: id, ref. An entity's members become those wanted that exist; if none does, the old ones stay. Second frame: those missing."""
    there = wanted.join(entity.select(F.col("id").alias("ref")), "ref", "left_semi")
    missing = wanted.join(entity.select(F.col("id").alias("ref")), "ref", "left_anti")
    changed = there.select("id").distinct().withColumn("changed", F.lit(True))
    kept = prop.join(changed, "id", "left").where(~((F.col("key") == key) & F.coalesce("changed", F.lit(False)))).drop("changed")
    order = F.row_number().over(Window.partitionBy("id").orderBy("ref")) - 1
    return kept.unionByName(there.select("id", F.lit(key).alias("key"), order.cast("int").alias("ord"), F.lit(None).cast("string").alias("value"), "ref")), missing


def dangling(entity: DataFrame, prop: DataFrame, external: list[str] = EXTERNAL) -> DataFrame:
    """id, key, ref of references to nothing."""
    refs = prop.where(F.col("ref").isNotNull() & ~F.col("key").isin(*external))
    return refs.join(entity.select(F.col("id").alias("ref")), "ref", "left_anti").select("id", "key", "ref")


def unknown_properties(entity: DataFrame, prop: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """id, key of properties outside a vocabulary (column key) that aren't rdf(s) terms; entities that define words, and the descriptor, are left out."""
    judged = entity.where(~F.arrays_overlap("types", F.array(*map(F.lit, VOCABULARY))) & (F.col("id") != DESCRIPTOR)).select("id")
    used = prop.where(~F.col("key").rlike("^rdfs?:")).join(judged, "id", "left_semi").select("id", "key").distinct()
    return used.join(vocabulary.select("key"), "key", "left_anti").select("id", "key")


def counted_messages(messages: DataFrame, most: int = 40) -> DataFrame:
    """message, n in the order of first appearance; the cap is that of the report."""
    return messages.groupBy("message").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")).orderBy("first").limit(most)


# -- spreadsheets --------------------------------------------------------------------------------------------------------------------


def entity_id(kind: str, value: Column) -> Column:
    """The id of an entity made from a name: `#john_smith`, `#place-mount-isa`."""
    s = slug(value)
    if kind == "Place":
        return F.concat(F.lit("#place-"), F.when(s == "", "place").otherwise(s))
    return F.concat(F.lit("#"), F.when(s == "", "entity").otherwise(F.replace(s, F.lit("-"), F.lit("_"))))


def geometry_id(place_id: Column, name: Column) -> Column:
    s = slug(name)
    return F.when(place_id.startswith("#place-"), F.concat(F.lit("#location-"), F.substring(place_id, F.lit(8), F.length(place_id)))).otherwise(F.concat(F.lit("#location-"), F.when(s == "", "place").otherwise(s)))


def merge_sheet(entity: DataFrame, prop: DataFrame, sheet: DataFrame, mapping: list[dict], order: str = "row_no") -> dict[str, DataFrame]:
    """Rows of a sheet (column @id and others) merged into entities: mapping is [{source, target, type}]. Cells are split at commas and
    slashes where a type is given, each part becoming an entity. Later rows win. Frames: entity, prop, unmatched, unmatched_files, missing."""
    present = [m for m in mapping if m["source"] in sheet.columns]
    cells = F.array(*[F.struct(F.lit(m["target"]).alias("key"), F.lit(m.get("type") or "").alias("kind"), F.col(f"`{m['source']}`").cast("string").alias("cell")) for m in present])
    rows = sheet.select(F.col("`@id`").alias("id"), F.col(order).alias("row_no"), cells.alias("cells"))
    known = entity.select("id")
    unmatched = rows.join(known, "id", "left_anti").select("row_no", "id")
    long = rows.join(known, "id", "left_semi").select("id", "row_no", F.explode("cells").alias("c")).select("id", "row_no", "c.*").where(trim(F.coalesce("cell", F.lit(""))) != "")
    last = long.withColumn("r", F.row_number().over(Window.partitionBy("id", "key").orderBy(F.desc("row_no")))).where("r = 1")
    parts = F.when(F.col("kind") == "", F.array(trim("cell"))).otherwise(F.array_distinct(F.array_remove(F.transform(F.split("cell", "[,/]"), lambda x: trim(F.translate(x, "[]?()'", ""))), "")))
    one = last.select("id", "key", "kind", F.posexplode(parts).alias("ord", "v"))
    new_id = F.when(F.col("kind") == "Place", entity_id("Place", F.col("v"))).otherwise(entity_id("", F.col("v")))
    ref = F.when(F.col("kind") != "", new_id)
    add = one.select("id", "key", "ord", F.when(F.col("kind") == "", F.col("v")).alias("value"), ref.alias("ref"), "kind", "v")
    made = add.where("ref is not null").groupBy(F.col("ref").alias("id")).agg(F.array(F.min("kind")).alias("types"), F.min("v").alias("name")).join(known, "id", "left_anti")
    names = made.select("id", F.lit("name").alias("key"), F.lit(0).alias("ord"), F.col("name").alias("value"), F.lit(None).cast("string").alias("ref"))
    kept = prop.join(add.select("id", "key").distinct(), ["id", "key"], "left_anti")
    files = entity.where(F.array_contains("types", "File")).join(rows.select("id"), "id", "left_anti").select("id")
    missing = sheet.sparkSession.createDataFrame([(m["source"],) for m in mapping if m["source"] not in sheet.columns], "column string")
    return {"entity": entity.unionByName(made.select("id", "types")), "prop": kept.unionByName(add.select("id", "key", "ord", "value", "ref")).unionByName(names), "unmatched": unmatched, "unmatched_files": files, "missing": missing}


def set_geometry(entity: DataFrame, prop: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """places: id, name, latitude, longitude. Writes each Place's geometry, the one it has or a new one. Third frame: one row, enriched: the
    places that had none before."""
    have = prop.where("key = 'geo' and ref is not null").groupBy("id").agg(F.min_by("ref", "ord").alias("geo"))
    first = places.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("name"))).where("r = 1 and latitude is not null and longitude is not null")
    g = first.join(have, "id", "left").withColumn("new", F.col("geo").isNull()).withColumn("geo", F.coalesce("geo", geometry_id(F.col("id"), F.col("name"))))
    wkt = F.concat(F.lit("POINT("), F.col("longitude").cast("string"), F.lit(" "), F.col("latitude").cast("string"), F.lit(")"))
    none = F.lit(None).cast("string")
    facts = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in ((".latitude", F.col("latitude")), (".longitude", F.col("longitude")), ("asWKT", wkt))])
    point = g.dropDuplicates(["geo"]).select(F.col("geo").alias("id"), F.explode(facts).alias("f")).select("id", "f.key", F.lit(0).alias("ord"), "f.value", none.alias("ref"))
    known = g.join(entity.select("id"), "id", "left_semi")
    link = known.where("new").select("id", F.lit("geo").alias("key"), F.lit(0).alias("ord"), none.alias("value"), F.col("geo").alias("ref"))
    made = g.select(F.col("geo").alias("id")).distinct().join(entity.select("id"), "id", "left_anti").select("id", F.array(F.lit("Geometry")).alias("types"))
    p = prop.join(point.select("id", "key"), ["id", "key"], "left_anti").unionByName(point).unionByName(link)
    return entity.unionByName(made), p, known.agg(F.count_if("new").alias("enriched"))


def prefixes(rows: DataFrame) -> DataFrame:
    """prefix, uri from key-value rows (ord, key, value): `@context` objects and plain pairs; the first of each prefix wins."""
    context = rows.where("key = '@context'").select("ord", F.explode(F.from_json("value", "map<string,string>")).alias("prefix", "uri"))
    plain = rows.where("key <> '@context' and value rlike '^https?://'").select("ord", F.regexp_replace("key", ":$", "").alias("prefix"), F.col("value").alias("uri"))
    w = Window.partitionBy("prefix").orderBy("ord")
    return context.union(plain).withColumn("r", F.row_number().over(w)).where("r = 1").select("prefix", "uri")


def custom_properties(entity: DataFrame, prop: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An rdf:Property with a readable name for every `custom:` property in use that has none."""
    local = F.substring("key", F.lit(8), F.length("key"))
    used = prop.where("key like 'custom:%'").select(F.concat(F.lit(CUSTOM_BASE), local).alias("id"), local.alias("local")).distinct()
    new = used.join(entity.select("id"), "id", "left_anti")
    spaced = F.trim(F.regexp_replace(F.regexp_replace("local", "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " "))
    words = F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, F.lit(2), F.length(spaced)))
    names = new.select("id", F.lit("name").alias("key"), F.lit(0).alias("ord"), words.alias("value"), F.lit(None).cast("string").alias("ref"))
    return entity.unionByName(new.select("id", F.array(F.lit("rdf:Property")).alias("types"))), prop.unionByName(names)


# -- publishing a part ---------------------------------------------------------------------------------------------------------------


def children(prop: DataFrame) -> DataFrame:
    """parent, child, k, ord: links down, and links up read the other way; siblings are in the order of (k, ord, child), down comes first."""
    down = prop.where(F.col("ref").isNotNull() & F.col("key").isin(MEMBERS)).select(F.col("id").alias("parent"), F.col("ref").alias("child"), F.array_position(F.array(*map(F.lit, MEMBERS)), F.col("key")).alias("k"), "ord")
    up = prop.where(F.col("ref").isNotNull() & F.col("key").isin(MEMBER_OF)).select(F.col("ref").alias("parent"), F.col("id").alias("child"), (F.array_position(F.array(*map(F.lit, MEMBER_OF)), F.col("key")) + 10).alias("k"), F.lit(0).alias("ord"))
    return down.union(up).groupBy("parent", "child").agg(F.min(F.struct("k", "ord")).alias("o")).select("parent", "child", "o.k", "o.ord")


def publish_subset(entity: DataFrame, prop: DataFrame, root: str = ROOT, most_depth: int | None = None) -> DataFrame:
    """id, parent, depth, effective, kept of everything below the root.

    An own flag wins, else the nearest ancestor's. With several parents the first in depth-first order counts; ancestors of kept nodes stay as shells.

    Nodes with one parent make trees below the root and below the nodes with several. Inside a tree everything (nearest flags, depths, depth-first numbers)
    comes by pointer jumping, so a chain of n nodes takes some log2(n) rounds and no paths. A node with several parents hangs in trees by slots, leaves
    that are numbered depth-first; its path is the list of the slots on the way, and the least path of each is found in rounds over these nodes alone.
    A cycle only makes longer paths, which never win, so the rounds end by themselves; a bound on the depth, where given, is an error if it is met.
    """
    links = stage(children(prop).where(F.col("child") != root).join(entity.select(F.col("id").alias("child")), "child", "left_semi"), "children")
    flag = F.lower(F.trim(F.min_by("value", "ord")))
    own = prop.where(F.col("key") == PUBLISH).groupBy(F.col("id").alias("owner")).agg(F.when(flag == "true", True).when(flag == "false", False).alias("own"))
    real = lambda c: F.concat(F.lit("n"), c)
    many = stage(links.groupBy("child").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("child").alias("many")), "many")
    slot = F.concat(F.lit("s"), F.length("parent").cast("string"), F.lit(":"), "parent", "child")
    items = links.join(many, F.col("child") == F.col("many"), "left").select(F.when(F.col("many").isNull(), real("child")).otherwise(slot).alias("node"), real("parent").alias("parent"), "child", "k", "ord", "many")
    items = stage(items.join(own, F.col("many").isNull() & (F.col("child") == F.col("owner")), "left").drop("owner"), "items")
    spark = entity.sparkSession
    heads = many.select(F.col("many").alias("child")).union(spark.createDataFrame([(root,)], "child string"))
    tops = heads.join(own, F.col("child") == F.col("owner"), "left").select(real("child").alias("node"), F.lit(None).cast("string").alias("parent"), "own", F.lit(0).alias("off"), F.lit(0).alias("depth"))
    forked = not many.isEmpty()
    numbered = items.withColumn("off", F.lit(0))
    if forked:  # only slots are compared, so only then are numbers needed
        sizes = forest_sums(items.select("node", "parent", F.lit(1).alias("size")).union(tops.select("node", "parent", F.lit(0).alias("size"))), ["size"])
        numbered = running(items.join(sizes, "node"), ["parent"], ["k", "ord", "child"], "size").withColumn("off", F.col("before") + 1)
    tree = numbered.select("node", "parent", "own", "off", F.lit(1).alias("depth")).unionByName(tops)
    walked = forest_walk(tree, ["off", "depth"], ["own"])
    known = spark.createDataFrame([(f"n{root}", [], None, 0, None)], "top string, path array<bigint>, inherited boolean, start bigint, via string")
    if forked:
        slots = stage(items.where("many IS NOT NULL").select("node", F.col("parent").alias("from"), real("child").alias("target")).join(walked, "node").select(F.col("top").alias("in"), "off", "depth", "own", "from", "target"), "slots")
        fresh = known
        while not fresh.isEmpty():
            step = fresh.join(slots, F.col("top") == F.col("in")).select("target", F.concat("path", F.array("off")).alias("path"), F.coalesce("own", "inherited").alias("inherited"), (F.col("start") + F.col("depth")).alias("start"), F.col("from").alias("via"))
            found = step.select(F.col("target").alias("top"), "path", F.lit(True).alias("new"), "inherited", "start", "via")
            both = known.select("top", "path", F.lit(False).alias("new"), "inherited", "start", "via").union(found)
            merged = stage(both.groupBy("top").agg(F.min(F.struct("path", "new", "inherited", "start", "via")).alias("b")).select("top", "b.*"), "paths")
            known, fresh = merged.drop("new"), merged.where("new").drop("new")
    single = walked.where(F.col("node").startswith("n")).join(known.drop("path"), "top")
    up = items.where("many IS NULL").select("node", "parent")
    placed = single.join(up, "node", "left").select("node", F.coalesce("parent", "via").alias("parent"), (F.col("start") + F.col("depth")).alias("depth"), F.coalesce("own", "inherited").alias("effective"))
    placed = stage(placed, "placed")
    if most_depth is not None and not placed.where(F.col("depth") > most_depth).isEmpty():
        raise ValueError(f"the graph is deeper than {most_depth} levels")
    chosen = forest_sums(placed.select("node", "parent", F.coalesce(F.col("effective").cast("int"), F.lit(0)).alias("chosen")), ["chosen"])
    name = lambda c: F.substring(c, F.lit(2), F.length(c))
    below = placed.where(F.col("node") != f"n{root}").join(chosen, "node")
    return below.select(name("node").alias("id"), name("parent").alias("parent"), "depth", "effective", (F.col("chosen") > 0).alias("kept"))


def published(entity: DataFrame, prop: DataFrame, root: str = ROOT) -> tuple[DataFrame, DataFrame]:
    """The graph without what isn't published."""
    return _without(entity, prop, publish_subset(entity, prop, root).where("not kept"))


def local_files(entity: DataFrame, prop: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """path of the File entities that are local and exist in `existing` (path); and of those that are missing."""
    files = entity.where(F.array_contains("types", "File") & ~F.col("id").rlike("^([a-z][a-z0-9+.-]*:|#)")).select(plain_id("id").alias("path")).distinct()
    return files.join(existing, "path", "left_semi"), files.join(existing, "path", "left_anti")


def relabel(prop: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Names of collections replaced."""
    pairs = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return prop.withColumn("value", F.when(F.col("key") == "name", F.coalesce(pairs[F.col("id")], F.col("value"))).otherwise(F.col("value")))


# -- tables ----------------------------------------------------------------------------------------------------------------------------


def inspect(entity: DataFrame, prop: DataFrame) -> DataFrame:
    """type, key, n_entities, n_refs."""
    t = entity.select("id", F.explode("types").alias("type"))
    return prop.join(t, "id").groupBy("type", "key").agg(F.countDistinct("id").alias("n_entities"), F.count("ref").alias("n_refs"))


def merge_settings(found: DataFrame, settings: DataFrame) -> DataFrame:
    """type, key, selected: existing choices stay, new properties are unselected."""
    return found.select("type", "key").join(settings, ["type", "key"], "full").select("type", "key", F.coalesce("selected", F.lit(False)).alias("selected"))


def default_text_property(found: list[tuple[str, str]], kind: str) -> str | None:
    """The property that leads to a type's text: mainText if any, else indexableText."""
    keys = {k.split(":")[-1]: k for t, k in found if t == kind}
    return keys.get("mainText") or keys.get("indexableText")


def table_of(entity: DataFrame, prop: DataFrame, kind: str, include: list[str], expand: dict[str, list[str]] | None = None, texts: DataFrame | None = None, text_property: str | None = None, normalise: bool = False) -> DataFrame:
    """One row for each entity of a type: included properties (several values joined by `; `), properties of entities one step away as
    `key_property`, and the text of the file that text_property names (texts: path, text). The columns are given, so the pivot needs no pass over the data."""
    ids = entity.where(F.array_contains("types", kind)).select("id")
    mine = prop.join(ids, "id", "left_semi")
    value = F.coalesce("value", "ref")
    long = mine.where(F.col("key").isin(include)).select("id", F.col("key").alias("column"), "ord", value.alias("v"))
    columns = list(include)
    for key, inner in (expand or {}).items():
        there = prop.where(F.col("key").isin(inner)).select(F.col("id").alias("ref"), F.col("key").alias("inner"), F.coalesce("value", "ref").alias("v"))
        step = mine.where(F.col("key") == key).select("id", "ref", "ord").join(there, "ref").select("id", F.concat(F.lit(f"{key}_"), "inner").alias("column"), "ord", "v")
        long = long.unionByName(step)
        columns += [f"{key}_{c}" for c in inner]
    joined = long.groupBy("id", "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "v"))), lambda x: x["v"]), "; ").alias("v"))
    wide = joined.groupBy("id").pivot("column", columns).agg(F.first("v")) if columns else ids
    out = ids.join(wide, "id", "left") if columns else ids
    if text_property and texts is not None:
        link = mine.where(F.col("key") == text_property).groupBy("id").agg(F.min_by(plain_id("ref"), "ord").alias("path"))
        out = out.join(link, "id", "left").join(texts.select(plain_id("path").alias("path"), "text"), "path", "left").drop("path")
        columns = [*columns, "text"]
    if normalise:
        from ..functions.text import squash

        out = out.withColumns({c: squash(F.col(f"`{c}`")) for c in columns})
    return out


def rows_of_csv(table: DataFrame, csv_rows: DataFrame) -> DataFrame:
    """A row of the table for each row of the CSV file it names: table has `path`, csv_rows path and others."""
    return table.join(csv_rows, "path")


