"""Transcripts in the built-in convention: a Speakers block, section markers, and turns `[number.] CODE: text` that may be wrapped.

Lines are rows; what a line is, is a column; what depends on earlier lines (the block a line is in, the turn it continues) are windows over
the lines of a document (gaps and islands). Nothing runs row by row in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import JS_SPACE, squash, trim
from ..plans.staging import stage
from .cleaning import straighten, strip_timecodes

#: fixed values: speaker codes, markers and header lines of the convention
CODE = r"[A-Za-z0-9][A-Za-z0-9_.'\-]{0,23}"
MARKERS = {"PRELIMINARIES": "PRE", "MAIN": "MAIN", "POSTLIMINARIES": "POST"}
HEADER = r"(?i)^(Speakers:\z|PRELIMINARIES\z|MAIN\z|POSTLIMINARIES\z|Transcript:|Recording date:|Length of audio recording:|Length of video recording:|Transcriber:)"
BLOCK = r"(?i)^Speakers:\z"
#: fixed values: kinds of departures from the convention
ISSUES = {
    "turn-number-missing-period": "turn number is missing its period",
    "speaker-code-missing-colon": "speaker code is not followed by a colon",
    "speaker-code-undeclared": "speaker code was not declared in the Speakers block",
    "speaker-code-missing": "no speaker code found",
    "speaker-code-duplicate": "speaker code was declared more than once",
    "text-missing": "turn has no text",
    "speaker-name-missing": "no speaker name found",
    "speaker-id-missing": "no #id found",
    "speaker-name-unbalanced-bracket": "unbalanced bracket in the speaker name",
}
ISSUE_TYPE = "array<struct<field:string,kind:string,detail:string>>"


def normalize(text: Column) -> Column:
    """Line ends, no-break spaces, indentation and the gap after a code made regular; end-of-transcript lines blanked."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    out = F.translate(out, "\u00a0", " ")
    out = F.regexp_replace(out, "(?m)^[\t ]+", "\t")
    out = F.regexp_replace(out, f"(?m)^({CODE}):[\t ]+", "$1:\t")
    out = F.regexp_replace(out, r"(?m)(\t.*) \t", "$1 ")
    return F.regexp_replace(out, "(?m)^.*END OF TRANSCRIPT.*$", "")


def to_lines(docs: DataFrame, text: str = "text", doc: str = "doc") -> DataFrame:
    """doc, line_no (from 1), raw: normalised lines without time codes."""
    clean, _ = strip_timecodes(normalize(F.col(text)))
    return docs.select(doc, F.posexplode(F.split(clean, "\n")).alias("k", "raw")).select(doc, (F.col("k") + 1).alias("line_no"), "raw")


def paragraph_numbers(lines: DataFrame) -> DataFrame:
    """Adds paragraph: the number of the paragraph that each line is in, where paragraphs are divided by an empty line each, as in the text of
    a word processor's file. Every second empty line of a run, and the line after an odd run, begins one."""
    w = Window.partitionBy("doc").orderBy("line_no")
    empty = (F.col("raw") == "") & (F.col("line_no") > 1)
    m = lines.withColumn("empty", empty).withColumn("filled", F.sum((~empty).cast("int")).over(w))
    m = m.withColumn("nth", F.sum(F.col("empty").cast("int")).over(Window.partitionBy("doc", "filled").orderBy("line_no")))
    before = F.coalesce(F.lag("nth").over(w), F.lit(0))
    begins = F.when(F.col("empty"), F.col("nth") % 2 == 0).otherwise(before % 2 == 1)
    return m.withColumn("paragraph", 1 + F.sum(begins.cast("int")).over(w)).drop("empty", "filled", "nth")


def _issue(when: Column, field: str, kind: str, detail: Column | str) -> Column:
    d = F.lit(detail) if isinstance(detail, str) else detail
    return F.when(when, F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), d.alias("detail")))


def _issues(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda x: x.isNotNull()).cast(ISSUE_TYPE)


def classify(line: Column, declared: Column) -> Column:
    """Struct (kind, turn_number, code, text, issues) of a line. `declared`: array of codes, empty if none are known.

    A leading number is a turn number if a code follows it or a tab separates it. A code without colon counts if it is declared.
    """
    t = trim(line)
    named = r"^(\d+)(\.?)[\t ]+(.*)\z"
    colon, bare = rf"^({CODE})[\t ]*:[\t ]*(.*)\z", rf"^({CODE})[\t ]+(.*)\z"

    def read(c: Column) -> tuple[Column, Column, Column, Column]:
        with_colon = c.rlike(colon)
        known = c.rlike(bare) & F.array_contains(declared, F.regexp_extract(c, bare, 1))
        return with_colon | known, with_colon, F.when(with_colon, F.regexp_extract(c, colon, 1)).otherwise(F.regexp_extract(c, bare, 1)), F.when(with_colon, F.regexp_extract(c, colon, 2)).otherwise(F.regexp_extract(c, bare, 2))

    numbered, number, dot, rest = t.rlike(named), F.regexp_extract(t, named, 1), F.regexp_extract(t, named, 2), F.regexp_extract(t, named, 3)
    ok_n, colon_n, code_n, text_n = read(rest)
    ok_n = numbered & ok_n
    ok, colon_, code, text = read(t)
    found = ok_n | ok
    code, text, has_colon = F.when(ok_n, code_n).otherwise(code), trim(F.when(ok_n, text_n).otherwise(text)), F.when(ok_n, colon_n).otherwise(colon_)
    column = ~found & numbered & t.rlike(r"^\d+\.?\t")
    of_number, of_code = F.concat(F.lit('turn number "'), number, F.lit('"')), F.concat(F.lit('speaker code "'), code, F.lit('"'))
    undeclared = (F.size(declared) > 0) & ~F.array_contains(declared, code)
    turn = _issues(
        _issue(ok_n & (dot != "."), "turnNumber", "turn-number-missing-period", of_number), _issue(~has_colon, "speakerCode", "speaker-code-missing-colon", of_code),
        _issue(undeclared, "speakerCode", "speaker-code-undeclared", of_code), _issue(text == "", "text", "text-missing", of_code),
    )
    bare_turn = _issues(
        _issue(dot != ".", "turnNumber", "turn-number-missing-period", of_number), _issue(F.lit(True), "speakerCode", "speaker-code-missing", of_number), _issue(trim(rest) == "", "text", "text-missing", of_number)
    )
    folded = _issues(_issue(F.lit(True), "speakerCode", "speaker-code-missing", "the line was folded into the turn above it"))
    none = F.array().cast(ISSUE_TYPE)
    kind = F.when(t == "", "blank").when(t.isin(*MARKERS), "section").when(t.rlike(HEADER), "header").when(found | column, "turn").otherwise("continuation")
    return F.struct(
        kind.alias("kind"), F.when((kind == "turn") & (ok_n | column), number).alias("turn_number"), F.when((kind == "turn") & found, code).alias("code"),
        F.when(kind == "turn", F.when(found, text).otherwise(trim(rest))).otherwise(t).alias("text"),
        F.when(kind == "turn", F.when(found, turn).otherwise(bare_turn)).when(kind == "continuation", folded).otherwise(none).alias("issues"),
    )


def fold(lines: DataFrame) -> DataFrame:
    """doc, line_no, declared, line: wrapped lines joined to the line they continue. Needs doc, line_no, raw, declared.

    In the Speakers block every filled line starts a line. Nothing is folded into a marker or header.
    """
    w = Window.partitionBy("doc").orderBy("line_no")
    t = trim("raw")
    c = lines.withColumn("kind", classify(F.col("raw"), F.col("declared"))["kind"])
    switch = F.when(t.rlike(BLOCK), True).when(t.isin(*MARKERS), False)
    c = c.withColumn("in_block", F.coalesce(F.last(switch, True).over(w), F.lit(False)))
    before = F.last(F.when(F.col("kind") != "blank", F.col("kind")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(F.col("line_no") == 1, True).when(F.col("kind") == "blank", False).when(F.col("in_block") | (F.col("kind") != "continuation"), True).otherwise(before.isin("section", "header"))
    c = c.withColumn("island", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.struct("line_no", trim("raw").alias("t"))))
    joined = F.array_join(F.filter(F.transform(parts, lambda p: p["t"]), lambda x: x != ""), " ")
    return c.groupBy("doc", "island").agg(F.min("line_no").alias("line_no"), F.first("declared").alias("declared"), joined.alias("line")).drop("island")


def speaker_details(value: Column) -> dict[str, Column]:
    """name, alternate_name, demographic, optional_code, read from the right: `Dora [Dora Leung] (Australian, male) #dora`."""
    s = rf"[{JS_SPACE}]"
    v = trim(value)
    tag = rf"(?:^|{s})(#[^{JS_SPACE}]+){s}*\z"
    code = F.nullif(F.regexp_extract(v, tag, 1), F.lit(""))
    v = trim(F.regexp_replace(v, tag, ""))
    has_demo, has_alt = v.rlike(rf"\([^()]*\){s}*\z"), None
    demo = F.when(has_demo, trim(F.regexp_extract(v, rf"\(([^()]*)\){s}*\z", 1)))
    v = trim(F.regexp_replace(v, rf"\([^()]*\){s}*\z", ""))
    has_alt = v.rlike(rf"\[[^\[\]]*\]{s}*\z")
    alt = F.when(has_alt, trim(F.regexp_extract(v, rf"\[([^\[\]]*)\]{s}*\z", 1)))
    name = trim(F.regexp_replace(v, rf"\[[^\[\]]*\]{s}*\z", ""))
    return {"name": name, "alternate_name": alt, "demographic": demo, "optional_code": code}


def speaker_block(folded: DataFrame) -> DataFrame:
    """doc, line_no, content, code, the details and issues of every line of the Speakers block; later declarations of a code come later."""
    per_doc = Window.partitionBy("doc")
    f = folded.where("line <> ''")
    opens = F.min(F.when(F.col("line").rlike(BLOCK), F.col("line_no"))).over(per_doc)
    f = f.withColumn("opens", opens)
    f = f.withColumn("closes", F.min(F.when((F.col("line") == "PRELIMINARIES") & (F.col("line_no") > F.col("opens")), F.col("line_no"))).over(per_doc))
    inside = (F.col("line_no") > F.col("opens")) & (F.col("closes").isNull() | (F.col("line_no") < F.col("closes"))) & ~F.col("line").rlike(BLOCK)
    b = f.where(inside)
    colon, bare = rf"^({CODE})[\t ]*:[\t ]*(.*)\z", rf"^({CODE})[\t ]+(.*)\z"
    has = F.col("line").rlike(colon)
    ok = has | F.col("line").rlike(bare)
    code = F.when(ok, F.when(has, F.regexp_extract("line", colon, 1)).otherwise(F.regexp_extract("line", bare, 1)))
    value = F.when(has, F.regexp_extract("line", colon, 2)).otherwise(F.regexp_extract("line", bare, 2))
    b = b.select("doc", "line_no", F.col("line").alias("content"), code.alias("code"), has.alias("colon"), F.when(ok, trim(value)).alias("value"))
    b = b.withColumns(speaker_details(F.col("value"))).withColumn("nth", F.row_number().over(Window.partitionBy("doc", "code").orderBy("line_no")))
    of_code = F.concat(F.lit('speaker code "'), "code", F.lit('"'))
    known = F.col("code").isNotNull()
    found = _issues(
        _issue(~known, "speakerCode", "speaker-code-missing", "the declaration was skipped"), _issue(known & ~F.col("colon"), "speakerCode", "speaker-code-missing-colon", of_code),
        _issue(known & (F.col("name") == ""), "name", "speaker-name-missing", ""), _issue(known & F.col("optional_code").isNull(), "id", "speaker-id-missing", ""),
        _issue(known & F.col("name").rlike(r"[\[\]()]"), "name", "speaker-name-unbalanced-bracket", F.concat(F.lit('"'), "name", F.lit('"'))),
        _issue(known & (F.col("nth") > 1), "speakerCode", "speaker-code-duplicate", of_code),
    )
    return b.select("doc", "line_no", "content", "code", "value", "name", "alternate_name", "demographic", "optional_code", found.alias("issues"))


def speakers(block: DataFrame) -> DataFrame:
    """doc, code, label, details, resolved: the last declaration of each code, in the order of first declaration."""
    w = Window.partitionBy("doc", "code").orderBy(F.desc("line_no"))
    last = block.where("code is not null").withColumn("order", F.min("line_no").over(Window.partitionBy("doc", "code"))).withColumn("r", F.row_number().over(w)).where("r = 1")
    label = F.when(F.col("name") != "", F.col("name")).otherwise(trim(F.regexp_replace("value", rf"[{JS_SPACE}]*#[^{JS_SPACE}]+[{JS_SPACE}]*\z", "")))
    affiliation = F.when(F.coalesce("demographic", F.lit("")) != "", F.concat(F.lit("("), "demographic", F.lit(")")))
    return last.select("doc", "code", "order", label.alias("label"), "name", "alternate_name", "demographic", affiliation.alias("affiliation"), "optional_code", F.coalesce("optional_code", "code").alias("resolved"), F.col("line_no").alias("line"))


def _with_declared(lines: DataFrame, declared: DataFrame | None) -> DataFrame:
    empty = F.array().cast("array<string>")
    if declared is None:
        return lines.withColumn("declared", empty)
    return lines.join(declared, "doc", "left").withColumn("declared", F.coalesce("declared", empty))


def parse(docs: DataFrame, text: str = "text", header_rows: int = 0, footer_rows: int = 0) -> dict[str, DataFrame]:
    """Frames rows, speakers, speaker_diagnostics, body_diagnostics, markers, section_diagnostics of documents (doc, text).

    Two plans, as the halves need each other: the first folds on line shape and reads the declared codes, the second folds with them. Lines are
    staged after each step, as six frames come from them.
    """
    lines = stage(to_lines(docs, text), "lines")
    first = speakers(speaker_block(fold(_with_declared(lines, None))))
    declared = first.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array("code", "optional_code"))))).alias("declared"))
    folded = stage(fold(_with_declared(lines, declared)), "folded")
    block = speaker_block(folded)
    who = speakers(block)
    codes = who.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("code", "resolved"))).alias("ids"))

    per_doc, w = Window.partitionBy("doc"), Window.partitionBy("doc").orderBy("line_no")
    m = stage(folded.where("line <> ''").withColumn("c", classify(F.col("line"), F.col("declared"))).select("doc", "line_no", "line", "c.*"), "classified")
    is_block, is_marker = F.col("line").rlike(BLOCK), F.col("kind") == "section"
    m = m.withColumn("free", ~F.coalesce(F.max(is_block | is_marker).over(per_doc), F.lit(False)))
    # without block and markers the body starts at the first turn of a speaker who comes back
    uses = F.when(F.col("code").isNotNull(), F.count("code").over(Window.partitionBy("doc", "code"))).otherwise(0)
    m = m.withColumn("uses", uses)
    distinct = F.size(F.collect_set("code").over(per_doc))
    opens = F.when(F.max("uses").over(per_doc) > 1, F.col("uses") > 1).otherwise(distinct > 1)
    event = F.when(is_block, False).when(is_marker, True).when(F.col("free") & (F.col("kind") == "turn") & opens, True)
    m = m.withColumn("started", F.coalesce(F.last(event, True).over(w), F.lit(False)))
    section = F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv])
    m = m.withColumn("section", F.coalesce(F.last(F.when(is_marker, section[F.col("line")]), True).over(w), F.lit("MAIN"))).withColumn("segment", F.sum(is_marker.cast("int")).over(w))
    body = m.where(F.col("started") & F.col("kind").isin("turn", "continuation"))
    ws = Window.partitionBy("doc", "segment").orderBy("line_no")
    body = body.withColumn("turn_no", F.sum((F.col("kind") == "turn").cast("int")).over(ws))
    dropped = F.array(F.struct(F.lit("speakerCode").alias("field"), F.lit("speaker-code-missing").alias("kind"), F.lit("no turn above it to fold into — the line was dropped").alias("detail"))).cast(ISSUE_TYPE)
    long_name = F.create_map(*[F.lit(x) for k, v in MARKERS.items() for x in (v, k)])
    diagnostics = body.select("doc", F.col("line_no").alias("line"), F.col("line").alias("content"), long_name[F.col("section")].alias("section"), "code",
                              F.when(F.col("turn_no") == 0, dropped).otherwise(F.col("issues")).alias("issues")).where("size(issues) > 0")
    parts = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    first_of = lambda c: F.min_by(c, "line_no")
    rows = body.where("turn_no > 0").groupBy("doc", "segment", "turn_no").agg(
        F.min("line_no").alias("line_no"), first_of("section").alias("section"), first_of(F.coalesce("turn_number", F.lit(""))).alias("turn_number"), first_of(F.coalesce("code", F.lit(""))).alias("code"),
        trim(F.array_join(F.transform(parts, lambda p: p["text"]), " ")).alias("text"), first_of("free").alias("free"),
    )
    # no block: the speakers are the codes of the turns
    has_block = folded.where(F.col("line").rlike(BLOCK)).select("doc").distinct().withColumn("has_block", F.lit(True))
    rows = rows.join(codes, "doc", "left").join(has_block, "doc", "left")
    declared_id = F.coalesce(F.col("ids")[F.col("code")], F.col("code"))
    rows = rows.withColumn("speaker_id", F.when(F.col("code") == "", "").when(F.col("has_block").isNull(), F.concat(F.lit("#"), declared_id)).otherwise(declared_id))
    from_turns = rows.where("has_block is null and code <> ''").groupBy("doc", "code").agg(F.min("line_no").alias("order"))
    tag = F.concat(F.lit("#"), "code")
    none = F.lit(None).cast("string")
    from_turns = from_turns.select("doc", "code", "order", F.col("code").alias("label"), F.col("code").alias("name"), none.alias("alternate_name"), none.alias("demographic"), none.alias("affiliation"),
                                   tag.alias("optional_code"), tag.alias("resolved"), F.lit(None).cast("int").alias("line"))
    n = F.row_number().over(w)
    rows = rows.withColumn("row_no", n).withColumn("n_rows", F.count(F.lit(1)).over(per_doc)).where((F.col("row_no") > header_rows) & (F.col("row_no") <= F.col("n_rows") - footer_rows))
    final = rows.select("doc", "row_no", "line_no", *[straighten(F.col(c)).alias(c) for c in ("turn_number", "speaker_id", "text", "section")])
    near = r"^[^A-Za-z]*([A-Za-z]+)[^A-Za-z]*\z"
    guess = F.upper(F.regexp_extract("line", near, 1))
    markers = m.select("doc", "line_no", "line", F.when(is_marker, F.col("line")).alias("matched"), F.when(~is_marker & guess.isin(*MARKERS), guess).alias("near_miss")).where("matched is not null or near_miss is not null")
    return {
        "rows": final, "speakers": who.unionByName(from_turns), "speaker_diagnostics": block, "body_diagnostics": diagnostics, "markers": markers,
        "section_diagnostics": section_diagnostics(docs, m, rows),
    }


def section_diagnostics(docs: DataFrame, lines: DataFrame, rows: DataFrame) -> DataFrame:
    """doc, name, processed, header_line, reason for each of the three sections."""
    names = docs.select("doc", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("section")) for k, v in MARKERS.items()])).alias("s")).select("doc", "s.*")
    heads = lines.where("kind = 'section'").groupBy("doc", F.col("line").alias("name")).agg(F.max("line_no").alias("header_line"))
    counts = rows.groupBy("doc", "section").agg(F.count(F.lit(1)).alias("n"))
    s = names.join(heads, ["doc", "name"], "left").join(counts, ["doc", "section"], "left")
    reason = F.when(F.col("header_line").isNull(), "section marker was not found before the end of the document").when(F.col("n").isNull(), "section marker was found, but no valid transcript rows were found")
    return s.select("doc", "name", (F.col("header_line").isNotNull() & F.col("n").isNotNull()).alias("processed"), "header_line", reason.otherwise(F.concat(F.col("n").cast("string"), F.lit(" transcript row(s) processed"))).alias("reason"))


def issue_tally(diagnostics: DataFrame) -> DataFrame:
    """kind, n: most frequent first, then by name."""
    return diagnostics.select(F.explode("issues").alias("i")).groupBy(F.col("i.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


def unresolved(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("speaker_id").contains("#"))


def order_warnings(markers: list[str]) -> list[str]:
    """What is wrong with the order of a document's markers."""
    if not markers:
        return ["No section markers found. Defaulting all rows to MAIN."]
    out = []
    if markers[0] != "PRELIMINARIES":
        out.append(f"Unexpected first section marker: {markers[0]}. Expected PRELIMINARIES.")
    seen = [m for m in MARKERS if m in markers]
    if seen[0] != "PRELIMINARIES":
        out.append("Section order warning: expected PRELIMINARIES before MAIN.")
    if "MAIN" in markers and "POSTLIMINARIES" in markers and markers.index("POSTLIMINARIES") < markers.index("MAIN"):
        out.append("Section order warning: POSTLIMINARIES appears before MAIN.")
    return out


# -- what is made of rows ----------------------------------------------------------------------------------------------------------


def csv_cell(x: Column) -> Column:
    """Quoted only if it holds a comma, a quote or a line feed."""
    return F.when(x.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def csv_text(rows: DataFrame, extra: list[str] = ()) -> DataFrame:
    """doc, text: one CSV file for each document, header and final line end included."""
    cells = [F.col("turn_number"), F.col("speaker_id"), F.col("text"), F.when(F.col("section") == "", "MAIN").otherwise(F.col("section")), *[F.coalesce(F.col("extra")[e], F.lit("")) for e in extra]]
    lines = rows.select("doc", "row_no", F.concat_ws(",", *[csv_cell(c) for c in cells]).alias("line"))
    header = ",".join(["turnNumber", "speakerID", "text", "section", *extra])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("doc").agg(F.concat(F.lit(header + "\n"), body, F.lit("\n")).alias("text"))


def chat_text(rows: DataFrame, who: DataFrame, language: str = "", corpus: str = "") -> DataFrame:
    """doc, text: a CHAT file for each document: participants, their IDs, turns."""
    group = F.regexp_replace(F.coalesce("affiliation", F.concat(F.lit("("), F.nullif(F.regexp_extract(F.coalesce("name", "label"), r"\(([^()]+)\)[\s]*\z", 1), F.lit("")), F.lit(")")), F.lit("")), r"^\((.*)\)\z", "$1")
    entry = F.struct("order", F.concat("code", F.lit(" Participant")).alias("p"), F.concat(F.lit(f"@ID: {language}|{corpus}|"), "code", F.lit("|||"), trim(group), F.lit("||Participant|||")).alias("i"), "resolved", "code")
    heads = who.groupBy("doc").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    heads = heads.select("doc", F.concat(F.lit("@Participants: "), F.array_join(F.transform("e", lambda x: x["p"]), ", ")).alias("participants"), F.transform("e", lambda x: x["i"]).alias("ids"))
    code = who.select("doc", F.col("resolved").alias("speaker_id"), "code").dropDuplicates(["doc", "speaker_id"])
    said = rows.join(code, ["doc", "speaker_id"], "left").withColumn("t", squash("text")).where("t <> ''")
    line = F.concat(F.lit("*"), F.coalesce("code", F.regexp_replace("speaker_id", "^#", "")), F.lit(": "), "t")
    turns = said.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", line.alias("l")))), lambda x: x["l"]).alias("turns"))
    none = F.array().cast("array<string>")
    both = heads.join(turns, "doc", "full")
    all_lines = F.concat(F.array(F.coalesce("participants", F.lit("@Participants: "))), F.coalesce("ids", none), F.array(F.lit("@Begin")), F.coalesce("turns", none), F.array(F.lit("@End")))
    return both.select("doc", F.concat(F.array_join(all_lines, "\n"), F.lit("\n")).alias("text"))


def log_text(parsed: dict[str, DataFrame]) -> DataFrame:
    """doc, text: a report for each document: counts, then every departure with its line."""
    counts = parsed["rows"].groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("speaker_id").alias("s"))
    wording = F.create_map(*[F.lit(x) for kv in ISSUES.items() for x in kv])
    found = parsed["body_diagnostics"].select("doc", "line", F.explode("issues").alias("i")).unionByName(parsed["speaker_diagnostics"].select("doc", F.col("line_no").alias("line"), F.explode("issues").alias("i")))
    line = F.format_string("line %d: %s %s", F.col("line"), F.coalesce(wording[F.col("i.kind")], F.col("i.kind")), F.col("i.detail"))
    notes = found.select("doc", "line", line.alias("l")).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "l"))), lambda x: x["l"]), "\n").alias("notes"))
    return counts.join(notes, "doc", "left").select("doc", F.concat_ws("\n", F.format_string("%d rows, %d speakers", "n", "s"), "notes").alias("text"))


def person_entities(who: DataFrame) -> DataFrame:
    """id, type, name, alternate_name, description: a Person for each resolved speaker."""
    tag = F.when(F.col("resolved").startswith("#"), F.col("resolved")).otherwise(F.concat(F.lit("#"), "resolved"))
    return who.select(tag.alias("id"), F.lit("Person").alias("type"), F.coalesce(F.nullif("name", F.lit("")), "label").alias("name"), "alternate_name", F.col("demographic").alias("description")).dropDuplicates(["id"])
