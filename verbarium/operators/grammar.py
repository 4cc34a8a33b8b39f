"""User-defined line grammars: regular expressions for header fields, speaker rows and turn rows, regions, lines to ignore, text to remove.

A grammar is a dictionary as saved by the editor (JSON). Parsing is windows over the lines of each document: regions only go forward, so
their borders are minima of line numbers; wrapped lines and repeated rows are islands.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import java_pattern, trim

VERSION = 1
#: fixed value: a `Key: value` line
HEADER_FIELD = r"^\s*(?<key>[^:\t]+?)\s*:\s*(?<value>.*)$"
TURN_FIELDS = ("turn", "speaker", "text")
SPEAKER_FIELDS = ("code", "name", "alternateName", "affiliation", "id")
CUSTOM = re.compile(r"^c_[A-Za-z0-9_]+$")
MARK = "\x00"


def layout(grammar: dict) -> dict[str, bool]:
    """Which parts a format has: all but those that its saved layout rules out."""
    saved = (grammar.get("regions") or {}).get("layout") or {}
    return {part: saved.get(part) is not False for part in ("header", "speakers", "markers")}


def custom_key(label: str, taken: tuple[str, ...] = ()) -> str:
    """The key of a custom field: `c_` and the label's letters and digits, unique among those taken."""
    import unicodedata

    plain = unicodedata.normalize("NFKD", label)
    base = "c_" + (re.sub(r"[^A-Za-z0-9]+", "_", plain).strip("_").lower() or "field")
    key, n = base, 2
    while key in taken:
        key, n = f"{base}_{n}", n + 1
    return key


def validate(grammar: object) -> list[str]:
    """What is wrong with a loaded grammar."""
    if not isinstance(grammar, dict):
        return ["not a grammar object"]
    out = []
    if grammar.get("version") != VERSION:
        out.append(f"unsupported version {grammar.get('version')}")
    if not (grammar.get("turnRow") or {}).get("pattern"):
        out.append("no turn row pattern")
    patterns = [(k, (grammar.get(k) or {}).get("pattern")) for k in ("speakerRow", "turnRow", "headerField")]
    main = (grammar.get("regions") or {}).get("main") or {}
    patterns += [("regions.speakers.start", ((grammar.get("regions") or {}).get("speakers") or {}).get("start")), ("regions.main.start", main.get("start")), ("regions.main.sectionPattern", main.get("sectionPattern"))]
    patterns += [(f"ignore[{i}]", p) for i, p in enumerate(grammar.get("ignore") or [])] + [(f"strip[{i}]", _pattern_of(s)) for i, s in enumerate(grammar.get("strip") or [])]
    for label, pattern in patterns:
        if pattern is not None and (problem := pattern_error(pattern)):
            out.append(f"{label}: {problem}")
    for row in ("speakerRow", "turnRow"):
        custom = (grammar.get(row) or {}).get("customFields")
        if custom is not None and not isinstance(custom, list):
            out.append(f"{row}.customFields: not a list")
            continue
        for i, f in enumerate(custom or []):
            if not isinstance(f, dict) or not CUSTOM.match(f.get("key") or ""):
                out.append(f"{row}.customFields[{i}]: key must look like c_name")
            if not str((f or {}).get("label") or "").strip():
                out.append(f"{row}.customFields[{i}]: no label")
    drop = grammar.get("dropColumns")
    if drop is not None and not isinstance(drop, list):
        out.append("dropColumns: not a list")
    else:
        out += [f"dropColumns[{i}]: {p}" for i, rule in enumerate(drop or []) if (p := column_rule_error(rule))]
    return out


def _pattern_of(spec: object) -> str | None:
    return spec if isinstance(spec, str) else (spec or {}).get("pattern")


def pattern_error(pattern: str) -> str | None:
    """What is wrong with a pattern, found out with a Unicode-aware engine on the driver."""
    import regex

    try:
        java_pattern(pattern)
        regex.compile(re.sub(r"\(\?<([A-Za-z_]\w*)>", r"(?P<\1>", pattern))
    except (regex.error, ValueError) as e:
        return str(e)
    return None


def column_rule_error(rule: object) -> str | None:
    """A rule is {tab: n} (from 1) or {from, to} (characters, to exclusive)."""
    if not isinstance(rule, dict):
        return "not a rule"
    if "tab" in rule:
        return None if isinstance(rule["tab"], int) and rule["tab"] >= 1 else "tab must be 1 or more"
    a, b = rule.get("from"), rule.get("to")
    return None if isinstance(a, int) and a >= 0 and (b is None or isinstance(b, int) and b > a) else "from and to must be a range"


def fingerprint(grammar: dict) -> str:
    """FNV-1a (32 bits) of the grammar's text, to notice changes."""
    h = 0x811C9DC5
    for b in json.dumps(grammar, ensure_ascii=False, separators=(",", ":")).encode():
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return f"{h:08x}"


# -- lines as expressions ------------------------------------------------------------------------------------------------------------


@dataclass
class Row:
    """A compiled row pattern: its Java form and the position of each field's group."""

    pattern: str
    fields: dict[str, int]

    def matches(self, line: Column) -> Column:
        return line.rlike(self.pattern)

    def field(self, line: Column, name: str) -> Column:
        return trim(F.regexp_extract(line, self.pattern, self.fields[name])) if name in self.fields else F.lit("")


def compile_row(spec: dict | None) -> Row | None:
    if not spec or not spec.get("pattern"):
        return None
    java, _ = java_pattern(spec["pattern"], "i" if "i" in spec.get("flags", "") else "")
    fields, count, i, text = {}, 0, 0, spec["pattern"]
    inside = False
    while i < len(text):  # groups are numbered by their opening parentheses
        if text[i] == "\\":
            i += 2
            continue
        inside = (inside or text[i] == "[") and text[i] != "]"
        if text[i] == "(" and not inside:
            if m := re.match(r"\(\?<([A-Za-z_]\w*)>", text[i:]):
                count += 1
                fields[m[1]] = count
            elif text[i + 1 : i + 2] != "?":
                count += 1
        i += 1
    return Row(java, fields)


def strip_all(line: Column, patterns: list[str]) -> Column:
    """Removals; the spaces on both sides of one close up to one, those at an end go. Tabs stay."""
    for p in patterns:
        marked = F.regexp_replace(line, java_pattern(p)[0], MARK)
        closed = F.regexp_replace(F.regexp_replace(marked, r"^ *\x00[ \x00]*", ""), r"[ \x00]*\x00 *\z", "")
        closed = F.regexp_replace(F.regexp_replace(closed, r" +\x00[ \x00]*|\x00[ \x00]* ", " "), r"\x00+", "")
        line = F.when(marked == line, line).otherwise(closed)
    return line


def drop_columns(line: Column, rules: list[dict]) -> Column:
    """Without some tab-separated columns or character ranges."""
    tabs = sorted({r["tab"] for r in rules if "tab" in r})
    if tabs:
        line = F.array_join(F.filter(F.split(line, "\t"), lambda x, i: ~(i + 1).isin(tabs)), "\t")
    for r in sorted((r for r in rules if "tab" not in r), key=lambda r: -r["from"]):
        rest = F.substring(line, F.lit(r["to"] + 1), F.length(line)) if r.get("to") is not None else F.lit("")
        line = F.concat(F.substring(line, 1, r["from"]) if r["from"] else F.lit(""), rest)
    return line


def _any(line: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [line.rlike(java_pattern(p)[0]) for p in patterns], F.lit(False))


def read_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc, line_no, line; where nine in ten filled lines are followed by a blank one (paragraphs), the text is split at blank lines."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n")
    lines = F.split(t, "\n")
    filled = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: trim(s["x"]) != "")
    spaced = F.size(F.filter(filled, lambda s: (s["i"] + 1 >= F.size(lines)) | (trim(F.coalesce(F.get(lines, s["i"] + 1), F.lit(""))) == "")))
    paragraphs = (F.size(filled) > 1) & (spaced >= 0.9 * F.size(filled))
    return docs.select("doc", F.posexplode(F.when(paragraphs, F.split(t, "\n\n")).otherwise(lines)).alias("k", "line")).select("doc", (F.col("k") + 1).alias("line_no"), "line")


def looks_fixed_width(lines: DataFrame) -> DataFrame:
    """doc, fixed: three filled lines or more, no tab, all as long as each other, 20 characters at least."""
    f = lines.where(trim("line") != "")
    return f.groupBy("doc").agg(((F.count(F.lit(1)) >= 3) & (F.countDistinct(F.length("line")) == 1) & (F.min(F.length("line")) >= 20) & ~F.max(F.col("line").contains("\t"))).alias("fixed"))


def parse(lines: DataFrame, grammar: dict) -> DataFrame:
    """doc, line_no, line, role, into, section, fields: every filled line once.

    Roles: header, header:unmatched, speakers, speakers:marker, speakers:unmatched, main, main:marker, main:joined, main:continuation,
    main:malformed, main:unmatched, ignore. `into` is the line of the turn that a continuation or joined row belongs to; fields is a map of
    what the row's pattern names.
    """
    lay, regions = layout(grammar), grammar.get("regions") or {}
    main, strips = regions.get("main") or {}, [p for s in grammar.get("strip") or [] if (p := _pattern_of(s))]
    turn, speaker = compile_row(grammar.get("turnRow")), compile_row(grammar.get("speakerRow")) if lay["speakers"] else None
    header = compile_row(grammar.get("headerField") or {"pattern": HEADER_FIELD}) or compile_row({"pattern": HEADER_FIELD})
    spec = grammar.get("turnRow") or {}
    fixed, joins, start = bool(spec.get("fixedWidth")), bool(spec.get("joinRepeats")), compile_row({"pattern": spec.get("rowStart")})
    marker = lambda p: java_pattern(p)[0] if p and lay["markers"] else None
    speakers_start, main_start, section = marker((regions.get("speakers") or {}).get("start")), marker(main.get("start")), marker(main.get("sectionPattern"))
    rules = [r for r in grammar.get("dropColumns") or [] if not column_rule_error(r)]
    no = F.lit(False)

    f = lines.where(trim("line") != "")
    f = f.withColumn("skip", _any(F.col("line"), grammar.get("ignore") or []))
    f = f.withColumn("row", strip_all(F.col("line"), strips))
    f = f.withColumn("main_row", F.col("line") if fixed else strip_all(drop_columns(F.col("line"), rules), strips) if rules else F.col("row"))
    is_turn = turn.matches(F.col("main_row")) if turn else no
    is_speaker = speaker.matches(F.col("row")) if speaker else no
    keys = (regions.get("header") or {}).get("keys") or []
    known = header.matches(F.col("line")) & header.field(F.col("line"), "key").isin(keys) if keys else no
    is_section = F.col("line").rlike(section) if section else no
    at_main = F.col("line").rlike(main_start) if main_start else no
    turnlike = is_turn & ~is_speaker & ~known
    opens = F.col("line").rlike(speakers_start) if speakers_start else is_speaker
    f = f.withColumns({"opens": opens, "at_main": at_main, "turnlike": turnlike, "is_section": is_section})
    # borders: the first line that can open a region, in the order in which regions are tried on a line
    per_doc, w = Window.partitionBy("doc"), Window.partitionBy("doc").orderBy("line_no")
    live = ~F.col("skip")
    first = lambda c: F.min(F.when(live & c, F.col("line_no"))).over(per_doc)
    if not (lay["header"] or lay["speakers"]):
        f = f.withColumn("s0", F.lit(None).cast("int")).withColumn("m0", F.lit(0))
    else:
        f = f.withColumn("s1", first(F.col("opens")))
        # from the header; a marker line of the speakers goes before the main region on the same line
        from_header = F.col("at_main") | (F.lit(True) if not lay["header"] else F.col("turnlike"))
        f = f.withColumn("h1", first(from_header))
        f = f.withColumn("s0", F.when(F.col("s1").isNotNull() & (F.col("h1").isNull() | (F.col("s1") <= F.col("h1"))), F.col("s1")))
        at_or_after = F.col("line_no") > F.col("s0") if speakers_start else F.col("line_no") >= F.col("s0")
        f = f.withColumn("m1", first(at_or_after & (F.col("at_main") if main_start else F.col("turnlike"))))
        f = f.withColumn("m0", F.when(F.col("s0").isNotNull(), F.col("m1")).otherwise(F.col("h1")))
    region = F.when(F.col("line_no") >= F.col("m0"), "main").when(F.col("line_no") >= F.col("s0"), "speakers").otherwise("header")
    f = f.withColumn("region", region)
    here = F.when(F.col("region") == "main", F.col("main_row")).otherwise(F.col("row"))
    consumed = F.col("at_main") & (F.col("line_no") == F.col("m0"))
    f = f.withColumn("here", here).withColumn("rowlike", start.matches(F.col("here")) if start else no).withColumn("is_turn", turn.matches(F.col("here")) if turn else no)
    base = (
        F.when(F.col("skip"), "ignore").when(F.lit(bool(speakers_start)) & (F.col("line_no") == F.col("s0")), "speakers:marker")
        .when((F.col("region") == "main") & (consumed | F.col("is_section")), "main:marker")
        .when(F.col("region") == "header", F.when(header.matches(F.col("line")), "header").otherwise("header:unmatched"))
        .when(trim("here") == "", "ignore")
        .when(F.col("region") == "speakers", F.when(is_speaker, "speakers").otherwise("speakers:unmatched"))
        .when(F.col("is_turn"), "main").when(F.col("rowlike"), "main:malformed").otherwise("main:continuation")
    )
    f = f.withColumn("role", base)
    name = F.when((F.col("role") == "main:marker") & F.col("is_section"), trim("line"))
    f = f.withColumn("section", F.coalesce(F.last(name, True).over(w), F.lit("")))
    f = f.withColumn("segment", F.sum(((F.col("role") == "main:marker") & F.col("is_section") & ~consumed).cast("int")).over(w))
    value = lambda k: strip_all(turn.field(F.col("here"), k), strips) if fixed else turn.field(F.col("here"), k)
    names = list(turn.fields) if turn else []
    f = f.withColumn("t", F.when(F.col("role") == "main", F.create_map(*[x for k in names for x in (F.lit(k), trim(value(k)))]) if names else None))
    starts = F.col("role").isin("main", "main:malformed")
    ws = Window.partitionBy("doc", "segment").orderBy("line_no")
    if joins:
        # a row joins the row before it if number and speaker repeat; continuations between them don't matter
        rows_only = Window.partitionBy("doc", "segment", "starts").orderBy("line_no")
        f = f.withColumn("starts", starts)
        same = (F.lag("role").over(rows_only) == "main") & (F.col("t")["turn"] != "") & (F.col("t")["turn"] == F.lag(F.col("t")["turn"]).over(rows_only))
        same = same & (F.coalesce(F.col("t")["speaker"], F.lit("")) == F.coalesce(F.lag(F.col("t")["speaker"]).over(rows_only), F.lit("")))
        f = f.withColumn("joined", F.coalesce((F.col("role") == "main") & same, F.lit(False))).drop("starts")
    else:
        f = f.withColumn("joined", no)
    opening = starts & ~F.col("joined")
    f = f.withColumn("into", F.last(F.when(opening, F.col("line_no")), True).over(ws))
    folds = (F.col("role") == "main:continuation") & F.col("into").isNotNull() & (F.lit("text" in names) | (F.last(F.when(opening, F.col("role")), True).over(ws) == "main:malformed"))
    role = F.when(F.col("joined"), "main:joined").when(F.col("role") == "main:continuation", F.when(folds, "main:continuation").otherwise("main:unmatched")).otherwise(F.col("role"))
    column = next((c for c in spec.get("columns") or [] if c.get("key") == "text"), None) if fixed else None
    tail = strip_all(F.col("line"), strips) if fixed else F.col("here")
    if column:
        broken = F.substring(F.col("here"), F.lit(column["from"] + 1), F.lit(column["to"] - column["from"]) if column.get("to") is not None else F.length("here"))
        broken = strip_all(broken, strips)
    else:
        broken = F.regexp_replace("here", start.pattern, "") if start else F.lit("")
    broken = trim(F.regexp_replace(broken, r"\s+", " "))
    number = F.regexp_extract(F.regexp_extract("here", start.pattern, 0), r"(\d+)", 1) if start else F.lit("")
    pairs = lambda r, line: F.create_map(*[x for k in r.fields for x in (F.lit(k), r.field(line, k))])
    fields = F.when(F.col("role").isin("main", "main:joined"), F.col("t")).when(F.col("role") == "main:malformed", F.create_map(F.lit("turn"), number, F.lit("speaker"), F.lit(""), F.lit("text"), broken))
    fields = fields.when(F.col("role") == "main:continuation", F.create_map(F.lit("text"), trim(tail)))
    fields = fields.when(F.col("role") == "header", F.create_map(F.lit("key"), header.field(F.col("line"), "key"), F.lit("value"), header.field(F.col("line"), "value")))
    if speaker:
        fields = fields.when(F.col("role") == "speakers", pairs(speaker, F.col("row")))
    f = f.withColumn("role", role).withColumn("fields", fields)
    return f.select("doc", "line_no", "line", "role", F.when(F.col("role").isin("main:joined", "main:continuation"), F.col("into")).alias("into"), "section", "fields")


def turns(parsed: DataFrame) -> DataFrame:
    """doc, line_no, section, fields, text, malformed: rows with what was joined or folded into them."""
    t = parsed.where(F.col("role").isin("main", "main:malformed", "main:joined", "main:continuation")).withColumn("owner", F.coalesce("into", "line_no"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.coalesce(F.col("fields")["text"], F.lit("")).alias("x")))), lambda p: p["x"])
    first = lambda c: F.min_by(c, "line_no")
    return t.groupBy("doc", F.col("owner").alias("line_no")).agg(
        first("section").alias("section"), first("fields").alias("fields"), trim(F.array_join(F.filter(parts, lambda x: x != ""), " ")).alias("text"), (first("role") == "main:malformed").alias("malformed")
    )


def speakers(parsed: DataFrame) -> DataFrame:
    """doc, line_no, code, fields; codes come from the code field or the id."""
    s = parsed.where("role = 'speakers'")
    return s.select("doc", "line_no", F.coalesce(F.nullif(F.col("fields")["code"], F.lit("")), F.regexp_replace(F.coalesce(F.col("fields")["id"], F.lit("")), "^#", "")).alias("code"), "fields")


def metadata(parsed: DataFrame) -> DataFrame:
    """doc, key, value: the last value of each header key."""
    return parsed.where("role = 'header'").groupBy("doc", F.col("fields")["key"].alias("key")).agg(F.max_by(F.col("fields")["value"], "line_no").alias("value"))


def rows(parsed: DataFrame, sections: dict[str, str] | None = None) -> DataFrame:
    """doc, row_no, turn_number, speaker_id, text, section, extra: as the built-in reader gives them."""
    who = speakers(parsed).select("doc", F.col("code").alias("speaker"), F.coalesce(F.nullif(F.col("fields")["id"], F.lit("")), F.concat(F.lit("#"), "code")).alias("resolved")).dropDuplicates(["doc", "speaker"])
    t = turns(parsed).withColumn("speaker", F.coalesce(F.col("fields")["speaker"], F.lit(""))).join(who, ["doc", "speaker"], "left")
    renamed = F.create_map(*[F.lit(x) for kv in (sections or {"PRELIMINARIES": "PRE", "POSTLIMINARIES": "POST"}).items() for x in kv])
    section = F.when(F.col("section") == "", "MAIN").otherwise(F.coalesce(renamed[F.col("section")], F.col("section")))
    declared = F.max(F.col("resolved").isNotNull()).over(Window.partitionBy("doc"))
    speaker = F.when(F.col("speaker") == "", "").otherwise(F.coalesce("resolved", F.when(declared, F.col("speaker")).otherwise(F.concat(F.lit("#"), "speaker"))))
    extra = F.map_filter("fields", lambda k, v: k.startswith("c_"))
    return t.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("line_no")).alias("row_no"), "line_no", F.coalesce(F.col("fields")["turn"], F.lit("")).alias("turn_number"), speaker.alias("speaker_id"), "text", section.alias("section"), extra.alias("extra"))


def trial(lines: DataFrame, grammar: dict) -> tuple[DataFrame, DataFrame]:
    """What a grammar finds in other documents, and what it misses: (doc, role, n, first_line), (doc, line_no, role, line) of the lines that match no pattern."""
    p = parse(lines, grammar)
    missed = p.where(F.col("role").endswith(":unmatched") | F.col("role").endswith(":malformed"))
    return p.groupBy("doc", "role").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line")), missed.select("doc", "line_no", "role", "line")


def saved(grammar: dict, marked_up_from: str | None, saved_at: str) -> dict:
    """The grammar as it is saved: with the version of the format, the document it was marked up from and the time."""
    return {**grammar, "version": VERSION, "generatedBy": "verbarium", "markedUpFrom": marked_up_from, "savedAt": saved_at}


# -- making a grammar from marked samples (on the driver) ----------------------------------------------------------------------------


def shape(text: str) -> str:
    """A pattern for text like this: digits, capitals and small letters generalised, the rest as it is."""
    out = []
    for m in re.finditer(r"\d+|[^\W\d_]+|\s+|.", text):
        t = m[0]
        out.append(r"\d+" if t.isdigit() else r"\p{L}+" if t.isalpha() else r"[\t ]+" if t.isspace() else exact(t))
    return "".join(out)


def exact(text: str) -> str:
    return re.sub(r"([\\^$.*+?()\[\]{}|/\-])", r"\\\1", text)


def field_order(samples: list[dict]) -> tuple[list[str], set[str]]:
    """The fields in the order that all samples keep, and those that some sample lacks."""
    orders = [[s["field"] for s in sorted(x["spans"], key=lambda s: s["start"])] for x in samples]
    order: list[str] = []
    for o in orders:
        for a, b in zip(o, o[1:]):
            if a in order and b in order and order.index(a) > order.index(b):
                raise ValueError(f"fields {b} and {a} are not in the same order in all samples")
        at = 0
        for f in o:
            if f in order:
                at = order.index(f) + 1
            else:
                order.insert(at, f)
                at += 1
    return order, {f for f in order if any(f not in o for o in orders)}


def gaps_before(samples: list[dict], field: str) -> list[str]:
    """The text between a field and what was marked before it, in each sample that has the field."""
    found = []
    for x in samples:
        spans = sorted(x["spans"], key=lambda s: s["start"])
        names = [s["field"] for s in spans]
        if field in names:
            k = names.index(field)
            found.append(x["line"][spans[k - 1]["end"] if k else 0 : spans[k]["start"]])
    return found


def row_pattern(samples: list[dict], fields: tuple[str, ...], optional: tuple[str, ...] = ()) -> dict:
    """A row's pattern from samples {line, spans: [{field, start, end}]}. Fields must keep their order; text between them that all samples
    share is taken as it is, blanks as blanks, other text as its shape; a field that some sample lacks is optional."""
    order, lacking = field_order(samples)
    missing = lacking | set(optional)

    def gap(field: str) -> str:
        found = set(gaps_before(samples, field))
        if len(found) == 1:
            g = found.pop()
            return re.sub(r"(?:\\?[\t ])+", r"[\\t ]+", exact(g)) if g.strip() else (r"[\t ]+" if g else "")
        return "[\\t ]*" if all(not g.strip() for g in found) else "(?:" + "|".join(sorted(shape(g) for g in found)) + ")"

    out, start = "^", None
    for k, f in enumerate(order):
        body = r"\d+" if f == "turn" else r"\S+" if f in ("code", "id", "speaker") else ".*" if k == len(order) - 1 else ".*?"
        part = f"{gap(f)}(?<{f}>{body})"
        out += f"(?:{part})?" if f in missing else part
        if k == 0 and f == "turn":
            start = f"^{part}"
    return {"pattern": out + r"[\t ]*$", "flags": "u", "fields": order, **({"rowStart": start + r"(?=[\t .]|$)"} if start else {})}


def fixed_columns(samples: list[dict]) -> list[dict]:
    """Columns of fixed-width rows: each field's widened to the neighbouring fields, then cut to what all samples allow."""
    found: dict[str, tuple[int, int | None]] = {}
    for x in samples:
        spans = sorted(x["spans"], key=lambda s: s["start"])
        for k, s in enumerate(spans):
            low = spans[k - 1]["end"] if k else 0
            high = spans[k + 1]["start"] if k + 1 < len(spans) else None
            a, b = found.get(s["field"], (0, None))
            found[s["field"]] = max(a, low), b if high is None else high if b is None else min(b, high)
    columns = sorted(({"key": k, "from": a, "to": b} for k, (a, b) in found.items()), key=lambda c: c["from"])
    for a, b in zip(columns, columns[1:]):
        a["to"] = b["from"] if a["to"] is None else min(a["to"], b["from"])
        if a["to"] <= a["from"]:
            raise ValueError(f"columns {a['key']} and {b['key']} overlap")
    return columns


def fixed_pattern(columns: list[dict]) -> dict:
    """A row's pattern from columns."""
    out = "^"
    at = 0
    for c in columns:
        out += f".{{{c['from'] - at}}}" if c["from"] > at else ""
        out += f"(?<{c['key']}>.{{0,{c['to'] - c['from']}}})" if c["to"] is not None else f"(?<{c['key']}>.*)"
        at = c["to"] or at
    return {"pattern": out + ".*$", "flags": "u", "fixedWidth": True, "columns": columns}


#: fixed values: the lines that open regions, and the one that ends a transcript, in the built-in convention
SPEAKERS_LINE, SECTION_LINE, END_LINE = r"(?i)speakers?\s*:?", r"[A-Z][A-Z ]{2,}", r"(?i)END OF TRANSCRIPT\b.*"


def suggest_regions(lines: list[str]) -> list[tuple[str | None, bool]]:
    """A first guess for each line: (region, is a marker), by the built-in convention.

    The first speakers line opens the speakers, each section line after it the main part; a line belongs to what was opened last, at first to the header.
    Blank lines belong there too, but have no region before anything is written; a line that ends the transcript is ignored.
    """
    said = [line.strip() for line in lines]
    like = lambda pattern: [bool(re.fullmatch(pattern, t, re.S)) for t in said]
    ends, speakers, sections = like(END_LINE), like(SPEAKERS_LINE), like(SECTION_LINE)
    first = next((k for k, found in enumerate(speakers) if found and not ends[k]), len(lines))
    opened = [("speakers" if k == first else "main" if k > first and sections[k] and not ends[k] else None) for k in range(len(lines))]
    region = list(accumulate(opened, lambda before, now: now or before, initial="header"))[1:]
    written = list(accumulate((bool(t) and not end for t, end in zip(said, ends)), or_))
    return [("ignore", False) if ends[k] else (region[k] if t or written[k] else None, opened[k] is not None) for k, t in enumerate(said)]


def build(name: str, speaker_samples: list[dict], turn_samples: list[dict], *, speakers_start: str | None = None, main_start: str | None = None, sections: list[str] = (), ignore: list[str] = (),
          strip: list[str] = (), drop: list[dict] = (), fixed_width: bool = False, join_repeats: bool = False, header_keys: list[str] = (), has_header: bool = True) -> dict:
    """A grammar from marked samples and markers."""
    turn = fixed_pattern(fixed_columns(turn_samples)) if fixed_width else row_pattern(turn_samples, TURN_FIELDS)
    if join_repeats:
        turn["joinRepeats"] = True
    return {
        "version": VERSION, "name": name or "default",
        "regions": {
            "layout": {"header": has_header, "speakers": bool(speaker_samples), "markers": bool(speakers_start or main_start or sections)},
            "header": {"keys": list(header_keys)}, "speakers": {"start": f"^{exact(speakers_start)}$" if speakers_start else None},
            "main": {"start": f"^{exact(main_start)}$" if main_start else None, "sectionPattern": "^(?:" + "|".join(map(exact, sections)) + ")$" if sections else None},
        },
        "ignore": list(dict.fromkeys(ignore)), "strip": [{"pattern": p, "flags": "u"} for p in strip], "dropColumns": [] if fixed_width else list(drop),
        "headerField": {"pattern": HEADER_FIELD, "flags": "u"}, "speakerRow": row_pattern(speaker_samples, SPEAKER_FIELDS) if speaker_samples else None, "turnRow": turn,
    }


def resolve(name: str | None, folder: dict[str, dict]) -> dict | None:
    """The named grammar among those of a folder; a missing one is an error, none asked for is the built-in reader."""
    if not name:
        return None
    if name not in folder:
        raise KeyError(f"no grammar named {name!r}")
    if problems := validate(folder[name]):
        raise ValueError("; ".join(problems))
    return folder[name]
