"""Page templates compiled to column expressions, so that pages are made where their rows are, without a row of Python.

A template is text with tags: `{{name}}` a column or field as HTML text, `{{{name}}}` as it is, `{{#each names}}...{{/each}}` its body for each element of an array (`{{this}}`, or the
fields of an element that is a struct; `{{@index}}`, from 0), `{{#if name}}...{{else}}...{{/if}}` by whether it is set (null, false, zero, an empty text and an empty array aren't), `{{! ... }}` nothing. Names in a body
are looked up in the innermost element first, then outside. A template that isn't whole, or that names what isn't there, is an error before anything runs.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, NumericType, StringType, StructType

_TAG = re.compile(r"\{\{\{\s*([^{}]+?)\s*\}\}\}|\{\{\s*([^{}]*?)\s*\}\}", re.S)


class TemplateError(ValueError):
    """A template that can't be compiled."""


@dataclass
class Node:
    kind: str  # text, value, raw, each, if
    name: str = ""
    body: list[Node] = field(default_factory=list)
    other: list[Node] = field(default_factory=list)


def parse(template: str) -> list[Node]:
    top = Node("top")
    open_, at = [(top, top.body)], 0
    for m in _TAG.finditer(template):
        if m.start() > at:
            open_[-1][1].append(Node("text", template[at : m.start()]))
        at = m.end()
        raw, tag = m.groups()
        if raw:
            open_[-1][1].append(Node("raw", raw))
        elif found := re.fullmatch(r"#(each|if)\s+(\S+)", tag):
            node = Node(*found.groups())
            open_[-1][1].append(node)
            open_.append((node, node.body))
        elif tag == "else" and open_[-1][0].kind == "if" and open_[-1][1] is open_[-1][0].body:
            open_[-1] = (open_[-1][0], open_[-1][0].other)
        elif tag in ("/each", "/if") and open_[-1][0].kind == tag[1:]:
            open_.pop()
        elif re.fullmatch(r"[@\w.:-]+", tag) and tag != "else":
            open_[-1][1].append(Node("value", tag))
        elif not tag.startswith("!"):
            raise TemplateError(f"{{{{{tag}}}}} at {m.start()} doesn't belong there")
    if len(open_) > 1:
        raise TemplateError(f"{{{{#{open_[-1][0].kind} {open_[-1][0].name}}}}} isn't closed")
    if at < len(template):
        top.body.append(Node("text", template[at:]))
    return top.body


def escaped(text: Column) -> Column:
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(c), F.lit(entity))
    return text


#: How a name is looked up: its column and type, or None.
Scope = Callable[[str], "tuple[Column, DataType] | None"]


def _fields(kind: StructType, of: Callable[[str], Column]) -> Scope:
    def look(name: str) -> tuple[Column, DataType] | None:
        head, _, rest = name.partition(".")
        exact = next((n for n in (name, head) if n in kind.fieldNames()), None)
        if exact is None:
            return None
        value, t = of(exact), kind[exact].dataType
        for part in rest.split(".") if exact == head and rest else []:
            if not isinstance(t, StructType) or part not in t.fieldNames():
                return None
            value, t = value[part], t[part].dataType
        return value, t

    return look


def _found(name: str, scopes: list[Scope]) -> tuple[Column, DataType]:
    for scope in reversed(scopes):
        if found := scope(name):
            return found
    raise TemplateError(f"there is no {name}")


def _is_set(value: Column, kind: DataType) -> Column:
    if isinstance(kind, ArrayType):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    if isinstance(kind, StringType):
        return F.coalesce(value != "", F.lit(False))
    if isinstance(kind, BooleanType):
        return F.coalesce(value, F.lit(False))
    return F.coalesce(value != 0, F.lit(False)) if isinstance(kind, NumericType) else value.isNotNull()


def _body(nodes: list[Node], element: DataType, scopes: list[Scope]) -> Callable[[Column, Column], Column]:
    """The text of a list's element and its index."""

    def body(x: Column, k: Column) -> Column:
        own = lambda name: (x, element) if name == "this" else (k, IntegerType()) if name == "@index" else None
        return _built(nodes, [*scopes, *([_fields(element, lambda f: x[f])] if isinstance(element, StructType) else []), own])

    return body


def _built(nodes: list[Node], scopes: list[Scope]) -> Column:
    parts = []
    for n in nodes:
        if n.kind == "text":
            parts.append(F.lit(n.name))
            continue
        value, kind = _found(n.name, scopes)
        if n.kind == "if":
            parts.append(F.when(_is_set(value, kind), _built(n.body, scopes)).otherwise(_built(n.other, scopes)))
        elif n.kind == "each":
            if not isinstance(kind, ArrayType):
                raise TemplateError(f"{n.name} isn't a list")
            parts.append(F.array_join(F.transform(F.coalesce(value, F.array().cast(kind)), _body(n.body, kind.elementType, scopes)), ""))
        else:
            if isinstance(kind, (ArrayType, StructType)):
                raise TemplateError(f"{n.name} is no single value")
            text = F.coalesce(value.cast("string"), F.lit(""))
            parts.append(text if n.kind == "raw" else escaped(text))
    return F.concat(*parts) if parts else F.lit("")


def render(rows: DataFrame, template: str) -> Column:
    """The template's text for each row of `rows`."""
    return _built(parse(template), [_fields(rows.schema, lambda name: rows["`" + name.replace("`", "``") + "`"])])


def chosen(own: str | None, folder: str | None, bundled: str) -> str:
    """The template in use: one that was given, else the folder's, else the built-in one; blank ones don't count."""
    return next((t for t in (own, folder) if t and t.strip()), bundled)


#: A page for an entity with its properties.
PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>{{name}}</title></head><body><h1>{{name}}</h1>{{#if types}}<p>{{#each types}}{{#if @index}}, {{/if}}{{this}}{{/each}}</p>{{/if}}<dl>{{#each props}}<dt>{{key}}</dt>{{#each values}}<dd>{{#if ref}}<a href="{{ref}}">{{ref}}</a>{{else}}{{value}}{{/if}}</dd>{{/each}}{{/each}}</dl></body></html>"""


def entity_rows(entity: DataFrame, prop: DataFrame) -> DataFrame:
    """id, types, name, props (key, values (value, ref)) of each entity, keys and values in order: what page templates are made for. An entity's properties are one row."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("ord", "value", "ref"))), lambda x: F.struct(x["value"].alias("value"), x["ref"].alias("ref")))
    by_key = prop.groupBy("id", "key").agg(values.alias("values"))
    lists = by_key.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("key", "values"))).alias("props"))
    named = F.get(F.get(F.filter("props", lambda p: p["key"] == "name"), F.lit(0))["values"], F.lit(0))["value"]
    return entity.join(lists, "id", "left").select("id", "types", F.coalesce(named, "id").alias("name"), "props")


def pages(entity: DataFrame, prop: DataFrame, template: str = PAGE) -> DataFrame:
    """id, html."""
    rows = entity_rows(entity, prop)
    return rows.select("id", render(rows, template).alias("html"))
