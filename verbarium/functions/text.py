"""Scalar text functions with the string semantics of browser JavaScript, as Column expressions.

Rules followed throughout: white space is the Unicode set of JS_SPACE; lengths that are shown count UTF-16 units; rounding takes halves up;
word boundaries and `\\w`, `\\d` are ASCII; case-insensitive matching folds Unicode.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed value: white space in patterns of both Spark and the SQL used to check it
JS_SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: fixed value: a token
TOKEN = r"[\p{L}\p{M}\p{N}]+(?:['’-][\p{L}\p{M}\p{N}]+)*"
WORD_CHAR = "[A-Za-z0-9_]"
BOUNDARY = f"(?:(?<={WORD_CHAR})(?!{WORD_CHAR})|(?<!{WORD_CHAR})(?={WORD_CHAR}))"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim(x: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_col(x), rf"^[{JS_SPACE}]+|[{JS_SPACE}]+\z", "")


def squash(x: Column | str) -> Column:
    """Runs of white space become one space; ends trimmed."""
    return F.trim(F.regexp_replace(_col(x), f"[{JS_SPACE}]+", " "))


def words(x: Column | str) -> Column:
    """Parts between white space."""
    return F.array_remove(F.split(_col(x), f"[{JS_SPACE}]+"), "")


def units(x: Column | str) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(_col(x), "UTF-16BE")) / 2).cast("long")


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Math.round: halves go up, also below zero."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def to_number(x: Column | str) -> Column:
    """A cell as a number: commas and spaces dropped; blank is 0, hex is read, everything else that isn't a plain decimal is null."""
    t = trim(F.regexp_replace(_col(x), "[, ]", ""))
    plain = t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z")
    value = F.when(t == "", F.lit(0.0)).when(plain, t.try_cast("double")).when(t.rlike(r"^0[xX][0-9A-Fa-f]{1,15}\z"), F.conv(F.substring(t, 3, 15), 16, 10).cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def literal_pattern(text: str) -> str:
    """A pattern that matches exactly `text`."""
    return "".join(c if c.isalnum() or c in "_ " else f"\\x{{{ord(c):X}}}" for c in text)


class PatternError(ValueError):
    """A pattern that can't be expressed."""


#: Escapes that differ between the two dialects.
_OUTSIDE = {"b": BOUNDARY, "B": f"(?!{BOUNDARY})", "s": f"[{JS_SPACE}]", "S": f"[^{JS_SPACE}]", "/": "/"}


def java_pattern(pattern: str, flags: str = "") -> tuple[str, dict[str, str]]:
    """A JavaScript pattern as a Java one, and the new names of its named groups (Java allows no underscore in them)."""
    names: dict[str, str] = {}
    out: list[str] = []
    i, n, inside = 0, len(pattern), False
    while i < n:
        c, rest = pattern[i], pattern[i:]
        if c == "\\":
            if i + 1 == n:
                raise PatternError("the pattern ends with a backslash")
            e = pattern[i + 1]
            if m := re.match(r"\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})", rest):
                out.append(f"\\x{{{m[1] or m[2] or m[3]}}}")
                i += len(m[0])
                continue
            if m := re.match(r"\\k<([^>]+)>", rest):
                out.append(f"\\k<{names.get(m[1], m[1])}>")
                i += len(m[0])
                continue
            if m := re.match(r"\\([pP])\{(?:Script|sc|Script_Extensions|scx)=(\w+)\}", rest):
                out.append(f"\\{m[1]}{{Is{m[2]}}}")
                i += len(m[0])
                continue
            if inside and e == "s":
                out.append(JS_SPACE)
            elif inside and e == "b":
                out.append(r"\x08")
            elif inside and e == "S":
                raise PatternError(r"\S inside a class")
            else:
                out.append(_OUTSIDE.get(e, "\\" + e) if not inside else "\\" + e)
            i += 2
            continue
        if inside:
            if c == "]":
                inside = False
            elif c in "[&":
                c = "\\" + c
            out.append(c)
        elif c == "[":
            if rest.startswith("[^]"):
                out.append(r"[\x{0}-\x{10FFFF}]")
                i += 3
                continue
            if rest.startswith("[]"):
                out.append("(?!)")
                i += 2
                continue
            inside = True
            out.append("[^" if rest.startswith("[^") else "[")
            i += 2 if rest.startswith("[^") else 1
            continue
        elif m := re.match(r"\(\?<([A-Za-z_$][\w$]*)>", rest):
            names[m[1]] = f"g{len(names)}"
            out.append(f"(?<{names[m[1]]}>")
            i += len(m[0])
            continue
        elif c == "$":
            out.append(r"(?=[\n\r\x{2028}\x{2029}]|\z)" if "m" in flags else r"\z")
        elif c == "^" and "m" in flags:
            out.append(r"(?<=[\n\r\x{2028}\x{2029}]|^)")
        elif c == "." and "s" not in flags:
            out.append(r"[^\n\r\x{2028}\x{2029}]")
        elif c == ".":
            out.append(r"[\x{0}-\x{10FFFF}]")
        else:
            out.append(c)
        i += 1
    if inside:
        raise PatternError("a class is not closed")
    return ("(?iu)" if "i" in flags else "") + "".join(out), names


def check_pattern(spark, pattern: str) -> str | None:
    """What is wrong with a Java pattern, or None; asked before a plan is built."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:  # the gateway's exception type depends on the version
        return str(getattr(e, "java_exception", e)).splitlines()[0]
    return None


def java_replacement(text: str) -> str:
    """A JavaScript replacement string as a Java one."""
    out, i = [], 0
    while i < len(text):
        if m := re.match(r"\$(\$|&|\d{1,2}|<\w+>|`|')", text[i:]):
            k = m[1]
            if k in "`'":
                raise PatternError(f"replacement ${k} has no counterpart")
            out.append("\\$" if k == "$" else "$0" if k == "&" else "${" + k[1:-1] + "}" if k[0] == "<" else f"${k}")
            i += len(m[0])
        else:
            out.append("\\" + text[i] if text[i] in "\\$" else text[i])
            i += 1
    return "".join(out)


def slug(x: Column | str) -> Column:
    """Lower case, runs of anything but letters and digits of ASCII become a hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(trim(x)), "[^a-z0-9]+", "-"), r"^-+|-+\z", "")
