"""Glob patterns as regular expressions.

Two dialects are kept apart:

* the *plain* dialect of exclude rules: ``*`` and ``?`` stay inside one path
  element, ``[...]`` is a character class, ``\\`` escapes, a malformed pattern
  matches nothing;
* the *extended* dialect of match rules: the plain match, or else a second
  reading in which ``**`` crosses slashes and brackets and braces are literal.

Patterns that come as configuration are compiled on the driver, to syntax that Java
and Python read alike, as the walk of a file tree needs them too. Patterns that come as
a column are compiled by Spark. Regexes are unanchored; callers add the anchors of
their engine.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

GLOB_CHARS = "*?[{"

_CLASS_ITEM = re.compile(r"(?P<lo>\\.|[^\]\\-])(?:-(?P<hi>\\.|[^\]\\-]))?", re.DOTALL)
# Never true, in both regex engines.
_NEVER = "(?!)"


def _class_char(char: str) -> str:
    return char if char.isalnum() else "\\" + char


def _compile_class(pattern: str, start: int, may_cross: bool) -> tuple[str, int] | None:
    """Regex of the class whose ``[`` is at ``start``, and the index after its ``]``."""
    at = start + 1
    negated = pattern.startswith("^", at)
    at += negated
    items = []
    while True:
        item = _CLASS_ITEM.match(pattern, at)
        if item is None:
            return None
        lo, hi = item["lo"][-1], (item["hi"] or item["lo"])[-1]
        if lo <= hi:
            items.append(f"{_class_char(lo)}-{_class_char(hi)}")
        at = item.end()
        if pattern.startswith("]", at):
            break
    guard = "" if may_cross else "(?!/)"
    if items:
        body = f"[{'^' if negated else ''}{''.join(items)}]"
    else:
        body = r"[\s\S]" if negated else _NEVER
    return guard + body, at + 1


def plain_glob_regex(pattern: str, may_cross: bool = True) -> str | None:
    """Unanchored regex of a plain glob, or None if the pattern is malformed.

    A class may match a slash when a whole path is tested; with ``may_cross=False``
    it may not, which is what a test against single path elements needs.
    """
    parts, at = [], 0
    while at < len(pattern):
        char = pattern[at]
        if char == "[":
            compiled = _compile_class(pattern, at, may_cross)
            if compiled is None:
                return None
            part, at = compiled
            parts.append(part)
            continue
        if char == "\\":
            at += 1
            if at == len(pattern):
                return None
            parts.append(re.escape(pattern[at]))
        elif char == "/" and not may_cross:
            parts.append(_NEVER)
        else:
            parts.append({"*": "[^/]*", "?": "[^/]"}.get(char) or re.escape(char))
        at += 1
    return "".join(parts)


_ANY = r"[\s\S]"
_ITEM = rf"(?:\\{_ANY}|[^\]\\-])(?:-(?:\\{_ANY}|[^\]\\-]))?"
_TOKEN = rf"\\{_ANY}|\[\^?+(?:{_ITEM})+\]|[^\\\[]"


def _code(char: Column) -> Column:
    return F.concat(F.lit(r"\x{"), F.hex(F.ascii(char)), F.lit("}"))


def _class_regex(token: Column) -> Column:
    negated = token.startswith("[^")
    items = F.regexp_extract_all(F.regexp_replace(token, r"^\[\^?|\]$", ""), F.lit(_ITEM), 0)
    bounds = F.transform(
        items,
        lambda item: F.struct(
            F.regexp_extract(item, rf"^\\?({_ANY})", 1).alias("lo"),
            F.regexp_extract(item, rf"({_ANY})\z", 1).alias("hi"),
        ),
    )
    ranges = F.transform(
        F.filter(bounds, lambda b: F.ascii(b["lo"]) <= F.ascii(b["hi"])),
        lambda b: F.concat(_code(b["lo"]), F.lit("-"), _code(b["hi"])),
    )
    opened = F.when(negated, F.lit("[^")).otherwise(F.lit("["))
    return (
        F.when(F.size(ranges) > 0, F.concat(opened, F.array_join(ranges, ""), F.lit("]")))
        .when(negated, F.lit(_ANY))
        .otherwise(F.lit(_NEVER))
    )


def plain_glob_regex_column(pattern: Column) -> Column:
    """:func:`plain_glob_regex` for a column of patterns; NULL for a malformed one."""
    tokens = F.regexp_extract_all(pattern, F.lit(_TOKEN), 0)
    regexes = F.transform(
        tokens,
        lambda token: F.when(token == "*", F.lit("[^/]*"))
        .when(token == "?", F.lit("[^/]"))
        .when(token.startswith("["), _class_regex(token))
        .otherwise(_code(F.substring(token, -1, 1))),
    )
    # A pattern is well formed if its tokens leave nothing out.
    return F.when(F.array_join(tokens, "") == pattern, F.array_join(regexes, ""))


def extended_glob_regex(pattern: Column) -> Column:
    """The second reading of an extended glob as an unanchored regex column.

    Its only tokens are ``**``, ``*`` and ``?``; every other character stands for itself.
    """
    tokens = F.regexp_extract_all(pattern, F.lit(rf"\*\*|{_ANY}"), 0)
    regexes = F.transform(
        tokens,
        lambda token: F.when(token == "**", F.lit(r"[^\n]*"))
        .when(token == "*", F.lit("[^/]*"))
        .when(token == "?", F.lit("[^/]"))
        .otherwise(_code(token)),
    )
    return F.array_join(regexes, "")


_EXTENDED_TOKENS = {"**": r"[^\n]*", "*": "[^/]*", "?": "[^/]"}


def extended_glob_text(pattern: str) -> str | None:
    """:func:`extended_glob_regex` of a configured pattern; None if it is no glob."""
    if not any(char in pattern for char in GLOB_CHARS):
        return None
    tokens = re.findall(r"\*\*|[\s\S]", pattern)
    return "".join(_EXTENDED_TOKENS.get(token) or re.escape(token) for token in tokens)


def is_glob(pattern: Column) -> Column:
    """True if the pattern has any of ``* ? [ {``."""
    return pattern.rlike(r"[*?\[{]")


@dataclass(frozen=True)
class ExcludeRules:
    """Exclude patterns folded into one regex for names and one for whole paths."""

    names: str | None
    paths: str | None

    @classmethod
    def of(cls, patterns: list[str] | tuple[str, ...]) -> ExcludeRules:
        # Nothing has an empty name or path, so an empty pattern excludes nothing.
        sound = [p for p in patterns if p and plain_glob_regex(p) is not None]
        # A pattern with neither slash nor class can only match a path that is itself a
        # name, so the test of whole paths is left to the others.
        names = [plain_glob_regex(p, may_cross=False) for p in sound]
        paths = [plain_glob_regex(p) for p in sound if "/" in p or "[" in p]
        return cls("|".join(names) or None, "|".join(paths) or None)
