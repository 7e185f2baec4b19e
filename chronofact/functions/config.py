"""Reading of configuration files: JSON with comments as column expressions, indented files by a stack in Python."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stand for an escaped backslash and an escaped quote while strings are told from comments; their own escapes are put in their place before.
_BACKSLASH, _QUOTE = "\ue001", "\ue002"
_STRING = r'("[^"]*+")'


def jsonc(text: Column) -> Column:
    """JSON of a text with comments and trailing commas. Strings, whatever stands in them, stay as they are; a comment that isn't closed goes on to the end.

    Strings and comments are alternatives of one pattern, so neither is looked for within the other. No part of it nests, so it needs no stack however long the text is.
    """
    for mark, escape in ((_BACKSLASH, "\\ue001"), (_QUOTE, "\\ue002")):
        text = F.replace(text, F.lit(mark), F.lit(escape))
    held = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    bare = F.regexp_replace(held, _STRING + r"|//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)", "$1")
    bare = F.regexp_replace(bare, _STRING + r"|,(?=\s*+[}\]])", "$1")
    return F.replace(F.replace(bare, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def scalar(json: Column, path: str) -> Column:
    """A string, number or boolean at a path; null for objects and arrays."""
    return F.when(~F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), path, "variant")).rlike("^(OBJECT|ARRAY)"), F.lit(True)), F.get_json_object(json, path))


def strings(json: Column, path: str, most: int = 50) -> Column:
    """The strings of an array at a path that aren't blank, the first `most`; null if there are none."""
    found = F.filter(F.try_variant_get(F.try_parse_json(json), path, "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    kept = F.slice(F.filter(F.transform(found, lambda x: F.try_variant_get(x, "$", "string")), lambda s: F.trim(s) != ""), 1, most)
    return F.when(F.size(kept) > 0, kept)


def section(text: Column, name: str) -> Column:
    """The lines of an INI or TOML file between the header [name] and the next header; null without that header."""
    lines = F.split(text, r"\r?\n", -1)
    start = F.array_position(F.transform(lines, lambda x: F.trim(x)), f"[{name}]")
    rest = F.slice(lines, F.when(start > 0, start + 1).otherwise(1).cast("int"), F.size(lines))
    end = F.array_position(F.transform(rest, lambda x: x.rlike(r"^\s*\[[^\]]+\]\s*$")), True)
    return F.when(start > 0, F.when(end > 0, F.slice(rest, 1, (end - 1).cast("int"))).otherwise(rest))


def without_comment(line: str) -> str:
    """A YAML line up to a # that no quotes hold."""
    if "#" not in line:
        return line
    quote = ""
    for i, c in enumerate(line):
        if c == quote:
            quote = ""
        elif not quote and c in "'\"":
            quote = c
        elif c == "#" and not quote:
            return line[:i]
    return line


_KEY = re.compile(r"""((?:-\s+)*)([A-Za-z0-9_."'/-]+):(?:\s+(.*))?$""")


def indented(text: str, comments: bool = True) -> Iterator[tuple[list[str], str, str]]:
    """(keys above, key, value) of each entry of an indented file, and (keys above, "-", item) of each plain item of a list.

    A value that begins with | or > yields its deeper lines, one by one, as (keys above and the key, "|", line); so does one without a value, of
    its lines that are no entries. With `comments` what follows a # is left out. One pass, one stack of the open keys.
    """
    stack: list[tuple[int, str]] = []
    block: int | None = None
    for raw in text.split("\n"):
        if not raw.strip():
            continue
        indent = len(raw) - len(raw.lstrip())
        if block is not None and indent > block:
            yield [k for _, k in stack], "|", raw.strip()
            continue
        block = None
        line = (without_comment(raw) if comments else raw).strip()
        if not line or line.startswith("#"):
            continue
        found = _KEY.match(line)
        at = indent + len(found[1]) if found else indent
        while stack and stack[-1][0] >= (at if found else indent + 1):
            stack.pop()
        above = [k for _, k in stack]
        if found:
            key, value = found[2].strip("\"'"), (found[3] or "").strip()
            yield above, key, value
            stack.append((at, key))
            if value[:1] in ("|", ">"):
                block = indent
        else:
            yield above, *(("-", line[1:].strip()) if line.startswith("-") else ("|", line))


def unquoted(value: str) -> str:
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
