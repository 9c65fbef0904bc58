"""Ignore-file patterns as regular expressions over relative paths.

Patterns follow the public rules of ignore files: a pattern without an inner slash matches at any
depth, one with a leading or inner slash is anchored at the root, a trailing slash means
"directories only", ``*`` and ``?`` stop at a slash, ``**`` crosses slashes, a match on a directory
covers all below it, and ``!`` re-includes what an earlier pattern excluded unless a parent
directory stays excluded. The strings are compiled once on the driver; rows see one regex.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    body: str
    negated: bool
    directory_only: bool


def _translate(glob: str) -> str:
    out, i = [], 0
    while i < len(glob):
        rest = glob[i:]
        if rest.startswith("**/") and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
        elif rest == "**" and (i == 0 or glob[i - 1] == "/"):
            out.append(".+")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        elif glob[i] == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            members = glob[i + 1 : end]
            negate = members[0] in "!^"
            members = members[negate:].replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^")
            out.append(f"[^/{members}]" if negate else f"[{members}]")
            i = end + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out.append(re.escape(glob[i + 1]))
            i += 2
        else:
            out.append(re.escape(glob[i]))
            i += 1
    return "".join(out)


def parse_pattern(text: str) -> Pattern | None:
    """One pattern line; None for blank lines and comments."""
    line = text.rstrip("\n")
    if not line.endswith("\\ "):
        line = line.rstrip(" ")
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    if negated:
        line = line[1:]
    directory_only = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    line = line.lstrip("/")
    prefix = "" if anchored else "(?:[^/]+/)*"
    return Pattern(prefix + _translate(line), negated, directory_only)


def parse_patterns(patterns: Iterable[str]) -> list[Pattern]:
    return [p for p in map(parse_pattern, patterns) if p is not None]


def compile_patterns(patterns: Iterable[str]) -> str | None:
    """One regex for a list without ``!`` patterns; None when nothing is left to match."""
    parsed = parse_patterns(patterns)
    if any(p.negated for p in parsed):
        raise ValueError("negated patterns need matches(), not one regex")
    if not parsed:
        return None
    parts = [p.body + ("/.*" if p.directory_only else "(?:/.*)?") for p in parsed]
    return r"(?s)\A(?:" + "|".join(parts) + r")\z"


def matches(path: Column, patterns: Iterable[str]) -> Column:
    """True where the list selects the path."""
    parsed = parse_patterns(patterns)
    if not parsed:
        return F.lit(False)
    if not any(p.negated for p in parsed):
        return path.rlike(compile_patterns(patterns))

    def verdict(prefix: Column, is_directory: Column) -> Column:
        # the last pattern that matches decides, so test from the end
        chain = None
        for p in reversed(parsed):
            hit = prefix.rlike(r"(?s)\A(?:" + p.body + r")\z")
            if p.directory_only:
                hit = hit & is_directory
            chain = F.when(hit, F.lit(not p.negated)) if chain is None else chain.when(
                hit, F.lit(not p.negated)
            )
        return chain.otherwise(F.lit(False))

    parts = F.split(path, "/")
    depth = F.size(parts)
    return F.exists(
        F.sequence(F.lit(1), depth),
        lambda n: verdict(F.array_join(F.slice(parts, F.lit(1), n), "/"), n < depth),
    )


#: The type of a list of rules in a column.
RULES = "array<struct<body:string,negated:boolean,folder:boolean>>"


def rule_list(patterns: Iterable[str]) -> list[tuple[str, bool, bool]]:
    """The patterns as the rows of a rules column, in order."""
    return [(r"(?s)\A(?:" + p.body + r")\z", p.negated, p.directory_only) for p in parse_patterns(patterns)]


def matches_rules(path: Column, rules: Column) -> Column:
    """``matches`` with the rules of each row's own column: the last rule that matches decides, and a folder that stays excluded takes all below with it."""
    parts = F.split(path, "/")
    depth = F.size(parts)

    def verdict(n: Column) -> Column:
        prefix = F.array_join(F.slice(parts, F.lit(1), n), "/")
        hits = F.filter(rules, lambda r: F.rlike(prefix, r["body"]) & (~r["folder"] | (n < depth)))
        return F.coalesce(~F.get(hits, F.size(hits) - 1)["negated"], F.lit(False))

    return F.exists(F.sequence(F.lit(1), depth), verdict)
