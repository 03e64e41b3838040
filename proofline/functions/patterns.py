"""ECMAScript regular expressions in Spark.

Spark's engine reads word boundaries, white space and the dot otherwise; js() rewrites those. Patterns here use positive-width
matches, so splitting and extracting see the same places.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ECMAScript white space and line ends.
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
DOT = r"[^\n\r\x{2028}\x{2029}]"


def js(pattern: str, ignore_case: bool = False) -> str:
    """The pattern with the meaning that it has in ECMAScript."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            pair = pattern[i : i + 2]
            out.append({"\\s": SPACE if inside else f"[{SPACE}]", "\\S": f"[^{SPACE}]", "\\b": EDGE}.get(pair, pair) if not (inside and pair == "\\b") else pair)
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        elif c == "[" and inside:
            c = "\\["
        if not inside and c == ".":
            c = DOT
        elif not inside and c == "$":
            c = r"\z"
        out.append(c)
        i += 1
    return ("(?i)" if ignore_case else "") + "".join(out).replace("[\\S\\s]", "(?s:.)").replace(f"[{SPACE}[^{SPACE}]]", "(?s:.)")


def required(pattern: str) -> list[str]:
    """Literals of which every match of the pattern contains one at least; empty if that can't be told."""
    from re import _constants as op
    from re import _parser as parser

    def of(items) -> list[str]:  # noqa: ANN001
        found, run = [], ""
        for kind, value in [*items, (None, None)]:
            if kind is op.LITERAL:
                run += chr(value)
                continue
            found.append([run] if run else [])
            run, more = "", []
            if kind is op.SUBPATTERN:
                more = of(value[-1])
            elif kind is op.MAX_REPEAT and value[0] > 0:
                more = of(value[2])
            elif kind is op.BRANCH:
                each = [of(x) for x in value[1]]
                more = [x for part in each for x in part] if all(each) else []
            found.append(more)
        return max(found, key=lambda x: (min(map(len, x), default=0), -len(x)))

    return of(parser.parse(pattern))


def may_match(text: Column, lower: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether the text, or its small letters, holds what every match contains: much cheaper than to match."""
    words = required(pattern.lower() if ignore_case else pattern)
    out = F.lit(not words)
    for word in words:
        out = out | F.contains(lower if ignore_case else text, F.lit(word))
    return out


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def collapse(text: Column) -> Column:
    """Trimmed, with each run of white space as one space."""
    return F.regexp_replace(trim(text), f"[{SPACE}]+", " ")


def match_spans(text: Column, pattern: Column) -> Column:
    """array<struct<start, end, text>> of all matches; offsets count code points from 0."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.slice(F.split(text, pattern, F.lit(-1)), F.lit(1), F.size(found)), lambda g: F.length(g))
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("text"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int, text: string>>").alias("out"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + pair["gap"]
        end = begin + F.length(pair["text"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), pair["text"].alias("text")))).alias("out"))

    return F.aggregate(pairs, start, step, lambda s: s["out"])


def escape(text: str) -> str:
    return re.sub(r"[.*+?^${}()|\[\]\\]", lambda m: "\\" + m[0], text)


def glob_pattern(glob: Column) -> Column:
    """A path glob as a pattern: ** any text, * any text without a slash, a trailing slash all below it; ? stays a quantifier."""
    whole = F.when(glob.endswith("/"), F.concat(glob, F.lit("**"))).otherwise(glob)
    literal = F.regexp_replace(whole, r"([.+^${}()|\[\]\\])", r"\\$1")
    starred = F.replace(F.replace(F.replace(literal, F.lit("**"), F.lit("\x01")), F.lit("*"), F.lit("[^/]*")), F.lit("\x01"), F.lit(DOT + "*"))
    return F.concat(F.lit("(?i)(?:^|/)"), starred, F.lit(r"\z"))


def matches_any(path: Column, globs: Column) -> Column:
    return F.coalesce(F.exists(globs, lambda g: F.rlike(path, glob_pattern(g))), F.lit(False))
