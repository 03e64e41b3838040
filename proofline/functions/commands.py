"""Shell commands: their class, and whether they hide a failure."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofline.functions.dictionaries import COMMAND_CLASSES
from proofline.functions.patterns import collapse, js, trim

#: Heads that only show or search text, and endings that hide a failure.
SHOWS = r"^(echo|printf|rg|grep|cat|sed|less|more|head|tail)\b"
HIDES = r"\|\|\s*(true\b|exit\s+0\b)"


def segments(command: Column) -> Column:
    """The parts between ||, &&, ;, line feeds and |, trimmed, without empty ones."""
    parts = F.transform(F.split(command, r"\|\||&&|;|\n|\|", -1), trim)
    return F.filter(parts, lambda s: s != "")


def without_folder(segment: Column) -> Column:
    """The segment with the folders of its first word left out, if any name stays."""
    return F.regexp_replace(segment, js(r"^(?=\S*/)\S*/(?=[^\s/])"), "")


def segment_class(segment: Column, classes: Mapping[str, list[str]] = COMMAND_CLASSES) -> Column:
    bare = without_folder(segment)
    hit = lambda p: F.rlike(segment, F.lit(js(p, True))) | F.rlike(bare, F.lit(js(p, True)))
    out = F.when(hit(SHOWS), F.lit(None).cast("string"))
    for name, patterns in classes.items():
        out = out.when(hit("|".join(f"(?:{p})" for p in patterns)), F.lit(name))
    return out


def command_class(command: Column, classes: Mapping[str, list[str]] = COMMAND_CLASSES) -> Column:
    """null for no class, the one class of all segments, or composite for several."""
    found = F.array_distinct(F.filter(F.transform(segments(command), lambda s: segment_class(s, classes)), lambda c: c.isNotNull()))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).when(F.size(found) > 1, F.lit("composite"))


def suppressed(command: Column) -> Column:
    return F.rlike(command, F.lit(js(HIDES, True)))


def normalized(command: Column) -> Column:
    return collapse(F.coalesce(command, F.lit("")))
