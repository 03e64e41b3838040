"""Clauses of a text, and the paths named in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofline.functions.patterns import js, match_spans

#: What ends a clause, and what looks like a path.
DELIMITER = r"[。\n、]|,\s*but\b|;\s*|\bhowever\b,?\s*"
PATH = r"\.?(?:[\w-]+\/)+(?:\*\*|\*|[\w-]+(?:\.[\w-]+)*)|\.?\b[\w-]+(?:\.[\w-]+)+\b"


def split_clauses(text: Column) -> Column:
    """array<struct<text, start, end>>, empty clauses included; offsets count code points."""
    parts = F.split(text, js(DELIMITER, True), -1)
    marks = match_spans(text, F.lit(js(DELIMITER, True)))

    def clause(part: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(marks, i - 1)["end"])
        return F.struct(part.alias("text"), start.alias("start"), (start + F.length(part)).alias("end"))

    return F.transform(parts, clause)


def clause_at(clauses: Column, index: Column) -> Column:
    """The first clause that holds the offset, else the last one."""
    inside = F.filter(clauses, lambda c: (index >= c["start"]) & (index < c["end"]))
    return F.coalesce(F.get(inside, F.lit(0)), F.element_at(clauses, -1))


def path_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(js(PATH)), F.lit(0)))
