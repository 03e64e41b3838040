"""Text for pages: escaped markup and JSON that is safe inside a script element."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def script_safe(json: Column) -> Column:
    return F.replace(json, F.lit("</"), F.lit("<\\/"))
