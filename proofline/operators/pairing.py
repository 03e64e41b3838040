"""Pairing of tool uses with results, by windows instead of a map of pending uses.

Within one tool id, in the order of the transcript, a result answers a use exactly if the token before it is a use: a use replaces
one that is still open, and a result closes it. A use is never answered if it is its id's last token; it then has the place of the
first use of its unbroken run, since replacing keeps the place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired(tokens: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """tokens with a boolean is_use and any columns, plus: use (struct of the answered use's columns, for results with one),
    orphan (true for uses that stay open) and place (struct of the order columns where an orphan stands)."""
    by = Window.partitionBy(*keys).orderBy(*order)
    at: Column = F.struct(*order)
    row = F.struct(*tokens.columns)
    out = tokens.withColumns({"__before": F.lag(row).over(by), "__next": F.lead("is_use").over(by)})
    starts = F.when(F.col("is_use") & ~F.coalesce(F.col("__before.is_use"), F.lit(False)), at)
    place = F.last(starts, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    use = F.when(~F.col("is_use") & F.col("__before.is_use"), F.col("__before"))
    return out.withColumns({"use": use, "orphan": F.col("is_use") & F.col("__next").isNull(), "place": place}).drop("__before", "__next")
