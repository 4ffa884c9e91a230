"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

__all__ = ["label", "spellings", "spread"]

#: Rows from which a table of spellings is no longer taken into a plan as a constant.
MOST_SPELLINGS = 100_000


def spellings(aliases: DataFrame) -> dict[str, str]:
    """What each alias stands for, of a configuration table (alias, lang). One of more than MOST_SPELLINGS rows is refused, none is left out."""
    rows = aliases.select("alias", "lang").where("alias IS NOT NULL AND lang IS NOT NULL").distinct().limit(MOST_SPELLINGS + 1).collect()
    if len(rows) > MOST_SPELLINGS:
        raise ValueError(f"over {MOST_SPELLINGS} spellings are no configuration table")
    return {r["alias"]: r["lang"] for r in sorted(rows)}


def label(column: Column, missing: str = "(none)") -> Column:
    """A text label in lower case without outer white space; null, blank and the words for an unknown value give MISSING."""
    clean = F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))
    return F.when(clean.isNull() | clean.isin("", "unknown", "und", "n/a", "?", "none"), F.lit(missing)).otherwise(clean)
