"""Text expressions: pre-tokens, lines, trimming, display values. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: runs of spaces, single line and tab characters, single signs, and maximal runs of anything else are pre-tokens; joined they give the text again.
PRETOKEN = r"""( +|[\n\r\t]|[()\[\]{};,:.=+\-*/<>!&|^~%@#?\\"'`]|[^ \n\r\t()\[\]{};,:.=+\-*/<>!&|^~%@#?\\"'`]+)"""
#: Parts keys of several words; a text can't hold it in a word that was typed.
SEPARATOR = "\u001f"


def pretokens(text: Column) -> Column:
    """ARRAY<STRING> of the pre-tokens of a text; null for a null text, [] for an empty one."""
    return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(1))


def trimmed(text: Column) -> Column:
    """A text without Unicode white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def text_lines(text: Column) -> Column:
    """The lines of a text: CR LF, LF and CR end one."""
    return F.split(F.regexp_replace(text, "\r\n|\r", "\n"), "\n")


def kept_lines(text: Column, longer_than: int) -> Column:
    """The trimmed lines of more than so many characters."""
    return F.filter(F.transform(text_lines(text), trimmed), lambda x: F.char_length(x) > longer_than)


def words(docs: DataFrame, *ids: str, text: str = "text") -> DataFrame:
    """One row for each pre-token: the ids, pos from 0, word."""
    return docs.select(*ids, F.posexplode(pretokens(F.col(text))).alias("pos", "word"))


def human_size(n: Column) -> Column:
    """Bytes with one decimal in the unit that fits, up to PB."""
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.lit(None).cast("string")
    for i, unit in reversed(list(enumerate(units))):
        out = F.when(n < 1024.0 ** (i + 1), F.concat(F.format_string("%.1f", n / 1024.0**i), F.lit(f" {unit}"))).otherwise(
            F.concat(F.format_string("%.1f", n / 1024.0 ** len(units)), F.lit(" PB")) if i == len(units) - 1 else out
        )
    return out


def human_duration(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.format_string("%.0fs", seconds))
        .when(seconds < 3600, F.format_string("%.1fm", seconds / 60))
        .otherwise(F.format_string("%.1fh", seconds / 3600))
    )


def bar(value: Column, total: Column, width: int = 28) -> Column:
    """Filled and empty blocks in proportion, none filled where TOTAL isn't positive."""
    share = F.when(total > 0, F.least(F.lit(1.0), value / total)).otherwise(0.0)
    filled = F.floor(share * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def sparkline(values: Column, width: int = 16) -> Column:
    """Blocks for the last values between the least and the greatest of all, filled up on the left; a line of dashes where there are none."""
    blocks = " ▁▂▃▄▅▆▇█"
    low, high = F.array_min(values), F.array_max(values)
    spread = F.when(high != low, high - low).otherwise(1.0)
    last = F.slice(values, F.greatest(F.lit(1), F.size(values) - width + 1), width)
    drawn = F.array_join(F.transform(last, lambda v: F.substring(F.lit(blocks), F.floor((v - low) / spread * (len(blocks) - 1)).cast("int") + 1, F.lit(1))), "")
    return F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, F.lit("─" * width)).otherwise(F.lpad(drawn, width, " "))


def trend(values: Column) -> Column:
    """Whether the last value is lower, higher or neither, against the one before."""
    now, before = F.try_element_at(values, F.lit(-1)), F.try_element_at(values, F.lit(-2))
    return F.when(now < before, "↓").when(now > before, "↑").otherwise("→")


def register(spark: SparkSession) -> None:
    """The table function pretokenize(text) for SQL: rows of pos and word."""
    pattern = PRETOKEN.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION pretokenize(txt STRING) RETURNS TABLE (pos INT, word STRING)
        RETURN SELECT * FROM posexplode(regexp_extract_all(txt, '{pattern}', 1))"""
    )
