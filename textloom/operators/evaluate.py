"""Perplexity, coverage, sanity of generations, convergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SEPARATOR, trimmed
from .joins import evenly
from .ngrams import packed_array, totals
from .predict import weight

#: The probability of a token that was never seen, the share of such tokens beyond which a perplexity is infinite, and the least tokens of a text.
UNSEEN, MOST_UNSEEN, LEAST_TOKENS = 1e-10, 0.5, 5


def target_probabilities(tests: DataFrame, table: DataFrame, test_id: str, tokens: str = "tokens", ids: bool = False) -> DataFrame:
    """test_id, pos, p of every position from the fifth: two look-up joins, no ranking of predictions; common contexts are joined by broadcast."""
    windows = F.expr(f"transform(sequence(5, size(`{tokens}`)), i -> named_struct('pos', i - 1, 'w', slice(`{tokens}`, i - 4, 5)))")
    numbered = tests.where(F.size(tokens) >= LEAST_TOKENS).select(test_id, F.explode(windows).alias("x")).select(test_id, "x.pos", "x.w")
    suffix = F.explode(F.expr("transform(sequence(2, 5), k -> named_struct('ord', k, 'g', slice(w, 6 - k, k - 1)))"))
    asked = numbered.select(test_id, "pos", F.element_at("w", 5).alias("next"), suffix.alias("s")).select(
        test_id, "pos", "s.ord", (packed_array(F.col("s.g")) if ids else F.array_join("s.g", SEPARATOR)).alias("ctx"), "next"
    )
    counted = evenly(asked, table.select("ord", "ctx", "next", "cnt"), ["ord", "ctx", "next"], F.col("cnt"), how="left")
    hits = evenly(counted, totals(table), ["ord", "ctx"], F.col("total"), how="left")
    return hits.groupBy(test_id, "pos").agg(F.sum(weight(F.col("ord")) * F.coalesce("cnt", F.lit(0)) / F.coalesce("total", F.lit(1))).alias("p"))


def scores(tests: DataFrame, table: DataFrame, test_id: str, tokens: str = "tokens", ids: bool = False) -> DataFrame:
    """test_id, perplexity, coverage; with IDS the tokens are ids and the table's contexts packed. An infinite perplexity (under five tokens, or over half of them unseen) is null; the coverage under five tokens is 0."""
    p = target_probabilities(tests, table, test_id, tokens, ids)
    seen = F.col("p") > 0
    each = p.groupBy(test_id).agg(
        F.exp(-F.avg(F.log(F.when(seen, F.col("p")).otherwise(UNSEEN)))).alias("perplexity"), F.avg(seen.cast("double")).alias("coverage")
    )
    finite = F.col("coverage") >= 1 - MOST_UNSEEN
    return tests.select(test_id).join(each, test_id, "left").select(test_id, F.when(finite, F.col("perplexity")).alias("perplexity"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def is_sane(text: Column) -> Column:
    """Whether a generation has three bytes, a tenth of them letters, and no character that makes up over four fifths of its bytes at its head. Null gives false."""
    clean = trimmed(text)
    size = F.octet_length(clean)
    letters = F.char_length(F.regexp_replace(clean, r"\P{L}", ""))
    first = F.substring(clean, 1, 1)
    same = F.char_length(clean) - F.char_length(F.replace(clean, first, F.lit("")))
    return F.coalesce((size >= 3) & (letters / size >= 0.1) & (same / size <= 0.8), F.lit(False))


def convergence(history: DataFrame, run: list[str], epoch: str, perplexity: str, sane: Column | None = None) -> DataFrame:
    """The rows of HISTORY with delta, the relative change against the epoch before, and converged: finite, changed by under 1 % and sane. A change from infinity (null) counts as -1."""
    before = F.lag(perplexity).over(Window.partitionBy(*run).orderBy(epoch))
    first = F.row_number().over(Window.partitionBy(*run).orderBy(epoch)) == 1
    delta = F.when(first, None).when(before.isNotNull() & F.col(perplexity).isNotNull(), (F.col(perplexity) - before) / before).otherwise(-1.0)
    ok = F.col(perplexity).isNotNull() & F.coalesce(F.abs(delta) < 0.01, F.lit(False))
    return history.withColumn("delta", delta).withColumn("converged", ok & (F.coalesce(sane, F.lit(False)) if sane is not None else F.lit(True)))
