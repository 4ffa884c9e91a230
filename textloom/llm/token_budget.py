"""Problem 2: tokens per snippet and their totals by source, language and phase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import persisted, table
from .common import label, spellings, spread
from .encode import token_count
from .tokenizers import DEFAULT_FOLDER

#: Short spellings of programming languages; those of natural languages are in lang_alias.
CODE_ALIASES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "rs": "rust"}


def phase(column: Column) -> Column:
    """A phase name without emoji, outer white space and letter case; "(none)" for null."""
    return label(F.regexp_replace(F.regexp_replace(column, r"[^\p{L}\p{N}() _-]", ""), " +", " "))


def source_path(column: Column) -> Column:
    """A file path, whatever its separators, letter case and leading "./"."""
    return label(F.regexp_replace(F.regexp_replace(F.lower(F.trim(column)), r"[\\/]+", "/"), r"^(\./)+", ""))


def snippet_tokens(snippets: DataFrame, aliases: DataFrame, vocabulary: str) -> DataFrame:
    """id, source, language, phase, n_tokens: one row for each id.

    Rows delivered again under the same id count once (of rows that differ, the one stored last, then the greatest content). A null or empty content has 0 tokens; a null
    source, language or phase is "(none)". Rows without an id are kept, one for each different content.
    """
    alias = spellings(aliases) | CODE_ALIASES
    names = F.create_map(*[F.lit(x) for pair in alias.items() for x in pair])
    language = label(F.col("language"))
    order = F.struct(F.col("stored_at").isNotNull(), "stored_at", F.coalesce("content", F.lit("")), F.coalesce("source", F.lit("")))
    # One row per id is chosen by a partial aggregate, so a much repeated id never gathers its rows in one task.
    once = snippets.groupBy("id", F.when(F.col("id").isNull(), F.col("content")).alias("unnamed")).agg(
        F.max_by(F.struct("content", "source", "language", "phase_name"), order).alias("row")
    )
    rows = spread(once.select("id", "row.*"))
    return rows.select(
        "id",
        source_path(F.col("source")).alias("source"),
        F.coalesce(names[language], language).alias("language"),
        phase(F.col("phase_name")).alias("phase"),
        token_count(F.col("content"), vocabulary).alias("n_tokens"),
    )


def tokens_trained(progress: DataFrame) -> DataFrame:
    """phase, tokens_trained, runs: of each run and phase the greatest reading (the counter runs on within both; a drop to 0 and late or repeated reports change nothing), summed over the runs."""
    per_run = progress.groupBy("run_id", phase(F.col("name")).alias("phase")).agg(F.max("tokens_trained").alias("tokens"))
    return per_run.groupBy("phase").agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens_trained"), F.count(F.lit(1)).alias("runs"))


def token_cube(counted: DataFrame, trained: DataFrame) -> DataFrame:
    """source, language, phase ("(all)" where summed over), n_snippets, n_tokens of every slice; tokens_trained where the slice is a phase alone, null elsewhere.

    The slices by source come once for each file path and once for each folder, whose source is the folder with "/*". A phase that was trained but has no snippet is a slice of 0 snippets and 0 tokens.
    """
    per_path = counted.groupBy("source", "language", "phase").agg(F.count(F.lit(1)).alias("n_snippets"), F.sum("n_tokens").alias("n_tokens"))  # what both cubes sum, counted before they multiply rows
    folder = F.when(F.contains("source", F.lit("/")), F.regexp_replace("source", "/[^/]*$", "/*"))

    def cube(rows: DataFrame) -> DataFrame:
        sums = rows.cube("source", "language", "phase").agg(F.sum("n_snippets").alias("n_snippets"), F.sum("n_tokens").alias("n_tokens"), F.grouping_id().alias("summed"))
        names = [F.when(F.col("summed").bitwiseAND(bit) != 0, F.lit("(all)")).otherwise(F.col(c)).alias(c) for c, bit in (("source", 4), ("language", 2), ("phase", 1))]
        return sums.select(*names, "n_snippets", "n_tokens", "summed")

    by_folder = cube(per_path.withColumn("source", folder).where("source IS NOT NULL")).where(F.col("summed").bitwiseAND(4) == 0)
    slices = cube(per_path).unionByName(by_folder).select("source", "language", "phase", "n_snippets", "n_tokens", (F.col("summed") == 6).alias("by_phase"))
    beside = trained.select(F.lit(True).alias("by_phase"), "phase", "tokens_trained")
    joined = slices.join(beside, ["by_phase", "phase"], "full")
    summed = lambda c: F.coalesce(c, F.lit("(all)")).alias(c)
    zero = lambda c: F.when(F.col("n_snippets").isNull(), F.lit(0)).otherwise(F.col(c)).alias(c)
    return joined.select(summed("source"), summed("language"), "phase", zero("n_snippets"), zero("n_tokens"), "tokens_trained")


def p2_snippet_tokens(spark: SparkSession, sf_dir: str, folder: str = DEFAULT_FOLDER) -> DataFrame:
    return snippet_tokens(table(spark, sf_dir, "snippet"), table(spark, sf_dir, "lang_alias"), f"{folder}/byte_bpe_50k.json")


def p2_token_budget(spark: SparkSession, sf_dir: str, folder: str = DEFAULT_FOLDER) -> DataFrame:
    """The cube over the stored counts: the snippets are encoded once."""
    return token_cube(persisted(p2_snippet_tokens(spark, sf_dir, folder)), tokens_trained(table(spark, sf_dir, "phase_progress")))
