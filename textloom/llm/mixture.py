"""Problem 7: documents of all sources mixed to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import persisted, table
from .common import spread
from .encode import token_count
from .tokenizers import DEFAULT_FOLDER

#: Sources up to this number are broadcast; a longer listing is joined by a shuffle.
FEW_SOURCES = 100_000
#: Bits of the hash that one histogram resolves, and how many histograms refine the boundary bucket in turn.
BUCKET_BITS, LEVELS = 12, 4


def sized_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, source, n_tokens, slot: SLOT is 48 bits of a hash of the id (id and text hash where the id repeats would clash are the same document)."""
    rows = spread(docs.select("doc_id", "source", "text"))
    slot = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 64 - BUCKET_BITS * LEVELS)
    return rows.select("doc_id", "source", token_count(F.col("text"), vocabulary).alias("n_tokens"), slot.alias("slot"))


def source_budgets(sized: DataFrame, mixture: DataFrame, total_tokens: int | None = None, exact_shares: bool = False) -> DataFrame:
    """source, weight, max_repeats, n_docs, n_tokens, share, budget, rounds, rest: one row for each source of the mixture.

    Shares are the weights of the sources that have tokens and a positive weight, scaled to 1. The total is TOTAL_TOKENS; without it the tokens these sources hold, or with
    EXACT_SHARES the greatest total at which every one of them reaches its share within its cap. A source that its cap holds below its share gives all it may, and what it can't give comes from the
    others in proportion to their weights, so the total is reached unless all are at their caps. ROUNDS is how often each of its documents
    is used, REST the tokens still due, to come from documents used once more. Sources with a null, NaN, zero or negative weight, a cap under 1, or without tokens have a share and budget of 0.
    """
    held = sized.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"))
    listed = mixture.groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    both = listed.join(held, listed["source"].eqNullSafe(held["source"]), "left").select(
        listed["source"], "weight", "max_repeats", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs")
    )
    usable = F.col("source").isNotNull() & (F.col("weight") > 0) & ~F.isnan("weight") & (F.col("n_tokens") > 0) & (F.coalesce("max_repeats", F.lit(1)) > 0)
    listing = Window.partitionBy()  # a row for each source of the mixture, whose number mix() checks
    shared = both.withColumn("w", F.when(usable, F.col("weight")).otherwise(0.0))
    shared = shared.withColumn("share", F.when(F.sum("w").over(listing) > 0, F.col("w") / F.sum("w").over(listing)).otherwise(0.0)).drop("w")
    cap = F.col("max_repeats") * F.col("n_tokens")
    held_tokens = F.sum(F.when(F.col("share") > 0, F.col("n_tokens"))).over(listing)
    if total_tokens is not None:
        total = F.lit(total_tokens)
    elif exact_shares:
        total = F.coalesce(F.min(F.when(F.col("share") > 0, cap / F.col("share"))).over(listing), held_tokens)
    else:
        total = held_tokens
    # Sources are filled to one level, tokens for each unit of weight. Those whose caps lie below it come first in order of their caps; the level of the first that lies above it holds for all after it.
    top = F.coalesce(cap / F.col("share"), F.lit(float("inf")))
    filled = shared.withColumn("cap", cap).withColumn("total", total.cast("double")).withColumn("top", F.when(F.col("share") > 0, top))
    in_order = listing.orderBy(F.asc_nulls_last("top"), "source")
    before = F.coalesce(F.sum(F.when(F.col("share") > 0, F.col("cap"))).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum(F.when(F.col("share") > 0, F.col("share"))).over(in_order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    filled = filled.withColumn("own", F.when((F.col("share") > 0) & (after > 0), (F.col("total") - before) / after))
    level = F.min(F.when(F.col("own") <= F.col("top"), F.struct("top", "source", "own"))).over(listing)["own"]
    due = F.floor(F.least(F.coalesce(level, F.lit(float("inf"))) * F.col("share"), F.coalesce("cap", F.lit(float("inf")))) + F.lit(1e-6))
    shared = filled.withColumn("budget", F.when((F.col("share") > 0) & (F.col("total") > 0), due).otherwise(F.lit(0)).cast("long")).drop("cap", "total", "top", "own")
    rounds = F.when(F.col("n_tokens") > 0, F.floor(F.col("budget") / F.col("n_tokens"))).otherwise(F.lit(0)).cast("long")
    return shared.withColumn("rounds", rounds).withColumn("rest", F.col("budget") - F.col("rounds") * F.col("n_tokens"))


def thresholds(sized: DataFrame, budgets: DataFrame, few: bool = True) -> DataFrame:
    """source, threshold: documents with a smaller slot fill the source's rest as nearly as whole documents do, up to half of the boundary document over or under it.

    A histogram of tokens over 2^12 hash buckets places the threshold up to one bucket; only the documents in that boundary bucket enter the next, finer histogram. No level sorts or gathers documents.
    """
    size = 1 << BUCKET_BITS
    sent = F.broadcast if few else lambda x: x
    found = budgets.where("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("next"))
    for level in range(LEVELS):
        shift = BUCKET_BITS * (LEVELS - 1 - level)
        inside = sized.select("source", "slot", "n_tokens").join(sent(found.drop("next")), "source").where(F.shiftright("slot", shift + BUCKET_BITS) == F.col("prefix"))
        histogram = inside.groupBy("source", F.shiftright("slot", shift).bitwiseAND(size - 1).alias("bucket")).agg(F.sum("n_tokens").alias("n_tokens"))
        # At most 2^12 rows a source, whatever the number of documents.
        below = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("bucket"))
        filled = histogram.withColumn("below", below).join(sent(found.drop("next")), "source")
        fits = F.col("below") <= F.col("rest")
        step = filled.groupBy("source", "prefix", "rest").agg(
            F.coalesce(F.min(F.when(~fits, F.struct("bucket", "n_tokens"))), F.struct(F.lit(size - 1).cast("long").alias("bucket"), F.lit(0).cast("long").alias("n_tokens"))).alias("edge"),
            F.coalesce(F.max(F.when(fits, F.col("below"))), F.lit(0)).alias("taken"),
        )
        found = persisted(step.select("source", (F.col("rest") - F.col("taken")).alias("rest"), (F.col("prefix") * size + F.col("edge.bucket")).alias("prefix"), F.col("edge.n_tokens").alias("next")))
    # The documents of the boundary slot (one, but for equal hashes) are taken where that comes nearer.
    nearer = (F.col("next") > 0) & (F.col("next") < 2 * F.col("rest"))
    return found.select("source", (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("threshold"))


def mix(docs: DataFrame, mixture: DataFrame, vocabulary: str, total_tokens: int | None = None, exact_shares: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, uses) of every document that is used, and the shares that are reached, a row for each source of either table.

    The mixture is a configuration table: what there is by source is broadcast where it has up to FEW_SOURCES rows, and joined by a shuffle beyond. Documents without tokens and those whose source is null, not listed or not in use have no uses.
    """
    few = mixture.count() <= FEW_SOURCES
    sent = F.broadcast if few else lambda x: x
    sized = persisted(sized_documents(docs, vocabulary))
    budgets = persisted(source_budgets(sized, mixture, total_tokens, exact_shares))
    bounds = thresholds(sized, budgets, few)
    per_source = budgets.where("budget > 0").select("source", "rounds").join(bounds, "source", "left")
    uses = F.col("rounds") + F.when(F.col("slot") < F.col("threshold"), F.lit(1)).otherwise(F.lit(0))
    chosen = sized.where("n_tokens > 0").join(sent(per_source), "source").select("doc_id", "source", "n_tokens", uses.alias("uses")).where("uses > 0")
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("most_uses"), F.count(F.lit(1)).alias("used_docs"))
    listing = Window.partitionBy()
    mixed = F.coalesce(F.col("used_tokens"), F.lit(0))
    zero = F.lit(0).cast("long")
    shares = budgets.join(sent(used), "source", "left").select(
        "source",
        "weight",
        "max_repeats",
        "n_docs",
        "n_tokens",
        F.round("share", 9).alias("target_share"),
        F.col("budget").alias("target_tokens"),
        mixed.alias("used_tokens"),
        F.coalesce("used_docs", zero).alias("used_docs"),
        F.coalesce("most_uses", zero).alias("most_uses"),
        F.round(F.when(F.sum(mixed).over(listing) > 0, mixed / F.sum(mixed).over(listing)).otherwise(0.0), 9).alias("reached_share"),
    )
    held = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    names = budgets.select(F.col("source").alias("listed"))
    unlisted = held.join(sent(names), held["source"].eqNullSafe(names["listed"]), "left_anti").select(
        "source", F.lit(None).cast("double").alias("weight"), F.lit(None).cast("int").alias("max_repeats"), "n_docs", "n_tokens",
        F.lit(0.0).alias("target_share"), zero.alias("target_tokens"), zero.alias("used_tokens"), zero.alias("used_docs"), zero.alias("most_uses"), F.lit(0.0).alias("reached_share"),
    )
    return chosen, shares.unionByName(unlisted)


def _mix(spark: SparkSession, sf_dir: str, folder: str, **how: object) -> tuple[DataFrame, DataFrame]:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixture"), f"{folder}/byte_bpe_50k.tiktoken", **how)


def p7_mixed(spark: SparkSession, sf_dir: str, folder: str = DEFAULT_FOLDER) -> DataFrame:
    """The documents of a mix as large as the corpus, with their uses."""
    return _mix(spark, sf_dir, folder)[0]


def p7_shares(spark: SparkSession, sf_dir: str, folder: str = DEFAULT_FOLDER) -> DataFrame:
    """The shares of that mix by source."""
    return _mix(spark, sf_dir, folder)[1]


def p7_exact_mixed(spark: SparkSession, sf_dir: str, folder: str = DEFAULT_FOLDER) -> DataFrame:
    """The documents of the largest mix in which no source is held below its share by its cap, with their uses."""
    return _mix(spark, sf_dir, folder, exact_shares=True)[0]


def p7_exact_shares(spark: SparkSession, sf_dir: str, folder: str = DEFAULT_FOLDER) -> DataFrame:
    """The shares of the largest mix in which no source is held below its share by its cap."""
    return _mix(spark, sf_dir, folder, exact_shares=True)[1]
