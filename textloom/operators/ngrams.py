"""Count tables: associations of contexts of one to four tokens with the token after them, as rows (ord, ctx, next, cnt)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SEPARATOR, pretokens, trimmed
from .joins import evenly

ORDERS = (2, 3, 4, 5)
#: The weights of the orders in an interpolated prediction.
WEIGHTS = {2: 0.05, 3: 0.15, 4: 0.30, 5: 0.50}
#: Tokens from which a chunk is full, and the least of a file's last chunk.
CHUNK, LEAST_TAIL = 512, 5
#: A count can't exceed this where counts of 32 bits are to be matched.
MOST_COUNT = 4_294_967_295


def id_ngrams(sequences: DataFrame, ids: str = "ids", orders: tuple[int, ...] = ORDERS, *keep: str) -> DataFrame:
    """ord, ctx, next of every position of every sequence of token ids below 65,536 (ARRAY<INT>): contexts are packed into one BIGINT, so no text is moved."""
    if min(orders) < 2:
        raise ValueError("an order is 2 at least")
    n = max(orders)
    column = F.col(ids)
    moved = [column.alias("w0"), *[F.slice(column, i + 1, F.greatest(F.size(column), F.lit(1))).alias(f"w{i}") for i in range(1, n)]]
    zipped = sequences.select(*keep, *moved).select(*keep, F.explode(F.arrays_zip(*[f"w{i}" for i in range(n)])).alias("z"))
    row = zipped.select(*keep, *[F.col("z").getField(f"w{i}").alias(f"w{i}") for i in range(n)])
    each = F.array(*[F.struct(F.lit(k).alias("ord"), packed(*[F.col(f"w{i}") for i in range(k - 1)]).alias("ctx"), F.col(f"w{k - 1}").alias("next")) for k in orders])
    return row.select(*keep, F.inline(each)).where("next IS NOT NULL")


def id_counts(sequences: DataFrame, ids: str = "ids", orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """ord, ctx (packed), next, cnt over token ids."""
    return id_ngrams(sequences, ids, orders).groupBy("ord", "ctx", "next").agg(F.count(F.lit(1)).alias("cnt"))


def ngrams(sequences: DataFrame, tokens: str = "tokens", orders: tuple[int, ...] = ORDERS, *keep: str) -> DataFrame:
    """ord, ctx, next of every position of every sequence (ARRAY<STRING>), beside the columns KEEP.

    A sequence is zipped with itself moved by one to four places, so the rows are made without a shuffle or sort. Sequences shorter than an order give nothing for it; a null sequence gives nothing.
    """
    if min(orders) < 2:
        raise ValueError("an order is 2 at least")
    n = max(orders)
    column = F.col(tokens)
    moved = [column.alias("w0"), *[F.slice(column, i + 1, F.greatest(F.size(column), F.lit(1))).alias(f"w{i}") for i in range(1, n)]]
    zipped = sequences.select(*keep, *moved).select(*keep, F.explode(F.arrays_zip(*[f"w{i}" for i in range(n)])).alias("z"))
    row = zipped.select(*keep, *[F.col("z").getField(f"w{i}").alias(f"w{i}") for i in range(n)])
    stacked = ", ".join(f"{k}, concat_ws('{SEPARATOR}', {', '.join(f'w{i}' for i in range(k - 1))}), w{k - 1}" for k in orders)
    return row.select(*keep, F.expr(f"stack({len(orders)}, {stacked}) AS (ord, ctx, next)")).where("next IS NOT NULL")


def counts(sequences: DataFrame, tokens: str = "tokens", orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """ord, ctx, next, cnt: one shuffle on the key, after counting in each task."""
    return ngrams(sequences, tokens, orders).groupBy("ord", "ctx", "next").agg(F.count(F.lit(1)).alias("cnt"))


def clamped(table: DataFrame) -> DataFrame:
    """Counts as a counter of 32 bits holds them."""
    return table.withColumn("cnt", F.least("cnt", F.lit(MOST_COUNT)))


def sequences_of(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """Each text as one sequence of pre-tokens."""
    return docs.select(*keep, pretokens(F.col(text)).alias("tokens")).where(F.size("tokens") > 0)


def chunked(docs: DataFrame, doc: str, lines: str) -> DataFrame:
    """doc, chunk, tokens: the LINES of a document (an array of arrays of tokens of any kind), joined until there are CHUNK tokens.

    A chunk ends with the line that fills it; the last is dropped under LEAST_TAIL tokens. The lines of one document are folded in order inside its row, so nothing is shuffled.
    """
    rows = docs.select(F.col(doc).alias("doc"), F.col(lines).alias("lines")).where(F.size("lines") > 0)
    numbered = rows.select(
        "doc",
        "lines",
        F.expr(
            f"""aggregate(lines, named_struct('cur', 0, 'id', 0, 'ids', cast(array() AS array<int>)),
                (a, x) -> named_struct('cur', if(a.cur + size(x) >= {CHUNK}, 0, a.cur + size(x)),
                                       'id', if(a.cur + size(x) >= {CHUNK}, a.id + 1, a.id),
                                       'ids', concat(a.ids, array(a.id)))).ids"""
        ).alias("ids"),
    )
    each = numbered.select("doc", "lines", "ids", F.explode(F.array_distinct("ids")).alias("chunk"))
    tokens = F.expr("flatten(transform(filter(arrays_zip(lines, ids), z -> z.ids = chunk), z -> z.lines))")
    return each.select("doc", "chunk", tokens.alias("tokens")).where(F.size("tokens") >= LEAST_TAIL)


def trimmed_lines(text: Column) -> Column:
    """The trimmed lines of a text that aren't blank."""
    return F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: x != "")


def chunks(docs: DataFrame, doc_id: str, text: str = "text") -> DataFrame:
    """doc, chunk, tokens: the pre-tokens of the trimmed lines of a text in chunks."""
    return chunked(docs.select(doc_id, F.transform(trimmed_lines(F.col(text)), pretokens).alias("lines")), doc_id, "lines")


def totals(table: DataFrame) -> DataFrame:
    return table.groupBy("ord", "ctx").agg(F.sum("cnt").alias("total"))


def shares(table: DataFrame) -> DataFrame:
    """ord, ctx, next, cnt, total, p: the share of each token after its context. The rows of the commonest contexts are joined where they are."""
    per = totals(table)
    return evenly(table, per, ["ord", "ctx"], F.col("total")).select("ord", "ctx", "next", "cnt", "total", (F.col("cnt") / F.col("total")).alias("p"))


def mle(table: DataFrame, most: int | None = None) -> DataFrame:
    """ord, ctx, next, prob, rank: the share of each token after its context; ties in order of the token. MOST keeps so many of each context.

    With MOST each task keeps only its own best of a context before anything is shuffled, and totals come from a partial aggregate, so a context of any size is ranked from few rows.
    """
    ranked = table.withColumn("rank", F.row_number().over(Window.partitionBy("ord", "ctx").orderBy(F.desc("cnt"), "next")))
    if most is None:
        ranked = ranked.join(totals(table), ["ord", "ctx"])
    else:
        ranked = ranked.where(F.col("rank") <= most).join(totals(table), ["ord", "ctx"])
    return ranked.select("ord", "ctx", "next", (F.col("cnt") / F.col("total")).alias("prob"), "rank")


def best_next(table: DataFrame) -> DataFrame:
    """ord, ctx, next, cnt: the likeliest token of each context, of equal ones the first in order; by an aggregate instead of a sort."""
    return table.groupBy("ord", "ctx").agg(F.min(F.struct((-F.col("cnt")).alias("less"), "next")).alias("best")).select("ord", "ctx", F.col("best.next").alias("next"), (-F.col("best.less")).alias("cnt"))


def prune(table: DataFrame, least: int) -> DataFrame:
    """Associations counted at least so often; contexts without any go with them."""
    return table.where(F.col("cnt") >= least)


def evict(table: DataFrame, budget: int) -> DataFrame:
    """Each order pruned at the least threshold from 2 to 99 that leaves at most BUDGET associations; an order within it is left as it is.

    The threshold comes from a histogram of the counts up to 99, of at most 99 rows an order.
    """
    sizes = table.groupBy("ord", F.least("cnt", F.lit(99)).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("ord").orderBy(F.desc("c"))
    kept = sizes.withColumn("left", F.sum("n").over(w))
    fits = kept.where(F.col("left") <= budget).groupBy("ord").agg(F.min("c").alias("t"))
    size = sizes.groupBy("ord").agg(F.sum("n").alias("size"))
    # No threshold fits: 99 is the last that is tried. Thresholds between two counts that occur cut alike.
    over = kept.where(F.col("left") > budget).groupBy("ord").agg((F.max("c") + 1).alias("next_t"))
    bound = size.join(fits, "ord", "left").join(over, "ord", "left").select(
        "ord", F.when(F.col("size") <= budget, 0).otherwise(F.least(F.greatest(F.lit(2), F.coalesce("next_t", F.lit(99))), F.lit(99))).alias("threshold")
    )
    return table.join(F.broadcast(bound), "ord").where(F.col("cnt") >= F.col("threshold")).drop("threshold")


def stats(table: DataFrame) -> DataFrame:
    """ord, contexts, associations, observations."""
    per_context = table.groupBy("ord", "ctx").agg(F.count(F.lit(1)).alias("a"), F.sum("cnt").alias("o"))
    return per_context.groupBy("ord").agg(F.count(F.lit(1)).alias("contexts"), F.sum("a").alias("associations"), F.sum("o").alias("observations"))


def merged(*tables: DataFrame) -> DataFrame:
    """Counts of several tables added up."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("ord", "ctx", "next").agg(F.sum("cnt").alias("cnt"))


def scaled(table: DataFrame, factor: float) -> DataFrame:
    """Counts times FACTOR, rounded down; those that fall to 0 go. Training for E epochs multiplies by E, decay by less than 1."""
    return table.withColumn("cnt", F.floor(F.col("cnt") * F.lit(factor)).cast("long")).where("cnt > 0")


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """ord, ctx, next, old_cnt, new_cnt where the two differ; 0 where one has none. One aggregate over both instead of a full join."""
    sides = old.select("ord", "ctx", "next", F.col("cnt").alias("old_cnt"), F.lit(0).cast("long").alias("new_cnt")).unionByName(
        new.select("ord", "ctx", "next", F.lit(0).cast("long").alias("old_cnt"), F.col("cnt").alias("new_cnt"))
    )
    return sides.groupBy("ord", "ctx", "next").agg(F.sum("old_cnt").alias("old_cnt"), F.sum("new_cnt").alias("new_cnt")).where("old_cnt <> new_cnt")


def quantised(table: DataFrame, bits: int = 4) -> DataFrame:
    """Counts as logarithmic buckets that fit in so many bits."""
    return table.withColumn("bucket", F.least(F.floor(F.log2("cnt")).cast("int"), F.lit((1 << bits) - 1)))


def pmi(table: DataFrame) -> DataFrame:
    """ctx, next, pmi: how much oftener than by chance the token follows the one before, of bigrams. Common contexts and tokens are joined by broadcast."""
    two = table.where("ord = 2").select("ctx", "next", "cnt")
    left = two.groupBy("ctx").agg(F.sum("cnt").alias("l"))
    right = two.groupBy("next").agg(F.sum("cnt").alias("r"))
    total = two.agg(F.sum("cnt").alias("t"))
    both = evenly(evenly(two, left, ["ctx"], F.col("l")), right, ["next"], F.col("r")).join(F.broadcast(total))
    return both.select("ctx", "next", "cnt", F.log2(F.col("cnt") * F.col("t") / (F.col("l") * F.col("r"))).alias("pmi"))


def packed(*tokens: Column) -> Column:
    """Up to four token ids below 65,536 in one BIGINT, the last in the lowest bits. The order belongs beside it as a key of its own, since id 0 is a token too."""
    out = F.lit(0).cast("long")
    for t in tokens:
        out = F.shiftleft(out, 16).bitwiseOR(t.cast("long"))
    return out


def packed_array(ids: Column) -> Column:
    """packed() of an array."""
    return F.aggregate(ids, F.lit(0).cast("long"), lambda a, t: F.shiftleft(a, 16).bitwiseOR(t.cast("long")))


def unpacked(ctx: Column, ord: Column) -> Column:
    """The ids of a packed context of an order."""
    return F.transform(F.sequence(ord - 2, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftright", ctx, k * 16).bitwiseAND(F.lit(65535)).cast("int"))
