"""Interpolated prediction, selection of the next token, and generation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SEPARATOR
from ..session import persisted, written
from .lookups import Predictor, blocks
from .ngrams import ORDERS, WEIGHTS, counts, packed_array, shares


def suffix_contexts(queries: DataFrame, tokens: str = "tokens", orders: tuple[int, ...] = ORDERS, ids: bool = False) -> DataFrame:
    """The columns of QUERIES but its tokens, with ord and ctx: the last 1 to 4 tokens as contexts of the orders that are long enough; packed where they are IDS."""
    joined = packed_array if ids else lambda x: F.array_join(x, SEPARATOR)
    options = [F.when(F.size(tokens) >= k - 1, F.struct(F.lit(k).alias("ord"), joined(F.slice(tokens, -(k - 1), k - 1)).alias("ctx"))) for k in orders]
    return queries.withColumn("c", F.explode(F.filter(F.array(*options), lambda x: x.isNotNull()))).select(*[c for c in queries.columns if c != tokens], "c.ord", "c.ctx")


def weight(order: Column, weights: dict[int, float] | None = None) -> Column:
    return F.create_map(*[F.lit(x) for pair in (weights or WEIGHTS).items() for x in pair])[order]


#: Contexts up to this number are broadcast to the stored model and, up to the lower one, pushed down to its files as a list.
FEW_CONTEXTS, LISTED_CONTEXTS = 1_000_000, 2_000


def _mixed(queries: DataFrame, known: DataFrame, query_id: str, tokens: str, few: bool = False, ids: bool = False) -> DataFrame:
    asked = suffix_contexts(queries.select(query_id, tokens), tokens, ids=ids)
    found = known.join(F.broadcast(asked) if few else asked, ["ord", "ctx"])
    return found.groupBy(query_id, F.col("next").alias("token")).agg(F.sum(weight(F.col("ord")) * F.col("p")).alias("prob"))


def _ranked(mixed: DataFrame, query_id: str) -> DataFrame:
    return mixed.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc(F.round("prob", 12)), "token")))


def interpolated(queries: DataFrame, table: DataFrame, query_id: str, tokens: str = "tokens") -> DataFrame:
    """query_id, token, prob, rank: the weighted sum of the shares of each order whose context is known.

    Weights are not scaled where an order has no context. Only contexts that are asked for are looked up, so the table is never ranked.
    """
    wanted = suffix_contexts(queries.select(query_id, tokens), tokens).select("ord", "ctx").distinct()
    return _ranked(_mixed(queries, shares(persisted(table.join(wanted, ["ord", "ctx"], "left_semi"))), query_id, tokens), query_id)


@dataclass(frozen=True)
class Sampler:
    """How the next token is chosen; the defaults are the usual ones of the toolkit this serves."""

    temperature: float = 0.8
    top_k: int = 40
    top_p: float = 0.95
    repetition_penalty: float = 1.1

    @property
    def greedy(self) -> bool:
        return self.temperature == 0 or self.top_k == 1


def adjusted(predictions: DataFrame, sampler: Sampler, query_id: str, recent: Column | None = None) -> DataFrame:
    """query_id, token, prob, cum, rank: what remains of ranked PREDICTIONS (query_id, token, prob, rank), scaled to 1, and the running sum.

    Greedy choice takes the first and knows no penalty. Else tokens in RECENT are divided by the penalty, all are raised to 1 / temperature, the first top_k of the order before are kept,
    sorted anew, and cut after the token with which the sum reaches top_p.
    """
    if sampler.greedy:
        return predictions.where("rank = 1").select(query_id, "token", F.lit(1.0).alias("prob"), F.lit(1.0).alias("cum"), F.lit(1).alias("rank"))
    p = F.col("prob")
    if recent is not None and sampler.repetition_penalty != 1.0:
        p = F.when(F.array_contains(recent, F.col("token")), p / sampler.repetition_penalty).otherwise(p)
    p = F.pow(p, F.lit(1.0 / sampler.temperature)) if sampler.temperature != 1.0 else p
    kept = predictions.withColumn("prob", p)
    if sampler.top_k > 0:
        kept = kept.where(F.col("rank") <= sampler.top_k)
    own = Window.partitionBy(query_id)
    order = own.orderBy(F.desc(F.round("prob", 12)), "token")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = kept.select(query_id, "token", "prob").withColumn("share", F.when(F.sum("prob").over(own) > 0, F.col("prob") / F.sum("prob").over(own)).otherwise(0.0))
    kept = kept.withColumn("before", F.sum("share").over(running) - F.col("share")).withColumn("rank", F.row_number().over(order))
    if sampler.top_p < 1:
        kept = kept.where((F.round("before", 12) < sampler.top_p) | (F.col("rank") == 1))
    total = F.sum("prob").over(own)
    kept = kept.withColumn("prob", F.when(total > 0, F.col("prob") / total).when(F.col("rank") == 1, 1.0).otherwise(0.0))
    return kept.select(query_id, "token", "prob", F.sum("prob").over(running).alias("cum"), "rank")


def drawn(chosen: DataFrame, query_id: str, u: Column) -> DataFrame:
    """query_id, token: the first token whose running sum reaches the draw U from 0 to 1 (the last one if rounding leaves none)."""
    w = Window.partitionBy(query_id)
    reached = F.min(F.when(F.round("cum", 12) >= F.round(u, 12), F.col("rank"))).over(w)
    return chosen.withColumn("pick", F.coalesce(reached, F.max("rank").over(w))).where("rank = pick").select(query_id, "token")


def generate(prompts: DataFrame, table: DataFrame, steps: int, query_id: str, sampler: Sampler | None = None, seed: int = 42, stop: str | int | list | None = None, recent: int = 20, ids: bool = False) -> DataFrame:
    """query_id, tokens, generated: all prompts go on together, one token a step, until STEPS, no prediction or a stop token (one or several). With IDS tokens are ids and the contexts of the table packed.

    Contexts are the last 4 tokens; the penalty looks at the last RECENT. Shares are stored once in order of their contexts. A step broadcasts the contexts it asks for where FEW_CONTEXTS bounds them,
    so the model isn't shuffled; LISTED_CONTEXTS of them are pushed down to the files as a list. The ids of the prompts differ. The state of more prompts is written to the shared checkpoint folder, so plans don't grow.
    """
    sampler = sampler or Sampler()
    known = written(shares(table).select("ord", "ctx", "next", "p").repartitionByRange("ord", "ctx").sortWithinPartitions("ord", "ctx"))
    asks = prompts.count() * len(ORDERS)
    few = asks <= FEW_CONTEXTS
    stops = [] if stop is None else stop if isinstance(stop, list) else [stop]

    def next_tokens(live: DataFrame, held: DataFrame, step: int) -> DataFrame:
        """query_id, token of the queries LIVE (query_id, tokens) that have a prediction."""
        mixed = _mixed(live, held, query_id, "tokens", few, ids)
        if sampler.greedy:
            return mixed.groupBy(query_id).agg(F.min(F.struct((-F.round("prob", 12)).alias("less"), "token"))["token"].alias("token"))
        seen = live.select(query_id, F.slice("tokens", F.greatest(F.lit(1), F.size("tokens") - recent + 1), recent).alias("recent"))
        filtered = adjusted(_ranked(mixed, query_id).join(seen, query_id), sampler, query_id, F.col("recent"))
        return drawn(filtered, query_id, F.pmod(F.xxhash64(query_id, F.lit(seed + step)), F.lit(1 << 53)) / float(1 << 53))

    empty = F.array().cast("array<int>" if ids else "array<string>").alias("generated")
    if asks <= LISTED_CONTEXTS:
        # So few prompts are held on the driver: a step is one job over the parts of the files that can hold their contexts.
        spark, schema = prompts.sparkSession, prompts.select(query_id, "tokens").schema
        held_rows = [(r[0], list(r[1])) for r in prompts.select(query_id, "tokens").collect()]
        going = {n for n, (_, tokens) in enumerate(held_rows) if tokens}
        made: list[list] = [[] for _ in held_rows]
        for step in range(steps):
            if not going:
                break
            live = spark.createDataFrame([(held_rows[n][0], held_rows[n][1]) for n in sorted(going)], schema)
            wanted = [r["ctx"] for r in suffix_contexts(live, ids=ids).select("ctx").distinct().collect()]
            chosen = {r[0]: r[1] for r in next_tokens(live, known.where(F.col("ctx").isin(wanted)), step).collect()}
            for n in list(going):
                token = chosen.get(held_rows[n][0])
                if token is None or token in stops:
                    going.discard(n)
                else:
                    held_rows[n][1].append(token)
                    made[n].append(token)
        kind = T.StructType([*schema.fields, T.StructField("generated", schema["tokens"].dataType)])
        return spark.createDataFrame([(*row, new) for row, new in zip(held_rows, made)], kind)
    state = prompts.select(query_id, "tokens", empty, F.lit(False).alias("done"))
    for step in range(steps):
        after = state.join(next_tokens(state.where("NOT done"), known, step), query_id, "left")
        going_on = ~F.col("done") & F.col("token").isNotNull() & (~F.col("token").isin(*stops) if stops else F.lit(True))
        state = after.select(
            query_id,
            F.when(going_on, F.concat("tokens", F.array("token"))).otherwise(F.col("tokens")).alias("tokens"),
            F.when(going_on, F.concat("generated", F.array("token"))).otherwise(F.col("generated")).alias("generated"),
            (~going_on).alias("done"),
        )
        state = persisted(state)  # each step reads it several times
        if step % 8 == 7 and state.where("NOT done").isEmpty():
            break
    return state.select(query_id, "tokens", "generated")


def greedy_chain(prompts: DataFrame, table: DataFrame, steps: int, query_id: str, ids: bool = False) -> DataFrame:
    """query_id, generated: greedy generation of evaluation, with its stop rules.

    Prompts under two tokens give nothing; a generation that repeats its last four tokens, after eight at least, loses the repetition and ends.
    """
    long_enough = prompts.where(F.size("tokens") >= 2)
    out = generate(long_enough, table, steps, query_id, Sampler(temperature=0.0), ids=ids)
    repeats = F.expr(
        """array_min(filter(transform(sequence(8, greatest(size(generated), 8)),
           n -> if(size(generated) >= n AND slice(generated, n - 3, 4) = slice(generated, n - 7, 4), n, null)), n -> n is not null))"""
    )
    cut = out.select(query_id, F.when(repeats.isNotNull(), F.slice("generated", F.lit(1), repeats - 4)).otherwise(F.col("generated")).alias("generated"))
    return prompts.select(query_id).join(cut, query_id, "left").select(query_id, F.coalesce("generated", F.array().cast("array<int>" if ids else "array<string>")).alias("generated"))


def greedy_chain_over(prompts: DataFrame, sequences: DataFrame, steps: int, query_id: str) -> DataFrame:
    """greedy_chain() by the counts of a corpus of SEQUENCES (tokens). For up to LISTED_CONTEXTS contexts a step no count table is made: the corpus is stored as ids, and a step counts what follows its new contexts in one pass."""
    if prompts.count() * len(ORDERS) > LISTED_CONTEXTS:
        return greedy_chain(prompts, persisted(counts(sequences)), steps, query_id)
    kind = prompts.select(query_id, F.col("tokens").alias("generated")).schema
    rows = [(r[0], list(r[1] or ())) for r in prompts.select(query_id, "tokens").collect()]
    predictor = Predictor(blocks(sequences))
    made: list[list[str]] = [[] for _ in rows]
    going = {n for n, (key, tokens) in enumerate(rows) if key is not None and len(tokens) >= 2}
    for _ in range(steps):
        if not going:
            break
        state = {n: tuple((rows[n][1] + made[n])[-4:]) for n in going}
        chosen = predictor.next_tokens(set(state.values()))
        for n in list(going):
            token = chosen[state[n]]
            if token is not None:
                made[n].append(token)
            repeats = token is not None and len(made[n]) >= 8 and made[n][-4:] == made[n][-8:-4]
            if repeats:
                del made[n][-4:]
            if token is None or repeats:
                going.discard(n)
    return prompts.sparkSession.createDataFrame([(key, new) for (key, _), new in zip(rows, made)], kind)
