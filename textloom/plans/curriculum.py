"""Training by a curriculum of phases: counting, evaluation, convergence, progress."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pretokens
from ..operators import bpe, evaluate, ngrams, predict, prepare
from ..session import persisted
from ..sources import model


@dataclass(frozen=True)
class Phase:
    name: str
    #: What of the corpus belongs to the phase; None: all of it.
    key: str | None
    max_epochs: int
    prune_threshold: int = 0
    include_in_tokenizer: bool = True


#: The phases in order.
CURRICULUM = (
    Phase("Ashanti Twi 🇬🇭", "twi", 3),
    Phase("English", "english", 2),
    Phase("Public Code", "code", 2),
    Phase("Personal Code", "personal", 3),
    Phase("Refinement (all data)", None, 3, 2, False),
)
#: Prompts that judge a phase by its generations.
PROMPTS = {
    "twi": ("Me din de ", "Ɛnnɛ yɛ ", "Ghana yɛ ", "Wo ho te sɛn? Me ho "),
    "english": ("Once upon a time ", "The quick brown fox ", "In the beginning ", "She walked to the "),
    "code": ("def fibonacci(", "function handle", "const result = ", "async fn main"),
}


#: Tokens generated from each prompt.
JUDGED_TOKENS = 30
#: The vocabulary that merging aims at, and lines of each phase that it is learnt from.
VOCABULARY, SAMPLE_LINES = 22_000, 100_000


def phases(present: set[str]) -> list[Phase]:
    """The phases whose part of the corpus is there, and the last."""
    return [p for p in CURRICULUM if p.key is None or p.key in present]


def prompts_of(phase: str) -> tuple[str, ...]:
    """The prompts that judge a phase, by its name."""
    name = phase.lower()
    return PROMPTS["twi" if "twi" in name else "english" if "english" in name else "code" if "code" in name or "personal" in name else "english"]


@dataclass
class PhaseProgress:
    name: str
    max_epochs: int
    status: str = "pending"
    epoch: int = 0
    files_processed: int = 0
    total_files: int = 0
    lines_processed: int = 0
    tokens_trained: int = 0
    perplexity_history: list[float | None] = field(default_factory=list)
    coverage_history: list[float] = field(default_factory=list)
    sample_generation: str | None = None


@dataclass
class Progress:
    """The state of a training run, written as JSON whenever it changes."""

    phases: list[PhaseProgress]
    status: str = "training"
    current: int = 0
    #: Parts of the current phase that are counted and stored.
    parts_done: int = 0
    vocabulary: int = 0
    associations: int = 0
    started_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())

    def start(self, k: int) -> PhaseProgress:
        self.current = k
        self.phases[k].status = "active"
        return self.phases[k]

    def finish(self, converged: bool) -> None:
        self.phases[self.current].status = "converged" if converged else "completed"

    def rate(self, seconds: float) -> tuple[float, float]:
        """Files a second, and seconds left in the phase at that rate (0 where nothing is known)."""
        p = self.phases[self.current]
        per_second = p.files_processed / seconds if seconds > 0 else 0.0
        return per_second, (p.total_files - p.files_processed) / per_second if per_second else 0.0

    def write(self, path: str) -> None:
        """Beside its place first, then renamed, so a reader never sees half of it."""
        with open(f"{path}.part", "w", encoding="utf-8") as f:
            json.dump(asdict(self) | {"updated_at": datetime.now(UTC).isoformat()}, f, ensure_ascii=False, indent=2)
        os.replace(f"{path}.part", path)


def read_progress(path: str) -> Progress:
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    held.pop("updated_at", None)
    return Progress(**held | {"phases": [PhaseProgress(**p) for p in held["phases"]]})


def converged(before: float | None, now: float | None, sane: bool) -> bool:
    """Finite (not None), changed by under 1 % and sane."""
    return sane and before is not None and now is not None and abs((now - before) / before) < 0.01


@dataclass(frozen=True)
class Tokenizer:
    """A vocabulary (token_id, token) and merges (rank, l, r), with what applies them inside the rows."""

    vocab: DataFrame
    merges: DataFrame

    @classmethod
    def learnt(cls, lines: DataFrame, text: str, target: int) -> Tokenizer:
        """From the lines of a sample, up to TARGET tokens."""
        freqs = persisted(bpe.word_freqs(lines, text))
        merges = persisted(bpe.learn_merges(freqs, target_vocab=target))
        return cls(persisted(bpe.vocabulary(freqs, merges)), merges)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Tokenizer:
        return cls(model.part(spark, path, "vocab"), model.part(spark, path, "merges"))

    def ids(self, docs: DataFrame, *keep: str, text: str) -> DataFrame:
        """KEEP, ids of each text."""
        return docs.select(*keep, bpe.encoder(self.merges, self.vocab)(pretokens(F.coalesce(F.col(text), F.lit(""))))["token_id"].alias("ids"))

    def lines(self, docs: DataFrame, *keep: str, text: str) -> DataFrame:
        """KEEP, lines: the ids of each trimmed line of each text."""
        return docs.select(*keep, bpe.id_encoder(self.merges, self.vocab)(F.transform(ngrams.trimmed_lines(F.coalesce(F.col(text), F.lit(""))), pretokens)).alias("lines"))


@dataclass(frozen=True)
class Judgement:
    perplexity: float | None
    coverage: float
    delta: float | None
    sane: bool
    sample: str
    converged: bool


def judge(table: DataFrame, tokenizer: Tokenizer, phase: str, tests: DataFrame, before: float | None, first: bool) -> Judgement:
    """Perplexity and coverage over TESTS (test_id, ids) together, thirty tokens from each of the phase's prompts, and whether the phase has converged.

    The sample is the prompt and generation that is sane and longer, in bytes, than the sample before it. BEFORE is the perplexity of the epoch before (null: infinite), FIRST where there was none.
    """
    spark = table.sparkSession
    p = evaluate.target_probabilities(tests, table, "test_id", "ids", ids=True)
    seen = F.col("p") > 0
    got = p.agg(F.exp(-F.avg(F.log(F.when(seen, F.col("p")).otherwise(evaluate.UNSEEN)))).alias("p"), F.avg(seen.cast("double")).alias("c")).first()
    coverage = got["c"] or 0.0
    perplexity = got["p"] if got["p"] is not None and coverage >= 1 - evaluate.MOST_UNSEEN else None
    asked = spark.createDataFrame(list(enumerate(prompts_of(phase))), "n int, prompt string")
    encoded = persisted(tokenizer.ids(asked, "n", "prompt", text="prompt").withColumnRenamed("ids", "tokens"))
    made = predict.greedy_chain(encoded.select("n", "tokens"), table, JUDGED_TOKENS, "n", ids=True)
    texts = made.join(asked, "n").select("n", "prompt", bpe.decoded(F.col("generated"), tokenizer.vocab).alias("text"))
    sample, sane = "", False
    for r in texts.withColumn("sane", evaluate.is_sane(F.col("text"))).orderBy("n").collect():
        if r["sane"] and len(r["text"].encode()) > len(sample.encode()):
            sample, sane = r["prompt"] + r["text"], True
    delta = None if first else (perplexity - before) / before if before is not None and perplexity is not None else -1.0
    return Judgement(perplexity, coverage, delta, sane, sample, converged(before, perplexity, sane))


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "ord int, ctx long, next int, cnt long")


def train(
    docs: DataFrame,
    doc_id: str,
    text: str,
    key: str,
    out: str,
    progress: str | None = None,
    resume: bool = False,
    name: str = "model",
    vocabulary: int = VOCABULARY,
    sample_lines: int = SAMPLE_LINES,
    files_a_part: int | None = None,
    most_associations: int | None = None,
    stop: Callable[[], bool] = lambda: False,
) -> Progress:
    """A run over all phases of the curriculum: tokenizer, counts over token ids, judgement, pruning; the model is written to OUT after every phase.

    KEY says which part of the corpus a document belongs to; null texts and keys outside the curriculum belong to the last phase alone. The tokenizer is learnt from the first SAMPLE_LINES lines of each phase
    that takes part in it. A phase is counted once, since E epochs of the same text multiply its counts by E, over the lines without any held out: those at the files' ends judge it, as they are part of the
    training text too. With FILES_A_PART a phase is counted in parts of about so many files, each stored when done. STOP is asked between parts and epochs: a run that is stopped writes what it has, and with RESUME
    goes on there. With MOST_ASSOCIATIONS each order is evicted down to so many after a phase.
    """
    spark = docs.sparkSession
    known = [p.key for p in CURRICULUM if p.key is not None]
    present = {r[0] for r in docs.where(F.col(key).isin(*known)).select(key).distinct().collect()}
    plan = phases(present)
    counts_of = f"{out}.counted"
    if resume:
        state = read_progress(progress) if progress and os.path.exists(progress) else Progress([PhaseProgress(p.name, p.max_epochs) for p in plan])
        kept = Tokenizer.read(spark, out)
        tokenizer = Tokenizer(persisted(kept.vocab), persisted(kept.merges))  # the folder is replaced by each save
        table = persisted(model.counts(spark, out).select(*_empty(spark).columns))
        trained = model.meta(spark, out)["tokens_trained"]
    else:
        state = Progress([PhaseProgress(p.name, p.max_epochs) for p in plan], "tokenizing")
        sampled = [p.key for p in plan if p.include_in_tokenizer and p.key]
        own = docs.where(F.col(key).isin(*sampled)) if sampled else docs
        tokenizer = Tokenizer.learnt(prepare.tokenizer_sample(own, key, doc_id, text, sample_lines), "line", vocabulary)
        table, trained = _empty(spark), 0

    def save() -> None:
        state.associations = sum(r["associations"] for r in ngrams.stats(table).collect())
        state.vocabulary = tokenizer.vocab.count()
        model.write(out, table, tokenizer.vocab, tokenizer.merges, name=name, tokens_trained=trained)

    def tell(status: str) -> None:
        state.status = status
        if progress:
            state.write(progress)

    tell("training")
    if not resume:
        save()
    for k, phase in enumerate(plan):
        if state.phases[k].status in ("converged", "completed", "skipped"):
            continue
        mine = state.start(k)
        own = docs.where(F.col(text).isNotNull()) if phase.key is None else docs.where((F.col(key) == phase.key) & F.col(text).isNotNull())
        mine.total_files = own.count()
        if mine.total_files == 0:
            mine.status = "skipped"
            continue
        parts = -(-mine.total_files // files_a_part) if files_a_part else 1
        one = persisted(spark.read.parquet(counts_of)) if state.parts_done and resume else _empty(spark)
        done = state.parts_done if resume else 0
        for part in range(done, parts):
            if stop():
                tell("stopped")
                return state
            some = own.where(F.pmod(F.xxhash64(doc_id), F.lit(parts)) == part)
            encoded = persisted(tokenizer.lines(some, doc_id, text=text))
            one = persisted(ngrams.merged(one, ngrams.id_counts(ngrams.chunked(encoded, doc_id, "lines"), "tokens")))
            sums = encoded.agg(F.count(F.lit(1)).alias("files"), F.sum(F.size("lines")).alias("lines")).first()
            mine.files_processed += sums["files"]
            mine.lines_processed += sums["lines"] or 0
            if files_a_part:
                one.write.mode("overwrite").parquet(counts_of)
                state.parts_done = part + 1
            tell("training")
        held = prepare.tail_lines(own, doc_id, text)
        tests = persisted(tokenizer.ids(held.select(F.col(doc_id).alias("test_id"), "tail"), "test_id", text="tail"))
        # Every id from the second on was observed once in a bigram of its chunk.
        observed = one.where("ord = 2").agg(F.sum("cnt")).first()[0] or 0
        base, last, done_early = table, None, False
        for epoch in range(1, phase.max_epochs + 1):
            mine.epoch, mine.tokens_trained = epoch, observed * epoch
            table = persisted(ngrams.merged(base, ngrams.scaled(one, epoch)))
            tell("evaluating")
            found = judge(table, tokenizer, phase.name, tests, last, epoch == 1)
            mine.perplexity_history.append(found.perplexity)
            mine.coverage_history.append(found.coverage)
            mine.sample_generation = found.sample or mine.sample_generation
            last = found.perplexity
            done_early = epoch > 1 and found.converged
            tell("training")
            if done_early or stop():
                break
        if phase.prune_threshold:
            tell("consolidating")
            table = persisted(ngrams.prune(table, phase.prune_threshold))
        if most_associations is not None:
            table = persisted(ngrams.evict(table, most_associations))
        trained += observed * mine.epoch
        state.finish(done_early)
        state.parts_done = 0
        save()
        tell("training")
        if stop():
            tell("stopped")
            return state
        resume = False
    tell("converged")
    return state


def split_by(table: DataFrame, allowed: DataFrame) -> DataFrame:
    """The associations whose next token is in ALLOWED (next): a model cut to a domain."""
    return table.join(allowed.select("next").distinct(), "next", "left_semi").select(table.columns)
