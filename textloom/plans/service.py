"""What a server and a command line offer, as functions over data frames: batch generation, model information, merging, export."""

from __future__ import annotations

import argparse
import signal
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pretokens
from ..operators import bpe, ngrams, predict
from ..session import persisted
from ..sources import corpus, model
from .curriculum import Tokenizer, train


def generate_batch(requests: DataFrame, table: DataFrame, max_tokens: int = 128, sampler: predict.Sampler | None = None, stop: str | list[str] | None = None) -> DataFrame:
    """id, text, n_tokens for requests (id, prompt) by a table over pre-tokens: all prompts at once. STOP holds tokens that end a text."""
    prompts = requests.select("id", F.coalesce(pretokens(F.col("prompt")), F.array().cast("array<string>")).alias("tokens"))
    made = predict.generate(prompts, table, max_tokens, "id", sampler, stop=stop)
    return made.select("id", F.array_join("generated", "").alias("text"), F.size("generated").alias("n_tokens"))


@dataclass(frozen=True)
class Loaded:
    """A trained model over token ids, read from its folder."""

    path: str
    meta: dict
    tokenizer: Tokenizer
    table: DataFrame

    def tokenize(self, texts: DataFrame, *keep: str, text: str = "text") -> DataFrame:
        """KEEP, ids of each text; null and empty texts have none."""
        return self.tokenizer.ids(texts, *keep, text=text)

    def detokenize(self, rows: DataFrame, *keep: str, ids: str = "ids") -> DataFrame:
        return rows.select(*keep, bpe.decoded(F.col(ids), self.tokenizer.vocab).alias("text"))

    def generate(self, requests: DataFrame, max_tokens: int = 128, sampler: predict.Sampler | None = None, stop: list[str] | None = None, seed: int = 42) -> DataFrame:
        """id, text, n_tokens, finish for requests (id, prompt). A text ends before the first of the sequences STOP; finish is "stop" there and where no token follows, else "length"."""
        asked = self.tokenize(requests, "id", text="prompt").withColumnRenamed("ids", "tokens")
        made = predict.generate(persisted(asked), self.table, max_tokens, "id", sampler, seed, ids=True)
        texts = made.select("id", bpe.decoded(F.col("generated"), self.tokenizer.vocab).alias("whole"), F.size("generated").alias("n_tokens"))
        ends = [F.when(F.instr("whole", x) > 0, F.instr("whole", x)) for x in stop or [] if x]
        end = F.least(*ends, F.lit(None).cast("int")) if len(ends) > 1 else ends[0] if ends else F.lit(None).cast("int")
        finish = F.when(end.isNotNull() | (F.col("n_tokens") < max_tokens), "stop").otherwise("length")
        return texts.select("id", F.when(end.isNotNull(), F.col("whole").substr(F.lit(1), end - 1)).otherwise(F.col("whole")).alias("text"), "n_tokens", finish.alias("finish"))


def load(spark: SparkSession, path: str) -> Loaded:
    meta = model.meta(spark, path)
    return Loaded(path, meta, Tokenizer.read(spark, path), model.counts(spark, path).select("ord", "ctx", "next", "cnt"))


def health(loaded: Loaded | None) -> dict[str, object]:
    return {"status": "ok", "model": loaded.meta["name"] if loaded else None}


@dataclass
class Chat:
    """A talk of several turns: each answer goes on from all that was said before it."""

    model: Loaded
    max_tokens: int = 128
    sampler: predict.Sampler | None = None
    said: str = ""
    turns: list[tuple[str, str]] = field(default_factory=list)

    def say(self, line: str) -> str:
        """The answer to a line; a blank one has none and leaves the talk as it is."""
        if not line.strip():
            return ""
        spark = self.model.table.sparkSession
        prompt = f"{self.said}{line}\n"
        answer = self.model.generate(spark.createDataFrame([("turn", prompt)], "id string, prompt string"), self.max_tokens, self.sampler, seed=42 + len(self.turns)).first()["text"]
        self.said = f"{prompt}{answer}\n"
        self.turns.append((line, answer))
        return answer


def info(spark: SparkSession, path: str) -> DataFrame:
    """ord, contexts, associations, observations of a stored model."""
    return ngrams.stats(model.counts(spark, path)).orderBy("ord")


def merge(spark: SparkSession, paths: list[str], out: str, name: str = "merged") -> None:
    """Counts of stored models added up; tokens are compared as text, so vocabularies may differ."""
    model.write(out, ngrams.merged(*[model.counts(spark, p) for p in paths]), name=name)


def export_json(spark: SparkSession, path: str, out: str) -> None:
    model.counts(spark, path).write.mode("overwrite").json(out)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="textloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("info", "list"):
        commands.add_parser(name).add_argument("path")
    m = commands.add_parser("merge")
    m.add_argument("paths", nargs="+")
    m.add_argument("--out", required=True)
    e = commands.add_parser("export")
    e.add_argument("path")
    e.add_argument("--out", required=True)
    r = commands.add_parser("run")
    r.add_argument("path")
    r.add_argument("prompt", nargs="?", help="without it lines are read and answered in turn")
    r.add_argument("--max-tokens", type=int, default=128)
    r.add_argument("--temperature", type=float, default=0.8)
    t = commands.add_parser("train", help="a folder with a subfolder for each part of the curriculum")
    t.add_argument("data")
    t.add_argument("--out", required=True)
    t.add_argument("--progress")
    t.add_argument("--resume", action="store_true")
    t.add_argument("--vocabulary", type=int, default=22_000)
    t.add_argument("--files-a-part", type=int, default=None)
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    if a.command == "info":
        info(spark, a.path).show()
    elif a.command == "list":
        model.models(spark, a.path).show(truncate=False)
    elif a.command == "merge":
        merge(spark, a.paths, a.out)
    elif a.command == "export":
        export_json(spark, a.path, a.out)
    elif a.command == "train":
        train(folder_docs(spark, a.data), "path", "text", "part", a.out, a.progress, a.resume, vocabulary=a.vocabulary, files_a_part=a.files_a_part, stop=stopped())
    else:
        talk = Chat(load(spark, a.path), a.max_tokens, predict.Sampler(temperature=a.temperature))
        for line in [a.prompt] if a.prompt is not None else sys.stdin:
            print(talk.say(line.rstrip("\n")))


def folder_docs(spark: SparkSession, root: str) -> DataFrame:
    """path, part, text of the files of a training folder; the part is the folder's first."""
    return corpus.whole_files(spark, root).select("path", F.lower(F.element_at(F.split("path", "/"), 1)).alias("part"), "text")


def stopped() -> Callable[[], bool]:
    """Whether the process was asked to end: an interrupt or a termination lets the part at work finish and be stored."""
    asked = []
    for kind in (signal.SIGINT, signal.SIGTERM):
        signal.signal(kind, lambda *_: asked.append(True))
    return lambda: bool(asked)


if __name__ == "__main__":
    main()
