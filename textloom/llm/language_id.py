"""Problem 4: the languages of texts and of their segments."""

from __future__ import annotations

import hashlib
import io
import pickle
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path, store_bytes, stored_bytes, table
from .common import spellings, spread

#: About so many labelled values of each language are read for training; this bounds the sample, whatever the size of the table.
ROWS_PER_LANGUAGE = 4000
#: Longer values are no part of the sample, so that it is bounded in bytes too.
SAMPLE_CHARS = 4000
#: Segments of each language that training sees, repeated up to the lower number where there are fewer.
MOST_SEGMENTS, LEAST_SEGMENTS = 8000, 1200
#: Changes with what training does, so that stored networks of another way of training aren't taken.
SOURCE = "byte convolution 2"
#: Bytes of a window.
WINDOW = 64
#: Letters below which a segment is too short to be of another language than its text.
SHORT = 10
#: A segment is of another language than its text's main one only if that is at least so probable, and by so much more (as a logarithm) than the main one.
LIKELY, MARGIN = 0.6, 1.5
#: How much more likely, as a logarithm, the main language of a whole text must be than its label to contradict it.
AGAINST_LABEL = 1.0
#: Share of the segments that training sees as typed plainly, without the letters and marks a plain keyboard lacks.
PLAIN_SHARE = 0.3
#: What such letters are typed as.
PLAIN_LETTERS = str.maketrans({"ɔ": "o", "ɛ": "e", "ŋ": "n", "ɖ": "d", "ƒ": "f", "ɣ": "g", "ʋ": "v", "ɗ": "d", "ƙ": "k", "ɓ": "b", "ƴ": "y", "œ": "oe", "æ": "ae"})

_MASKED = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|<\|[^|>]*\|>|https?://\S+|\S+@\S+|\((?:[^()\s]+\s?){0,3}\)", re.S)
_MARK = re.compile(r"""(?<!\s\w)(?<!^\w)(?<!\b[A-Z]\w)(?<!\b[A-Z]\w\w)\.+(?!\w)|[!?…。！？]+|\n+|[;–—/|]+|\s-\s|[,:]+(?=\s|["“«])""")
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Letters below which a piece joins its neighbour: after a comma or colon (or with fewer than three words there), after other marks, and after a quotation.
PART_LETTERS, SENTENCE_LETTERS, SPEAKER_LETTERS = 12, 10, 24


def segments(text: str, plain: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of the sentences and clauses of a text that have letters.

    Code, addresses, special marks and short bracketed words are left out. Short clauses, and the words after a quotation, join the piece before them or, where they come first, the one after. PLAIN is the text with those masked, where it is known.
    """
    plain = masked(text) if plain is None else plain
    pieces: list[tuple[int, int, bool]] = []  # whether the piece is too short to stand alone within a sentence
    start, weak = 0, False
    for m in [*_MARK.finditer(plain), None]:
        end = m.start() if m else len(plain)
        if letters := len(_LETTER.findall(plain, start, end)):
            spoken = plain[start : start + 1] in ("\"", "”", "»")
            slight = letters < PART_LETTERS or len(_WORD.findall(plain, start, end)) < 3
            joins = letters < SPEAKER_LETTERS if spoken else slight if weak else letters < SENTENCE_LETTERS
            if pieces and (joins or weak and pieces[-1][2]):
                pieces[-1] = (pieces[-1][0], end, slight and pieces[-1][2])
            else:
                pieces.append((start, end, slight))
        if m:
            start, weak = m.end(), m[0][0] in ",:"
    return [(a, b) for a, b, _ in pieces]


def plainly(text: str) -> str:
    """A text as typed without special letters and marks."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower().translate(PLAIN_LETTERS)) if not unicodedata.combining(c))


def masked(text: str) -> str:
    return _MASKED.sub(lambda m: " " * len(m[0]), text)


def windows(text: str) -> list[bytes]:
    """The bytes of a text in lower case with single spaces, in windows of WINDOW bytes that begin at words; a long text gives as many as it takes."""
    words = [w.encode() for w in _WORD.findall(text.lower())]
    out: list[bytes] = []
    held = b""
    for w in words:
        while len(w) > WINDOW - 2:
            out.append(b" " + w[: WINDOW - 2] + b" ")
            w = w[WINDOW - 2 :]
        if held and len(held) + len(w) + 2 > WINDOW:
            out.append(held + b" ")
            held = b""
        held += b" " + w
    if held:
        out.append(held + b" ")
    # A last window of a few letters says little: it is filled up with the words before.
    if len(out) > 1 and len(out[-1]) < WINDOW // 2:
        tail = b" ".join(words)[-(WINDOW - 2) :]
        out[-1] = b" " + tail.split(b" ", 1)[-1] + b" "
    return out


def matrix(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), WINDOW), np.uint8)
    for i, row in enumerate(rows):
        out[i, : len(row)] = np.frombuffer(row[:WINDOW], np.uint8)
    return out


@dataclass
class ByteConvolution:
    """Byte embedding, filters of several widths, the maximum of each over the window, softmax. Trained and applied in numpy."""

    languages: list[str]
    widths: tuple[int, ...] = (3, 5, 7)
    dims: int = 12
    filters: int = 64
    seed: int = 7

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        n = len(self.languages)
        self.weights = {"embedding": rng.normal(0, 0.3, (256, self.dims)).astype(np.float32)}
        self.weights["embedding"][0] = 0
        for w in self.widths:
            self.weights[f"filter{w}"] = rng.normal(0, (2 / (w * self.dims)) ** 0.5, (w * self.dims, self.filters)).astype(np.float32)
            self.weights[f"bias{w}"] = np.zeros(self.filters, np.float32)
        self.weights["out"] = rng.normal(0, 0.1, (self.filters * len(self.widths), n)).astype(np.float32)
        self.weights["out_bias"] = np.zeros(n, np.float32)

    def to_bytes(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, languages=np.array(self.languages), **self.weights)
        return held.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> ByteConvolution:
        held = np.load(io.BytesIO(raw))
        out = cls([str(x) for x in held["languages"]])
        out.weights = {k: held[k] for k in out.weights}
        return out

    def _scores(self, batch: np.ndarray) -> Iterator[np.ndarray]:
        """Of each width, the score of each filter at each place of each window: one matrix product. Bytes past the end have no embedding, so a window scores the same in any batch."""
        rows, n = batch.shape
        padded = np.zeros((rows, n + max(self.widths) - 1), np.uint8)
        padded[:, :n] = batch
        embedded = self.weights["embedding"][padded]
        shape, (a, b, c) = (rows, n, max(self.widths) * self.dims), embedded.strides
        places = np.lib.stride_tricks.as_strided(embedded, shape, (a, b, c), writeable=False).reshape(rows * n, -1)
        for w in self.widths:
            yield (places[:, : w * self.dims] @ self.weights[f"filter{w}"]).reshape(rows, n, self.filters)

    def _features(self, batch: np.ndarray) -> np.ndarray:
        """The maximum of each filter over the window, not under 0."""
        return np.concatenate([np.maximum(scores.max(axis=1) + self.weights[f"bias{w}"], 0) for w, scores in zip(self.widths, self._scores(batch))], axis=1)

    def _fired(self, batch: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The features, and of each width and filter the place where it is reached."""
        parts, places = [], []
        for w, scores in zip(self.widths, self._scores(batch)):
            best = scores.max(axis=1)
            # Of equal places the last: the highest number among those that reach the maximum.
            at = ((scores == best[:, None, :]).view(np.uint8) * np.arange(scores.shape[1], dtype=np.uint8)[:, None]).max(axis=1).astype(np.int64)
            parts.append(np.maximum(best + self.weights[f"bias{w}"], 0))
            places.append(at)
        return np.concatenate(parts, axis=1), places

    def log_probabilities(self, batch: np.ndarray, size: int = 64) -> np.ndarray:
        out = np.empty((len(batch), len(self.languages)), np.float32)
        lengths = (batch != 0).sum(axis=1)
        order = np.argsort(lengths)
        for i in range(0, len(batch), size):
            own = order[i : i + size]
            logits = self._features(batch[own, : int(lengths[own[-1]])]) @ self.weights["out"] + self.weights["out_bias"]
            logits -= logits.max(axis=1, keepdims=True)
            out[own] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return out

    def train(self, batch: np.ndarray, labels: np.ndarray, epochs: int, rate: float = 0.003, size: int = 128) -> None:
        """Cross entropy by Adam; features are dropped at random so that no single word decides."""
        rng = np.random.default_rng(self.seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        lengths = (batch != 0).sum(axis=1)
        step, steps = 0, epochs * -(-len(batch) // size)
        for _ in range(epochs):
            # Windows of like length come together, so little of a batch is padding; the batches come in random order.
            order = np.argsort(lengths + rng.random(len(batch)) * 8)
            for i in rng.permutation(np.arange(0, len(order), size)):
                own = order[i : i + size]
                x = np.zeros((len(own), int(lengths[own].max()) + max(self.widths) - 1), np.uint8)
                x[:, : x.shape[1] - max(self.widths) + 1] = batch[own, : x.shape[1] - max(self.widths) + 1]
                features, places = self._fired(x[:, : x.shape[1] - max(self.widths) + 1])
                keep = (rng.random(features.shape, np.float32) > 0.2).astype(np.float32) / 0.8
                dropped = features * keep
                logits = dropped @ self.weights["out"] + self.weights["out_bias"]
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(own)), labels[own]] -= 1
                delta = p / len(own)
                gradient = {"out": dropped.T @ delta, "out_bias": delta.sum(axis=0), "embedding": np.zeros_like(self.weights["embedding"])}
                back = (delta @ self.weights["out"].T) * keep * (features > 0)
                for k, w in enumerate(self.widths):
                    g = back[:, k * self.filters : (k + 1) * self.filters]
                    row, filter_ = np.nonzero(g)
                    seen = x[row[:, None], places[k][row, filter_][:, None] + np.arange(w)]  # of each filter that counts, the bytes it fired at
                    filters = self.weights[f"filter{w}"].reshape(w, self.dims, self.filters)
                    # The sum of g by place, byte and filter gives the gradients of both factors of the table.
                    cells = (np.arange(w) * 256 + seen) * self.filters + filter_[:, None]
                    by_byte = np.bincount(cells.ravel(), np.repeat(g[row, filter_], w), w * 256 * self.filters).astype(np.float32).reshape(w, 256, self.filters)
                    of_filter = self.weights["embedding"].T @ by_byte
                    gradient["embedding"] += (by_byte @ filters.transpose(0, 2, 1)).sum(axis=0)
                    gradient[f"filter{w}"] = of_filter.reshape(w * self.dims, self.filters)
                    gradient[f"bias{w}"] = g.sum(axis=0)
                gradient["embedding"][0] = 0
                step += 1
                now = rate * (1 - step / (steps + 1))
                for name, g in gradient.items():
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.weights[name] -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def trained(texts: list[str], labels: list[str], seed: int = 7) -> ByteConvolution:
    """A network for the labels of the texts. Labels may be wrong at times and texts mixed: after a first training, segments that contradict their label are left out of the second."""
    languages = sorted(set(labels))
    rows: list[bytes] = []
    target: list[int] = []
    rng = np.random.default_rng(seed)
    for text, language in zip(texts, labels):
        plain = masked(text)
        for a, b in segments(text, plain):
            piece = plain[a:b]
            for w in windows(plainly(piece) if rng.random() < PLAIN_SHARE else piece):
                rows.append(w)
                target.append(languages.index(language))
    x, y = matrix(rows), np.array(target)
    chosen = []
    for k in range(len(languages)):
        own = rng.permutation(np.flatnonzero(y == k))[:MOST_SEGMENTS]
        if len(own):
            chosen.append(np.resize(own, max(len(own), LEAST_SEGMENTS)))
    chosen = np.concatenate(chosen)
    x, y = x[chosen], y[chosen]
    first = ByteConvolution(languages, seed=seed)
    first.train(x, y, 3)
    agree = first.log_probabilities(x)[np.arange(len(y)), y] > np.log(0.2)
    second = ByteConvolution(languages, seed=seed + 1)
    second.train(x[agree], y[agree], 8)
    return second


def judged(network: ByteConvolution, texts: list[str]) -> list[tuple[np.ndarray, list[tuple[int, int, int, np.ndarray]]]]:
    """Of each text, the log probabilities of its main language and (start, end, language, probabilities) of its segments; no segments where it has no words."""
    spans: list[tuple[int, int, int, int]] = []  # text, start, end, letters
    rows: dict[bytes, int] = {}  # each different window once
    which: list[int] = []
    owner: list[int] = []
    for i, text in enumerate(texts):
        plain = masked(text)
        for a, b in segments(text, plain):
            for w in windows(plain[a:b]):
                which.append(rows.setdefault(w, len(rows)))
                owner.append(len(spans))
            spans.append((i, a, b, len(_LETTER.findall(text, a, b))))
    n = len(network.languages)
    # Sums over the windows of a segment and the segments of a text, windows weighted by their bytes.
    logs = network.log_probabilities(matrix(list(rows)))[which]
    sizes = np.array([len(w) for w in rows], np.float32)[which]
    of = np.array(owner, np.int64)
    scores = np.stack([np.bincount(of, logs[:, k] * sizes, len(spans)) for k in range(n)], axis=1)
    weight = np.bincount(of, sizes, len(spans))
    totals = np.stack([np.bincount([s[0] for s in spans], scores[:, k], len(texts)) for k in range(n)], axis=1) / WINDOW
    mean = scores / np.maximum(weight, 1)[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True, initial=-np.inf))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1) if len(spans) else np.empty(0, np.int64)
    mains = totals.argmax(axis=1)
    main = mains[[s[0] for s in spans]] if spans else best
    each = np.arange(len(spans))
    letters = np.array([s[3] for s in spans])
    weak = (letters < SHORT) | (p[each, best] < LIKELY) | (p[each, main] > p[each, best] * np.exp(-MARGIN)) if len(spans) else np.empty(0, bool)
    chosen = np.where(weak, main, best)
    out: list[tuple[np.ndarray, list[tuple[int, int, int, np.ndarray]]]] = [(totals[i], []) for i in range(len(texts))]
    for k, (i, a, b, _) in enumerate(spans):
        if weight[k]:
            out[i][1].append((a, b, int(chosen[k]), p[k]))
    return out


def label_language(lang: Column, aliases: dict[str, str]) -> Column:
    """The language a label names by its spellings, compared without case and outer white space; null for anything else."""
    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return names[F.lower(F.regexp_replace(lang, r"(?U)^\s+|\s+$", ""))]


def training_sample(values: DataFrame) -> tuple[list[str], list[str]]:
    """Texts and languages of about ROWS_PER_LANGUAGE values of each label, chosen by a hash of their id."""
    counts = {r["label"]: r["n"] for r in values.where("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], []
    shares = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, ROWS_PER_LANGUAGE / n)))])
    draw = F.pmod(F.xxhash64("id", "field_name"), F.lit(1_000_000)) / 1_000_000
    rows = values.where(F.col("label").isNotNull() & (draw < shares[F.col("label")]) & (F.char_length("text") <= SAMPLE_CHARS)).select("id", "field_name", "text", "label").collect()
    rows.sort(key=lambda r: (r["id"], r["field_name"], r["text"]))
    return [r["text"] for r in rows], [r["label"] for r in rows]


def fitted(spark: SparkSession, texts: list[str], labels: list[str]) -> ByteConvolution:
    """The network for a sample: trained once and kept in the shared checkpoint folder under a digest of the sample, where later queries over the same labelled rows find it."""
    digest = hashlib.sha256(pickle.dumps((texts, labels, SOURCE))).hexdigest()
    path = shared_path(spark, f"language-network-{digest}")
    raw = stored_bytes(spark, path)
    if raw is not None:
        return ByteConvolution.from_bytes(raw)
    network = trained(texts, labels)
    store_bytes(spark, path, network.to_bytes())
    return network


def identified(rows: DataFrame, id_column: str, fields: list[str], lang_column: str, aliases: DataFrame) -> DataFrame:
    """id, field_name, label, lang, start_char, end_char, confidence, main: one row for each segment of each value, in its language.

    Null, empty and word-less values have none. Rows delivered again give their segments again. MAIN is the main language of the value.
    """
    known = spellings(aliases)
    if not known:
        raise ValueError("no language has a label")
    values = rows.select(
        F.col(id_column).alias("id"),
        label_language(F.col(lang_column), known).alias("label"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("value"),
    ).select("id", "label", "value.*")
    values = values.where(F.regexp_like("text", F.lit(r"\p{L}")))
    texts, labels = training_sample(values)
    fields_out = "field_name string, label string, lang string, start_char long, end_char long, confidence double, main string"
    schema = rows.select(F.col(id_column).alias("id")).schema
    for part in fields_out.split(", "):
        name, kind = part.split()
        schema = schema.add(name, kind)
    if not texts:
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast(fitted(rows.sparkSession, texts, labels))

    def identify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        network = shared.value
        names = network.languages
        for batch in batches:
            for i in range(0, len(batch), 5000):
                part = batch.iloc[i : i + 5000]
                out = []
                for row_id, name, label, (total, parts) in zip(part["id"], part["field_name"], part["label"], judged(network, list(part["text"]))):
                    main = int(total.argmax())
                    if label in names and names.index(label) not in {k for _, _, k, _ in parts} and total[main] - total[names.index(label)] < AGAINST_LABEL:
                        # Too little against the label: segments of the main language are held to be of the label's.
                        parts = [(a, b, names.index(label) if k == main else k, p) for a, b, k, p in parts]
                        main = names.index(label)
                    # The confidence is that of the language a segment is given.
                    out += [(row_id, name, label, names[k], a, b, float(p[k]), names[main]) for a, b, k, p in parts]
                yield pd.DataFrame(out, columns=schema.names)

    return spread(values).mapInPandas(identify, schema)


def cases(found: DataFrame) -> DataFrame:
    """id, field_name, lang: the languages of each value whose label is missing or isn't its one language."""
    languages = found.groupBy("id", "field_name").agg(F.min("label").alias("label"), F.collect_set("lang").alias("langs"))  # a set of a few languages
    wrong = F.col("label").isNull() | (F.size("langs") > 1) | (F.element_at("langs", 1) != F.col("label"))
    return languages.where(wrong).select("id", "field_name", F.explode("langs").alias("lang"))


FIELDS = ["answer", "question"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(identified(table(spark, sf_dir, "download_twi"), "row_id", FIELDS, "lang", table(spark, sf_dir, "lang_alias"))).withColumnRenamed("id", "row_id")


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment with its language and confidence."""
    found = identified(table(spark, sf_dir, "download_twi"), "row_id", FIELDS, "lang", table(spark, sf_dir, "lang_alias"))
    return found.distinct().withColumnRenamed("id", "row_id").drop("label").withColumn("confidence", F.round("confidence", 4))
