"""The one-file binary model format: header, tokenizer, count tables; little endian throughout."""

from __future__ import annotations

import itertools
import json
import os
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

VERSION = 1
#: The four bytes a file begins with: a parameter, since each producer has its own.
MAGIC = b"TXLM"


class FormatError(ValueError):
    """A file that is no model, is cut short or is of a newer version."""


@dataclass
class Model:
    """A whole model in memory: for files that a single machine wrote. Distributed models are Parquet folders."""

    name: str = "model"
    vocab: list[str] = field(default_factory=list)
    merges: list[tuple[str, str, str]] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.05, 0.15, 0.30, 0.50])
    #: order -> context -> next -> count
    tables: dict[int, dict[tuple[int, ...], dict[int, int]]] = field(default_factory=dict)
    tokens_trained: int = 0
    context_window: int = 128
    created_at: int = 0
    checksum_holds: bool = True

    @property
    def associations(self) -> int:
        return sum(len(n) for t in self.tables.values() for n in t.values())


class _Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, form: str) -> int | float:
        size = struct.calcsize("<" + form)
        if self.at + size > len(self.data):
            raise FormatError("the file is cut short")
        (value,) = struct.unpack_from("<" + form, self.data, self.at)
        self.at += size
        return value

    def text(self, length: int) -> str:
        if self.at + length > len(self.data):
            raise FormatError("the file is cut short")
        raw = self.data[self.at : self.at + length]
        self.at += length
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError as e:
            raise FormatError("a text is no UTF-8") from e


def _short(text: str) -> bytes:
    raw = text.encode()
    return struct.pack("<H", len(raw)) + raw


def encode(model: Model, magic: bytes = MAGIC) -> bytes:
    tokenizer = struct.pack("<I", len(model.vocab)) + b"".join(map(_short, model.vocab))
    tokenizer += struct.pack("<I", len(model.merges)) + b"".join(_short(x) for m in model.merges for x in m)
    tables = b""
    for order in sorted(model.tables):
        t = model.tables[order]
        body = struct.pack("<BQ", order, len(t))
        for ctx, following in t.items():
            body += struct.pack(f"<{len(ctx)}HI", *ctx, len(following))
            body += b"".join(struct.pack("<HI", n, min(c, 0xFFFFFFFF)) for n, c in following.items())
        tables += struct.pack("<Q", len(body)) + body
    brain = struct.pack("<B", len(model.weights)) + struct.pack(f"<{len(model.weights)}d", *model.weights) + struct.pack("<Q", model.tokens_trained) + tables
    name = model.name.encode()
    size = 67 + len(name)
    header = magic + struct.pack("<HII", VERSION, size, len(name)) + name
    header += struct.pack("<IIBQQQIQQ", len(model.vocab), model.context_window, len(model.tables), model.associations, model.tokens_trained, model.created_at, zlib.crc32(tokenizer + brain), size, size + len(tokenizer))
    return header + tokenizer + brain


def header(data: bytes, magic: bytes = MAGIC) -> dict[str, int | str]:
    if data[:4] != magic:
        raise FormatError("the file doesn't begin as a model does")
    r = _Reader(data, 4)
    out: dict[str, int | str] = {"version": r.take("H")}
    if out["version"] > VERSION:
        raise FormatError(f"version {out['version']} is newer than {VERSION}")
    out["header_size"] = r.take("I")
    out["name"] = r.text(r.take("I"))
    for key, form in (("vocab_size", "I"), ("context_window", "I"), ("orders", "B"), ("associations", "Q"), ("tokens_trained", "Q"), ("created_at", "Q"), ("checksum", "I"), ("tokenizer_offset", "Q"), ("tables_offset", "Q")):
        out[key] = r.take(form)
    return out


def decode(data: bytes, magic: bytes = MAGIC) -> Model:
    """The model of a file; a wrong checksum is told by checksum_holds."""
    h = header(data, magic)
    start = int(h["tokenizer_offset"])
    r = _Reader(data, start)
    vocab = [r.text(r.take("H")) for _ in range(r.take("I"))]
    merges = [(r.text(r.take("H")), r.text(r.take("H")), r.text(r.take("H"))) for _ in range(r.take("I"))]
    weights = [r.take("d") for _ in range(r.take("B"))]
    tokens_trained = r.take("Q")
    tables: dict[int, dict[tuple[int, ...], dict[int, int]]] = {}
    for _ in range(int(h["orders"])):
        r.take("Q")
        order = r.take("B")
        t = tables[order] = {}
        for _ in range(r.take("Q")):
            ctx = tuple(r.take("H") for _ in range(order - 1))
            t[ctx] = {r.take("H"): r.take("I") for _ in range(r.take("I"))}
    return Model(str(h["name"]), vocab, merges, weights, tables, tokens_trained, int(h["context_window"]), int(h["created_at"]), zlib.crc32(data[start : r.at]) == h["checksum"])


class _Stream(_Reader):
    """A reader of an open file, a buffer at a time."""

    def __init__(self, file, at: int):  # noqa: ANN001
        self.file = file
        file.seek(at)

    def raw(self, size: int) -> bytes:
        data = self.file.read(size)
        if len(data) < size:
            raise FormatError("the file is cut short")
        return data

    def take(self, form: str) -> int | float:
        return struct.unpack("<" + form, self.raw(struct.calcsize("<" + form)))[0]

    def text(self, length: int) -> str:
        return _Reader(self.raw(length)).text(length)


def file_header(file, magic: bytes = MAGIC) -> dict[str, int | str]:  # noqa: ANN001
    """The header alone: a few bytes from the head of the file."""
    file.seek(0)
    start = file.read(14)
    length = struct.unpack_from("<I", start, 10)[0] if len(start) == 14 else 0
    return header(start + file.read(length + 53), magic)


def sections(file, magic: bytes = MAGIC) -> list[tuple[int, int]]:  # noqa: ANN001
    """Where each count table begins, and its bytes: found by leaps from one length to the next, without reading a table."""
    h = file_header(file, magic)
    r = _Stream(file, int(h["tables_offset"]))
    at = int(h["tables_offset"]) + 1 + 8 * int(r.take("B")) + 8
    out = []
    for _ in range(int(h["orders"])):
        size = int(_Stream(file, at).take("Q"))
        out.append((at + 8, size))
        at += 8 + size
    return out


def entries(file, at: int) -> Iterator[tuple[int, list[int], int, int]]:  # noqa: ANN001
    """(order, context, next, count) of the count table that begins there, held in memory one context at a time."""
    r = _Stream(file, at)
    order = int(r.take("B"))
    for _ in range(int(r.take("Q"))):
        *ctx, n = struct.unpack(f"<{order - 1}HI", r.raw(2 * (order - 1) + 4))
        for following, count in struct.iter_unpack("<HI", r.raw(6 * n)):
            yield order, ctx, following, count


class BinaryModelSource(DataSource):
    """spark.read.format("binary_model").option("part", "counts" | "vocab" | "merges").load(path): a partition for each count table, which seeks to its place.

    write_binary() writes such a file; the path must be in a folder that all executors share.
    """

    @classmethod
    def name(cls) -> str:
        return "binary_model"

    def schema(self) -> str:
        return {"counts": "ord int, ctx array<int>, next int, cnt long", "vocab": "token_id int, token string", "merges": "rank int, l string, r string, merged string"}[self.options.get("part", "counts")]

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _ModelReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return _ModelWriter(self.options, overwrite)


class _ModelReader(DataSourceReader):
    def __init__(self, options):  # noqa: ANN001
        self.path = options["path"].removeprefix("file:")
        self.part = options.get("part", "counts")
        self.magic = options.get("magic", MAGIC.decode()).encode()

    def partitions(self) -> list[InputPartition]:
        with open(self.path, "rb") as f:
            if self.part == "counts":
                return [InputPartition(at) for at, _ in sections(f, self.magic)] or [InputPartition(None)]
            return [InputPartition(int(file_header(f, self.magic)["tokenizer_offset"]))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        with open(self.path, "rb") as f:
            if self.part == "counts":
                yield from entries(f, partition.value)
                return
            r = _Stream(f, partition.value)
            for k in range(int(r.take("I"))):
                token = r.text(int(r.take("H")))
                if self.part == "vocab":
                    yield k, token
            if self.part == "merges":
                for k in range(int(r.take("I"))):
                    yield k + 1, *[r.text(int(r.take("H"))) for _ in range(3)]


@dataclass
class _Written(WriterCommitMessage):
    #: order -> (file, contexts, associations)
    parts: dict[int, tuple[str, int, int]]


class _ModelWriter(DataSourceWriter):
    """Each task writes the contexts of its rows, in which those of a context follow each other, beside the file; the driver puts the parts together a block at a time."""

    def __init__(self, options, overwrite: bool):  # noqa: ANN001
        self.path = options["path"].removeprefix("file:")
        self.magic = options.get("magic", MAGIC.decode()).encode()
        self.described = json.loads(options.get("described", "{}"))
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)

    def write(self, iterator: Iterator) -> _Written:
        files, held = {}, {}
        for (order, ctx), rows in itertools.groupby(iterator, key=lambda r: (r["ord"], tuple(r["ctx"]))):
            following = [(r["next"], min(r["cnt"], 0xFFFFFFFF)) for r in rows]
            if order not in files:
                name = f"{self.path}.{uuid.uuid4()}"
                files[order], held[order] = open(name, "wb"), [name, 0, 0]
            files[order].write(struct.pack(f"<{len(ctx)}HI", *ctx, len(following)) + b"".join(struct.pack("<HI", *x) for x in following))
            held[order][1] += 1
            held[order][2] += len(following)
        for f in files.values():
            f.close()
        return _Written({k: tuple(v) for k, v in held.items()})

    def commit(self, messages: list) -> None:
        parts = [m.parts for m in messages if m]
        orders = sorted({o for p in parts for o in p})
        d = self.described
        head = Model(d.get("name", "model"), d.get("vocab", []), [tuple(m) for m in d.get("merges", [])], tokens_trained=d.get("tokens_trained", 0), created_at=d.get("created_at", 0))
        empty = encode(head, self.magic)
        places = header(empty, self.magic)
        beside = f"{self.path}.{uuid.uuid4()}"
        with open(beside, "wb") as out:
            out.write(empty)
            crc = zlib.crc32(empty[int(places["tokenizer_offset"]) :])
            for o in orders:
                own = [p[o] for p in parts if o in p]
                start = struct.pack("<QBQ", 9 + sum(os.path.getsize(name) for name, _, _ in own), o, sum(n for _, n, _ in own))
                out.write(start)
                crc = zlib.crc32(start, crc)
                for name, _, _ in own:
                    with open(name, "rb") as f:
                        while block := f.read(1 << 22):
                            out.write(block)
                            crc = zlib.crc32(block, crc)
            # The fields that only now are known: orders, associations, checksum.
            at = 14 + len(head.name.encode())
            out.seek(at + 8)
            out.write(struct.pack("<BQ", len(orders), sum(p[o][2] for p in parts for o in p)))
            out.seek(at + 8 + 9 + 16)
            out.write(struct.pack("<I", crc))
        os.replace(beside, self.path)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        for m in messages:
            for name, _, _ in m.parts.values() if m else ():
                if os.path.exists(name):
                    os.remove(name)


def write_binary(table: DataFrame, path: str, vocab: list[str], merges: list[tuple[str, str, str]], name: str = "model", tokens_trained: int = 0, created_at: int | None = None) -> None:
    """A count table over token ids below 65,536 (ord, ctx ARRAY<INT>, next, cnt) as one file of the format, its tables written by the tasks in parallel."""
    described = {"name": name, "vocab": vocab, "merges": merges, "tokens_trained": tokens_trained, "created_at": int(time.time()) if created_at is None else created_at}
    spark = table.sparkSession
    spark.dataSource.register(BinaryModelSource)
    rows = table.select(F.col("ord").cast("int").alias("ord"), F.col("ctx").cast("array<int>").alias("ctx"), F.col("next").cast("int").alias("next"), F.col("cnt").cast("long").alias("cnt"))
    rows = rows.repartition("ord", "ctx").sortWithinPartitions("ord", "ctx", F.desc("cnt"), "next")
    rows.write.format("binary_model").option("described", json.dumps(described)).mode("overwrite").save(path)
