"""Problem 3: evaluation texts that stand in training text."""

from __future__ import annotations

import functools
import pickle
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyspark
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path, store_bytes, table
from .common import spread

#: Successive words that make a passage.
WORDS = 10
#: Words of a block of the shift table.
BLOCK = 2
#: Characters of test items from which one searcher is built at a time on the driver; more items give more searchers, all used in the same scan.
ITEM_CHARS = 16_000_000
#: Words of which a worker remembers the hash.
REMEMBERED_WORDS = 200_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The runs of letters and digits without letter case; the two characters backslash and n, or backslash and t, part words."""
    return _WORD.findall((text or "").replace("\\n", " ").replace("\\t", " ").casefold())


@functools.lru_cache(maxsize=REMEMBERED_WORDS)
def _hashed(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _block_hash(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    mixed = (first * np.uint64(0x9E3779B97F4A7C15) + second) * np.uint64(0xD1B54A32D192ED03)
    return (mixed >> np.uint64(64 - bits)).astype(np.int32)


class WuManber:
    """Multi-pattern search over words: patterns are all runs of WORDS words of the items.

    The shift table holds for each hash of a block of BLOCK words how far it stands, at least, from the end of a pattern; any other block lets the window move past it at once. A block that ends a
    pattern leads to its bucket, by its hash as the suffix; there patterns are told apart by the hash of their first block and then compared word by word. Everything is arrays
    (about 40 bytes a word of the items), so a searcher can be mapped from a file that all processes of a machine share.
    """

    PARTS = ("shift", "starts", "order", "prefix", "at", "owner", "letters", "places")

    def __init__(self, items: Iterable[tuple[int, str | None]], length: int = WORDS):
        self.length = length
        none = np.empty(0, np.int32)
        hashes, at, owner, spelled, sizes = [np.empty(0, np.uint64)], [none], [none], [], [none]
        ids: list = []
        n = 0
        for item, text in items:
            found = words(text)
            if len(found) < length:
                continue
            runs = len(found) - length + 1
            at.append(np.arange(n, n + runs, dtype=np.int32))
            owner.append(np.full(runs, len(ids), np.int32))
            ids.append(item)
            hashes.append(np.fromiter(map(_hashed, found), np.uint64, len(found)))
            raw = [w.encode() for w in found]
            spelled.append(b" ".join(raw))
            sizes.append(np.fromiter(map(len, raw), np.int32, len(raw)))
            n += len(found)
        self.ids, self.at, self.owner = ids, np.concatenate(at), np.concatenate(owner)
        h = np.concatenate(hashes)
        self.bits = max(10, (2 * n).bit_length())
        self.shift = np.full(1 << self.bits, length - BLOCK + 1, np.uint8)
        pair = _block_hash(h[:-1], h[1:], self.bits)
        for end in range(BLOCK, length + 1):  # the least shift is written last
            self.shift[pair[self.at + end - BLOCK]] = length - end
        suffix = pair[self.at + length - BLOCK]
        self.order = np.argsort(suffix, kind="stable").astype(np.int32)
        self.starts = np.searchsorted(suffix[self.order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.prefix = pair[self.at]
        # The words themselves, spaced, for the comparison.
        self.letters = np.frombuffer(b" ".join(spelled), np.uint8)
        self.places = np.concatenate([[0], np.cumsum(np.concatenate(sizes).astype(np.int64) + 1)])

    def to_bytes(self) -> bytes:
        """A description, then the arrays, each at a multiple of 64 bytes."""
        arrays = [np.ascontiguousarray(getattr(self, name)) for name in self.PARTS]
        places = np.concatenate([[0], np.cumsum([-(-a.nbytes // 64) * 64 for a in arrays])]).tolist()
        described = pickle.dumps((self.ids, self.length, self.bits, [(a.dtype.str, a.size, at) for a, at in zip(arrays, places)]))
        head = struct.pack("<Q", len(described)) + described
        return b"".join([head.ljust(-(-len(head) // 64) * 64, b"\0"), *[a.tobytes().ljust(-(-a.nbytes // 64) * 64, b"\0") for a in arrays]])

    @classmethod
    def load(cls, path: str) -> WuManber:
        out = cls.__new__(cls)
        with open(path, "rb") as f:
            (size,) = struct.unpack("<Q", f.read(8))
            out.ids, out.length, out.bits, arrays = pickle.loads(f.read(size))
        begin = -(-(8 + size) // 64) * 64
        held = np.memmap(path, np.uint8, "r")
        for name, (kind, n, at) in zip(cls.PARTS, arrays):
            setattr(out, name, np.asarray(held[begin + at : begin + at + n * np.dtype(kind).itemsize]).view(kind))
        return out

    def found(self, text: str | None) -> set[int]:
        """The items of which TEXT holds a passage."""
        return self.found_in([words(text)])[0]

    def found_in(self, texts: list[list[str]], hashes: np.ndarray | None = None) -> list[set[int]]:
        """Of each text, as words, the items of which it holds a passage. The words of all texts are hashed and their shifts looked up in one go; then each text is walked by itself."""
        out: list[set[int]] = [set() for _ in texts]
        h = hashed(texts) if hashes is None else hashes
        if len(h) < self.length or not len(self.at):
            return out
        length = self.length
        blocks = _block_hash(h[:-1], h[1:], self.bits)
        shift = self.shift[blocks].tobytes()  # of the block that ends at each word but the first
        begin = 0
        for k, found in enumerate(texts):
            stop = begin + len(found)
            end = begin + length - 1
            while end < stop:
                skip = shift[end - 1]
                if skip:
                    end += skip
                    continue
                block, start = blocks[end - 1], end - length + 1
                bucket = self.order[self.starts[block] : self.starts[block + 1]]
                bucket = bucket[self.prefix[bucket] == blocks[start]]
                if len(bucket):
                    spelled = " ".join(found[start - begin : end + 1 - begin]).encode()
                    for p in bucket:
                        first = self.places[self.at[p]]
                        item = self.ids[self.owner[p]]
                        if item not in out[k] and self.letters[first : self.places[self.at[p] + length] - 1].tobytes() == spelled:
                            out[k].add(item)
                end += 1
            begin = stop
        return out


def hashed(texts: list[list[str]]) -> np.ndarray:
    """The hashes of the words of all texts, one after the other."""
    return np.fromiter((_hashed(w) for found in texts for w in found), np.uint64)


def item_blocks(items: DataFrame, id_column: str, text_column: str, most_chars: int = ITEM_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, read one after the other."""
    block, size = [], 0
    rows = items.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("id IS NOT NULL AND text IS NOT NULL").distinct()
    for row in rows.toLocalIterator():
        if block and size + len(row["text"]) > most_chars:
            yield block
            block, size = [], 0
        block.append((row["id"], row["text"]))
        size += len(row["text"])
    yield block


@functools.lru_cache(maxsize=64)
def _searcher(name: str) -> WuManber:
    """A searcher of this process, mapped from the files that Spark sent to the machine."""
    return WuManber.load(pyspark.SparkFiles.get(name))


def _shipped(spark: SparkSession, matcher: WuManber) -> str:
    """The name under which every machine finds MATCHER: written once to the shared folder, fetched once by each executor, and mapped by all its processes."""
    name = f"searcher-{uuid.uuid4()}"
    path = shared_path(spark, name)
    store_bytes(spark, path, matcher.to_bytes())
    spark.sparkContext.addFile(path)
    return name


def leaked(corpus: DataFrame, id_column: str, text_column: str, items: DataFrame, item_id: str, item_text: str, most_chars: int = ITEM_CHARS) -> DataFrame:
    """id_column, item_id: one row for each text of the corpus and item of which it holds WORDS successive words.

    Null and empty texts hold none, items of fewer words are never found, equal items are all found, rows delivered again count once. Texts are searched whole, in one scan of the corpus for all items.
    """
    spark, schema = corpus.sparkSession, corpus.select(F.col(id_column)).schema.add(item_id, items.schema[item_id].dataType)
    rows = spread(corpus.select(id_column, text_column).where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull()))
    names = [_shipped(spark, WuManber(block)) for block in item_blocks(items, item_id, item_text, most_chars)]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searchers = [_searcher(name) for name in names]
        for batch in batches:
            split = [words(text) for text in batch[text_column]]
            h = hashed(split)
            pairs = [(i, item) for s in searchers for i, items in zip(batch[id_column], s.found_in(split, h)) for item in items]
            yield pd.DataFrame(pairs, columns=[id_column, item_id])

    return rows.mapInPandas(search, schema).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "download_code"), "file_id", "content", table(spark, sf_dir, "generation_sample"), "sample_id", "prompt")
