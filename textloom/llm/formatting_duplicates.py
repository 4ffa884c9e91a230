"""Problem 1: records that differ only in how they are written."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import persisted, table, written

#: The names of parts in texts of named parts, as this project's data has them; a parameter of every function here.
PART_NAMES = ("emotion", "text", "speaker", "intensity")
#: Bits of one block of the filters; a hash belongs to one block and sets two bits in it.
BLOCK_BITS = 1 << 15
#: Bits a key gets, and the most blocks of one filter: 64 MB, for 67 million keys. More keys are parted by hash into so many filters, applied one after the other, so that none is ever fuller or larger.
BITS_PER_KEY, MOST_BLOCKS = 8, 1 << 14


def squashed(value: Column) -> Column:
    """The letters and digits of a value in order, without letter case."""
    return F.lower(F.upper(F.regexp_replace(value, r"[^\p{L}\p{N}]+", "")))


def canonical_value(value: Column, part_names: tuple[str, ...] = PART_NAMES) -> Column:
    """What two values written differently have in common; null where there is no letter or digit.

    Texts of named parts (JSON, name=value or name: value between semicolons, bars, commas or line breaks) give their parts in order of name and value.
    """
    name = rf"(?i)(^|[;|,\n{{])[^\p{{L}}\p{{N}}]*({'|'.join(part_names)})[^\p{{L}}\p{{N}}:=;|\n]*[:=]"
    marked = F.regexp_replace(value, name, "\u0001$2\u0002")
    parts = F.transform(
        F.filter(F.split(marked, "\u0001"), lambda p: p != ""),
        lambda p: F.concat(squashed(F.substring_index(p, "\u0002", 1)), F.lit("\u0002"), squashed(F.substring_index(p, "\u0002", -1))),
    )
    whole = F.when(F.startswith(marked, F.lit("\u0001")), F.concat(F.lit("\u0001"), F.array_join(F.array_sort(parts), "\u0001"))).otherwise(squashed(value))
    return F.when(F.regexp_like(value, F.lit(r"[\p{L}\p{N}]")), whole)


def canonical_record(*values: Column, part_names: tuple[str, ...] = PART_NAMES) -> Column:
    """The set of the canonical values as one string, whatever field each stands in; null where no value has a letter or digit."""
    found = F.array_sort(F.array_distinct(F.filter(F.array(*[canonical_value(v, part_names) for v in values]), lambda v: v.isNotNull())))
    return F.when(F.size(found) > 0, F.array_join(found, "\u0003"))


def _positions(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash and its two bits there."""
    h = hashes.view(np.uint64)
    bits = np.stack([(h >> np.uint64(34)) % np.uint64(BLOCK_BITS), (h >> np.uint64(49)) % np.uint64(BLOCK_BITS)])
    return (h % np.uint64(blocks)).astype(np.int64), bits.astype(np.int64)


def _folded(rows: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of rows in order of their block, one row for each: a bit set in the filters of two partitions counts as set again."""
    block, once, again = -1, None, None
    for b, o, a in rows:
        if b != block:
            if once is not None:
                yield block, once, again
            block, once, again = b, o.copy(), a.copy()
        else:
            again |= a | (once & o)
            once |= o
    if once is not None:
        yield block, once, again


def repeat_filter(hashes: DataFrame, blocks: int) -> np.ndarray:
    """blocks x bytes: the bits of every hash that the one column of HASHES holds more than once, among those of some held once.

    Each partition makes Bloom filters of the hashes it saw once and again. They are merged block by block, in order, so a task holds one block at a time; two filters of once-seen hashes give
    their common bits to the filter of repeats. Only that one, of a fixed size at most, comes to the driver.
    """
    column = hashes.columns[0]
    schema = "block long, once binary, again binary"

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [b[column].to_numpy(dtype=np.int64) for b in batches]
        keys, counts = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.empty(0, np.int64), np.empty(0))
        block, bits = _positions(keys, blocks)
        order = np.argsort(block, kind="stable")
        edges = np.flatnonzero(np.diff(block[order])) + 1
        out = []
        for own in np.split(order, edges) if len(order) else []:
            pair = np.zeros((2, BLOCK_BITS), bool)
            pair[0, bits[:, own].ravel()] = True
            pair[1, bits[:, own[counts[own] > 1]].ravel()] = True
            packed = np.packbits(pair, axis=1)
            out.append((int(block[own[0]]), zlib.compress(packed[0].tobytes(), 1), zlib.compress(packed[1].tobytes(), 1)))
            if len(out) == 1000:
                yield pd.DataFrame(out, columns=["block", "once", "again"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["block", "once", "again"])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = lambda x: np.frombuffer(zlib.decompress(x), np.uint8)
        rows = ((b, unpack(o), unpack(a)) for x in batches for b, o, a in zip(x["block"], x["once"], x["again"]))
        for b, o, a in _folded(rows):
            if a.any():
                yield pd.DataFrame([(b, zlib.compress(a.tobytes(), 1))], columns=["block", "again"])

    merged = hashes.mapInPandas(build, schema).repartition("block").sortWithinPartitions("block").mapInPandas(merge, "block long, again binary")
    again = np.zeros((blocks, BLOCK_BITS // 8), np.uint8)
    for row in merged.toLocalIterator():
        again[row["block"]] = np.frombuffer(zlib.decompress(row["again"]), np.uint8)
    return again


def with_possible_repeats(records: DataFrame, n: int) -> DataFrame:
    """RECORDS (with a long column "hash", at most N different ones) and a column "repeats": false only where the hash certainly stands alone."""
    blocks = 1
    while blocks * BLOCK_BITS < n * BITS_PER_KEY and blocks < MOST_BLOCKS:
        blocks *= 2
    shared = records.sparkSession.sparkContext.broadcast(repeat_filter(records.select("hash"), blocks))

    @F.pandas_udf("boolean")
    def repeats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        again = shared.value
        for batch in batches:
            block, bits = _positions(batch.to_numpy(dtype=np.int64), blocks)
            yield pd.Series(((again[block, bits >> 3] >> (7 - (bits & 7))) & 1).all(axis=0))

    return records.withColumn("repeats", repeats("hash"))


def split_records(rows: DataFrame, id_column: str, *values: str, part_names: tuple[str, ...] = PART_NAMES, most_keys: int = MOST_BLOCKS * BLOCK_BITS // BITS_PER_KEY) -> tuple[DataFrame, DataFrame]:
    """(id) of the records that certainly stand alone, and (id, key) of each different id among the possible repeats.

    Rows without any letter or digit in VALUES or without an id are no records. A row delivered again under its id has the same key, so it is among the possible repeats and counts once there.
    The table is read and made canonical once; its hashes and keys are stored, parted by hash where there are more rows than MOST_KEYS, the number one filter serves. Each part has a filter of its own.
    """
    n = max(1, rows.count())
    parts = -(-n // most_keys)
    canonical = canonical_record(*map(F.col, values), part_names=part_names)
    keyed = rows.select(F.col(id_column).alias("id"), canonical.alias("canonical")).where(F.col("id").isNotNull() & F.col("canonical").isNotNull())
    records = keyed.select("id", F.unhex(F.sha2("canonical", 256)).alias("key"), F.xxhash64("canonical").alias("hash"))
    kept = written(records.withColumn("part", F.pmod(F.xxhash64("hash"), F.lit(parts)).cast("int")), *(["part"] if parts > 1 else []))
    alone, repeats = [], []
    for k in range(parts):
        own = with_possible_repeats(kept.where(F.col("part") == k), -(-n // parts))
        # The filter is not deterministic to Spark, so the stored rows are read by both sides; only one filter is in use at a time.
        stored = persisted(own.select("id", F.when(F.col("repeats"), F.col("key")).alias("key")))
        alone.append(stored.where("key IS NULL").select("id"))
        repeats.append(stored.where("key IS NOT NULL"))
    return functools.reduce(DataFrame.unionByName, alone), functools.reduce(DataFrame.unionByName, repeats).distinct()


def groups(repeats: DataFrame) -> DataFrame:
    """key, first_id, copies of each record: counted before the shuffle, so a record that holds a third of all rows costs no more than another."""
    return repeats.groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


def collapsed(rows: DataFrame, id_column: str, *values: str, **how: object) -> DataFrame:
    """first_id, copies: each record once. HOW is passed to split_records."""
    alone, repeats = split_records(rows, id_column, *values, **how)
    return groups(repeats).select("first_id", "copies").unionByName(alone.select(F.col("id").alias("first_id"), F.lit(1).cast("long").alias("copies")))


#: A record with at least this share of all copies is joined by broadcast: there can't be more than its inverse of them.
HOT_SHARE = 1e-3


def copies(rows: DataFrame, id_column: str, *values: str, **how: object) -> DataFrame:
    """first_id, copy_id: a row for each id that repeats the record of a smaller id. HOW is passed to split_records."""
    _, repeats = split_records(rows, id_column, *values, **how)
    repeats = persisted(repeats)
    many = persisted(groups(repeats).where("copies > 1"))
    total = many.agg(F.sum("copies")).first()[0] or 0
    is_hot = F.col("copies") >= max(2, total * HOT_SHARE)
    hot = F.broadcast(many.where(is_hot).select("key", "first_id", F.lit(True).alias("hot")))
    marked = repeats.join(hot, "key", "left")
    of_hot = marked.where("hot").select("first_id", F.col("id").alias("copy_id"))
    rest = marked.where("hot IS NULL").select("id", "key").join(many.where(~is_hot).select("key", "first_id"), "key").select("first_id", F.col("id").alias("copy_id"))
    return of_hot.unionByName(rest).where("first_id <> copy_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "download_twi"), "row_id", "sentence", "text")


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed(table(spark, sf_dir, "download_twi"), "row_id", "sentence", "text")
