"""Count-Min sketches as rows (row, bucket, cnt)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The default width and depth; a cell takes four bytes.
WIDTH, DEPTH, CELL = 1 << 20, 4, 4


def bucket(key: Column, row: Column, width: int) -> Column:
    """The cell of a key in a row of the sketch: the first 32 bits of a digest, portable to any SQL engine."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(":"), row.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(width))


def build(rows: DataFrame, key: Column, amount: Column | None = None, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """row, bucket, cnt. Equal keys are added up before they are hashed, so the shuffle carries each key of a task once."""
    keyed = rows.select(key.alias("key"), (amount if amount is not None else F.lit(1)).cast("long").alias("amount")).where("key IS NOT NULL")
    summed = keyed.groupBy("key").agg(F.sum("amount").alias("amount"))
    cells = summed.select("amount", "key", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("row"))
    return cells.groupBy("row", bucket(F.col("key"), F.col("row"), width).alias("bucket")).agg(F.sum("amount").alias("cnt"))


def estimate(sketch: DataFrame, keys: DataFrame, key: Column, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """key, estimate: the least of the key's cells, 0 where one is empty. A sketch has WIDTH x DEPTH rows at most."""
    asked = keys.select(key.alias("key")).where("key IS NOT NULL").distinct().select("key", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("row"))
    cells = asked.withColumn("bucket", bucket(F.col("key"), F.col("row"), width))
    return cells.join(sketch, ["row", "bucket"], "left").groupBy("key").agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))


def decayed(sketch: DataFrame, factor: float) -> DataFrame:
    """Cells times FACTOR, rounded down."""
    return sketch.select("row", "bucket", F.floor(F.col("cnt") * F.lit(factor)).cast("long").alias("cnt"))


def cleared(sketch: DataFrame) -> DataFrame:
    return sketch.limit(0)


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("row", "bucket").agg(F.sum("cnt").alias("cnt"))


def memory_bytes(width: int = WIDTH, depth: int = DEPTH) -> int:
    return width * depth * CELL
