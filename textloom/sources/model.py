"""Models as folders: counts, vocabulary and merges in Parquet beside a description."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write(path: str, counts: DataFrame, vocab: DataFrame | None = None, merges: DataFrame | None = None, name: str = "model", **more: object) -> None:
    """The model is written beside its place and put there by a rename, so readers see the old one or the new one whole."""
    spark = counts.sparkSession
    fs, final = _files(spark, path)
    _, part = _files(spark, f"{path}.part")
    fs.delete(part, True)
    counts.repartition("ord", "ctx").sortWithinPartitions("ord", "ctx").write.partitionBy("ord").parquet(f"{path}.part/counts")
    for kind, df in (("vocab", vocab), ("merges", merges)):
        if df is not None:
            df.write.parquet(f"{path}.part/{kind}")
    written = spark.read.schema(counts.schema).parquet(f"{path}.part/counts")
    sizes = {str(r["ord"]): [r["a"], r["o"]] for r in written.groupBy("ord").agg(F.count(F.lit(1)).alias("a"), F.sum("cnt").alias("o")).collect()}
    described = {"name": name, "version": 1, "created_at": int(time.time()), "schema": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema), "orders": sorted(map(int, sizes)), "associations": {k: v[0] for k, v in sizes.items()}, "observations": {k: v[1] for k, v in sizes.items()}, **more}
    spark.createDataFrame([(json.dumps(described),)], "value string").coalesce(1).write.text(f"{path}.part/meta")
    fs.delete(final, True)
    if not fs.rename(part, final):
        raise OSError(f"{path} can't be put in place")


def counts(spark: SparkSession, path: str, order: int | None = None) -> DataFrame:
    """The count table; with an ORDER only its folder is read."""
    df = spark.read.schema(meta(spark, path)["schema"]).parquet(f"{path}/counts")
    return df if order is None else df.where(F.col("ord") == order)


def part(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{kind}")


def meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first()[0])


def models(spark: SparkSession, root: str) -> DataFrame:
    """path, name, created_at of all models in a folder, newest first."""
    found = spark.read.option("recursiveFileLookup", "true").text(f"{root}/*/meta")
    at = F.regexp_replace(F.col("_metadata.file_path"), "/meta/[^/]*$", "")
    return found.select(at.alias("path"), F.get_json_object("value", "$.name").alias("name"), F.get_json_object("value", "$.created_at").cast("long").alias("created_at")).orderBy(F.desc("created_at"), "path")
