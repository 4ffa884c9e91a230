"""Session defaults, table access and checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Compressed bytes of a table up to which spread() moves rows: small tables whose few files would leave cores idle. Larger ones have splits of their own.
SPREAD_BYTES = 256 << 20
_written: list[str] = []


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("textloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table NAME of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir; only where it is unset, as in local tests, a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="textloom-checkpoint-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(shared)


def persisted(df: DataFrame) -> DataFrame:
    """DF written to the shared checkpoint folder: read many times, computed once, and safe when executors are lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder, as a plain path where that is a mounted one; remove_written() deletes it."""
    path = shared_path(spark, f"scratch-{uuid.uuid4()}")
    _written.append(path)
    return re.sub("^file:/+", "/", path)


def written(df: DataFrame, *partition_by: str, **options: object) -> DataFrame:
    """DF as a Parquet table in the shared checkpoint folder: like persisted(), but later reads take only the columns and partitions they need. OPTIONS are those of the Parquet writer. remove_written() deletes such tables."""
    spark = df.sparkSession
    path = shared_path(spark, f"table-{uuid.uuid4()}")
    _written.append(path)
    df.write.options(**options).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}"


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def store_bytes(spark: SparkSession, path: str, raw: bytes, part: int = 4 << 20) -> None:
    """RAW as one file, put in place by a rename, so that no reader sees half of it; a file that is there already stays."""
    fs, beside = _file_system(spark, f"{path}.{uuid.uuid4()}")
    stream = fs.create(beside)
    for at in range(0, len(raw), part):
        stream.write(bytearray(raw[at : at + part]))
    stream.close()
    if not fs.rename(beside, _file_system(spark, path)[1]):
        fs.delete(beside, False)


def stored_bytes(spark: SparkSession, path: str) -> bytes | None:
    """The content of a file; None where there is none."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    raw = bytes(stream.readAllBytes())
    stream.close()
    return raw


def remove_written(spark: SparkSession) -> None:
    """Delete the tables that written() made in this session, once the results that read them are stored. Checkpoints are deleted by Spark itself where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    while _written:
        fs, at = _file_system(spark, _written.pop())
        fs.delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """DF over at least as many partitions as there are cores, where a small table comes in fewer files than that. A table over SPREAD_BYTES is never moved, however many cores there are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(cores)
