"""Scans of folders of text, projects and wiki dumps, and text sinks."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..session import persisted

#: Endings of training files, and folders that a scan leaves out besides those whose names begin with a dot.
TEXT_ENDINGS = ("txt", "md", "py", "rs", "js", "ts", "jsx", "tsx", "c", "h", "cpp", "hpp", "go", "java", "rb", "sh", "bash", "zsh", "toml", "yaml", "yml", "json", "html", "css")
SKIPPED = ("node_modules", "target", "__pycache__", ".venv")
#: Fixed values of the scan of personal projects: endings, folders, file names, and most bytes of a file and of a JSON file.
PROJECT_ENDINGS = ("py", "ts", "tsx", "js", "jsx", "rs", "css", "html", "sh", "toml", "yaml", "yml", "json")
PROJECT_SKIPPED = (
    "node_modules", ".git", "target", "__pycache__", "dist", ".next", "build", ".tox", ".venv", "venv", "vendor", ".cargo", ".mypy_cache", "coverage", ".pytest_cache", ".turbo", ".cache", ".output",
    "backup", "migrations", "static", "public", "assets",
)
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "cargo.lock", ".eslintcache", "tsconfig.tsbuildinfo")
PROJECT_BYTES, JSON_BYTES = 100_000, 10_000
BINARY = "path string, modificationTime timestamp, length long, content binary"
#: Whole files of this size or more are left out of a whole-file scan.
WHOLE_BYTES = 1_000_000


def relative(path: Column, root: str) -> Column:
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, r"^[a-z]+:/{1,3}", "/").substr(F.lit(len(root.rstrip("/")) + 2), F.lit(1 << 20))


def _allowed(path: Column, endings: tuple[str, ...], folders: tuple[str, ...]) -> Column:
    """Whether no folder on the way begins with a dot or is left out, and the ending is listed, in either case."""
    parts = F.split(path, "/")
    on_way = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    skipped = F.exists(on_way, lambda d: F.startswith(d, F.lit(".")) | d.isin(*folders))
    return ~skipped & F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*endings)


def _mounted(spark: SparkSession, root: str) -> bool:
    """Whether a root is a folder of a mounted file system, which tasks walk and read themselves; others are left to Spark's sources."""
    default = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return os.path.isabs(root) and os.path.isdir(root) and default.startswith("file:") and not re.search(r"[\\{}\[\]*?]", root)


def _walked(folder: str, deep: bool = True) -> Iterator[tuple[str, int]]:
    """Path and size of the files under a folder, without those whose names begin with a dot or an underscore, as Spark's sources leave them out."""
    below = [folder]
    while below:
        with os.scandir(below.pop()) as entries:
            for e in entries:
                if e.name.startswith(".") or e.name.startswith("_") and "=" not in e.name or e.name.endswith("._COPYING_"):
                    continue
                if e.is_dir():
                    if deep:
                        below.append(e.path)
                elif e.is_file():
                    yield e.path, e.stat().st_size


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """location, path, size of all files under a folder; content is not read. Of a mounted folder the folders in it are walked by the tasks."""
    if _mounted(spark, root):
        root = root.rstrip("/")
        with os.scandir(root) as entries:
            first = [(e.path, True) for e in entries if e.is_dir() and not e.name.startswith(".") and not (e.name.startswith("_") and "=" not in e.name)]

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for folder, deep in zip(batch["folder"], batch["deep"]):
                    files = _walked(folder, deep)
                    while part := list(islice(files, 10_000)):
                        locations = [x for x, _ in part]
                        yield pd.DataFrame({"location": locations, "path": [x[len(root) + 1 :] for x in locations], "size": [n for _, n in part]})

        starts = spark.createDataFrame([(root, False), *first], "folder string, deep boolean")
        return starts.repartition(max(1, min(len(first) + 1, spark.sparkContext.defaultParallelism))).mapInPandas(walk, "location string, path string, size long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.col("path").alias("location"), relative(F.col("path"), root).alias("path"), F.col("length").alias("size"))


#: Bytes of files that are handed on together.
READ_BYTES = 16 << 20


def _contents(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """path, content of the listed files alone: what a scan leaves out is never opened. Files of a mounted folder are opened by the tasks, many in each, and no list of them is on the driver."""
    if not _mounted(spark, root):
        return _read(spark, "binaryFile", listed, BINARY).select(relative(F.col("path"), root).alias("path"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, held, size = [], [], 0
            for location, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(location, "rb") as f:
                    held.append(f.read())
                paths.append(path)
                size += len(held[-1])
                if size >= READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(held, pa.binary())], names=["path", "content"])
                    paths, held, size = [], [], 0
            if paths:
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(held, pa.binary())], names=["path", "content"])

    return listed.select("location", "path").repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(read, "path string, content binary")


def _read(spark: SparkSession, kind: str, listed: DataFrame, schema: str, **options: str) -> DataFrame:
    """The content of the listed files alone: what a scan leaves out is never opened. The list of files is on the driver, as that of any scan is."""
    paths = [re.sub(r"([\\{}\[\]*?])", r"\\\1", r["location"]) for r in listed.select("location").toLocalIterator()]
    return spark.read.format(kind).options(**options).load(paths) if paths else spark.createDataFrame([], schema)


def text_files(spark: SparkSession, root: str, endings: tuple[str, ...] | None = None, folders: tuple[str, ...] = SKIPPED) -> DataFrame:
    """path, size of the training files under a folder; content is not read."""
    return _listed(spark, root).where(_allowed(F.col("path"), endings or TEXT_ENDINGS, folders)).select("path", "size")


def lines(spark: SparkSession, root: str, endings: tuple[str, ...] | None = None, folders: tuple[str, ...] = SKIPPED) -> DataFrame:
    """path, line: trimmed lines that aren't blank, in the order of the files; lines that are no UTF-8 are left out."""
    wanted = _listed(spark, root).where(_allowed(F.col("path"), endings or TEXT_ENDINGS, folders))
    paths = [re.sub(r"([\\{}\[\]*?])", r"\\\1", r["location"]) for r in wanted.select("location").toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], "path string, line string")
    raw = spark.read.option("lineSep", "\n").text(paths).where(F.is_valid_utf8("value"))
    return raw.select(relative(F.col("_metadata.file_path"), root).alias("path"), trimmed(F.col("value")).alias("line")).where(F.col("line") != "")


def plain_text_files(spark: SparkSession, root: str) -> DataFrame:
    """path, text of the .txt files for evaluation, whose names and endings are taken as written; only folders whose names begin with a dot are left out."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").option("wholetext", "true").text(root)
    named = raw.select(relative(F.col("_metadata.file_path"), root).alias("path"), F.col("value").alias("text"))
    return named.where(~F.exists(F.split("path", "/"), lambda d: F.startswith(d, F.lit("."))))


def whole_files(spark: SparkSession, root: str, endings: tuple[str, ...] | None = None) -> DataFrame:
    """path, text of files under WHOLE_BYTES; larger ones and those that are no UTF-8 are left out."""
    wanted = _listed(spark, root).where((F.col("size") < WHOLE_BYTES) & _allowed(F.col("path"), endings or TEXT_ENDINGS, SKIPPED))
    named = _contents(spark, root, wanted)
    return named.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).where("text IS NOT NULL")


def project_files(spark: SparkSession, root: str) -> DataFrame:
    """project, path, ext, text of the source files of projects, one folder each."""
    named = _listed(spark, root).withColumn("ext", F.regexp_extract("path", r"\.([^./]+)$", 1))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    small = (F.col("size") <= PROJECT_BYTES) & ((F.col("ext") != "json") | (F.col("size") <= JSON_BYTES))
    wanted = named.where(_allowed(F.col("path"), PROJECT_ENDINGS, PROJECT_SKIPPED) & F.col("ext").isin(*PROJECT_ENDINGS) & small & ~name.isin(*LOCK_FILES))
    kept = _contents(spark, root, wanted).withColumn("ext", F.regexp_extract("path", r"\.([^./]+)$", 1))
    return kept.select(F.element_at(F.split("path", "/"), 1).alias("project"), "path", "ext", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def wiki_articles(spark: SparkSession, path: str) -> DataFrame:
    """title, text of the pages of a MediaWiki dump, plain or bz2, by the XML source."""
    schema = "title STRING, revision STRUCT<text: STRING>"
    return spark.read.format("xml").option("rowTag", "page").schema(schema).load(path).select("title", F.col("revision.text").alias("text"))


def table_source(spark: SparkSession, path: str, kind: str = "parquet", columns: list[str] | None = None) -> DataFrame:
    """A downloaded data set in any format Spark reads; only the columns asked for are scanned."""
    df = spark.read.format(kind).load(path)
    return df.select(*columns) if columns else df


def write_lines(rows: DataFrame, line: str, path: str) -> None:
    """A text sink, one line a row; line breaks inside become spaces."""
    rows.select(F.regexp_replace(line, r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(path)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """path, lines, bytes of the text files of a folder."""
    raw = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(root)
    return raw.groupBy(relative(F.col("_metadata.file_path"), root).alias("path")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes"))


def numbered_code(files: DataFrame, language: str, order: list[str], endings: dict[str, str]) -> DataFrame:
    """FILES with a file name, numbered within the language."""
    ending = F.create_map(*[F.lit(x) for p in endings.items() for x in p])[F.col(language)]
    number = F.row_number().over(Window.partitionBy(language).orderBy(*order)) - 1
    return files.withColumn("file_name", F.concat(F.lpad(number.cast("string"), 6, "0"), F.coalesce(ending, F.concat(F.lit("."), F.col(language)))))


def write_numbered(files: DataFrame, language: str, content: str, order: list[str], endings: dict[str, str], root: str) -> DataFrame:
    """language, file_name, bytes of the code files written to ROOT/language/number.ending by the tasks, each under another name first and then put in place, so a task that runs again leaves the same files.

    ROOT is a folder that all executors share. Null contents are not written.
    """
    rows = numbered_code(files.where(F.col(content).isNotNull() & F.col(language).isNotNull()), language, order, endings).select(F.col(language).alias("language"), "file_name", F.col(content).alias("content"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = []
            for folder, name, text in zip(batch["language"], batch["file_name"], batch["content"]):
                os.makedirs(f"{root}/{folder}", exist_ok=True)
                raw = text.encode("utf-8", "surrogatepass")
                beside = f"{root}/{folder}/.{name}.{os.getpid()}"
                with open(beside, "wb") as f:
                    f.write(raw)
                os.replace(beside, f"{root}/{folder}/{name}")
                sizes.append(len(raw))
            yield batch[["language", "file_name"]].assign(bytes=sizes)

    return persisted(rows.mapInPandas(write, "language string, file_name string, bytes long"))
