"""Files by their size: what is too long is set aside before any of its content is read."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tagloom.sources.text import MAX_BYTES

#: Folders that files are dealt to: Spark lists a folder in one task.
FOLDERS = 256
#: Bytes of texts and entries that a task hands on at once.
_HELD = 4 << 20


def write_files(texts: DataFrame, path: str) -> None:
    """Every row of (name, text) as a file of its own, ``path``/folder=n/name-number, ended by a line break as Spark's writer ends it.

    Where the folder is one of the file system, tasks write the files themselves: Spark's writer makes a folder, a checksum and two
    changes of rights for each. Elsewhere Spark writes, in one folder per file.
    """
    spark = texts.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    base = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri().toString()
    number = F.monotonically_increasing_id()
    rows = texts.select((number % FOLDERS).alias("folder"), F.concat_ws("-", F.coalesce(F.col("name").cast("string"), F.lit("none")), number.cast("string")).alias("file"),
                        F.coalesce("text", F.lit("")).alias("text"))
    if urlparse(base).scheme != "file":
        rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("folder", "file").text(path)
        return
    root = unquote(urlparse(base).path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, file, text in zip(*[c.to_pylist() for c in batch.columns]):
                at = os.path.join(root, f"folder={folder}")
                os.makedirs(at, exist_ok=True)
                # under a name that readers pass over until it is whole, so that a task may be run again
                part = os.path.join(at, f".{file}.{os.getpid()}")
                with open(part, "wb") as out:
                    out.write(text.encode() + b"\n")
                os.replace(part, os.path.join(at, f"file={file}"))
        yield pa.RecordBatch.from_pydict({"done": [True]})

    rows.mapInArrow(write, "done boolean").count()


def _short(files: DataFrame, limit: int) -> DataFrame:
    return files.filter(F.col("length") <= limit).drop("modificationTime")


def read_files(spark: SparkSession, path: str, limit: int = MAX_BYTES) -> DataFrame:
    """path, length and content of the files of at most ``limit`` bytes, and the columns of the folder names.

    The limit is a filter on ``length``, which the file source applies to the listing, so longer files are never opened.
    """
    return _short(spark.read.format("binaryFile").load(path), limit)


def judged_files(spark: SparkSession, path: str, limit: int = MAX_BYTES) -> DataFrame:
    """Every file once: path, length, the columns of the folder names, text, and error where there is no text.

    Errors are ``too_long`` or ``invalid_utf8``. The folder is listed once and short files are read once. Empty files are passed over by the file source.
    """
    files = spark.read.format("binaryFile").load(path)
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    read = _short(files, limit).withColumns({"text": F.when(valid, text), "error": F.when(~valid, F.lit("invalid_utf8"))}).drop("content")
    long = files.filter(F.col("length") > limit).drop("modificationTime", "content").withColumns({
        "text": F.lit(None).cast("string"), "error": F.lit("too_long")})
    return read.unionByName(long)


def _hidden(name: str) -> bool:
    """Names that Spark's file source passes over."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name and not name.startswith(("_common_metadata", "_metadata")))


def judged_paths(spark: SparkSession, path: str, limit: int = MAX_BYTES) -> DataFrame:
    """path, length, text and error as in ``judged_files``, for any number of files.

    Where the folder is one of the file system, tasks list its folders and read what is short enough, so that neither the driver nor a
    plan holds an entry per file. Elsewhere Spark's file source lists.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    base = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri().toString()
    if urlparse(base).scheme != "file":
        return judged_files(spark, path, limit).select("path", "length", "text", "error")
    root = unquote(urlparse(base).path)
    if not os.path.isdir(root):
        raise FileNotFoundError(root)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                with os.scandir(root) as entries:
                    for e in entries:
                        if not _hidden(e.name):
                            yield pa.RecordBatch.from_pydict({"at": [e.path]})

    def found(at: str) -> Iterator[str]:
        if os.path.isdir(at):
            with os.scandir(at) as entries:
                for e in entries:
                    if not _hidden(e.name):
                        yield from found(e.path)
        else:
            yield at

    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("text", pa.string()), ("error", pa.string())])

    def judged(file: str) -> tuple:
        length, text, error = os.stat(file).st_size, None, "too_long"
        if length <= limit:
            with open(file, "rb") as content:
                try:
                    text, error = content.read().decode(), None
                except UnicodeDecodeError:
                    error = "invalid_utf8"
        return "file:" + file, length, text, error

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for at in batch.column(0).to_pylist():
                for file in found(at):
                    row = judged(file)
                    if not row[1]:
                        continue
                    rows.append(row)
                    held += 200 + (row[1] if row[2] is not None else 0)
                    if held > _HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    entries = spark.range(0, 1, 1, 1).mapInArrow(top, "at string").repartition(FOLDERS)
    return entries.mapInArrow(read, "path string, length long, text string, error string")


def intake(spark: SparkSession, path: str, limit: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Text files taken in (all columns of ``read_files``, ``text`` for content), and a rejects table (path, length, error).

    Rejects are ``too_long`` or ``invalid_utf8``; every file is in one of the two, but for empty ones, which the file source passes over.
    """
    judged = judged_files(spark, path, limit)
    return judged.filter("error IS NULL").drop("error"), judged.filter("error IS NOT NULL").select("path", "length", "error")
