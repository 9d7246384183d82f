"""Lines of text: from files, from string columns, from streams.

A line ends at a line feed; one carriage return before it is not part of it; a last line without a
line feed counts, and nothing follows a final line feed. Bare carriage returns stay in the line.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def split_lines(text: Column) -> Column:
    """The lines of a text as an array; null for null, empty for an empty text."""
    parts = F.split(text, "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.when(x.endswith("\r"), F.substring(x, F.lit(1), F.char_length(x) - 1)).otherwise(x))


def lines_of(df: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """A row for each line of a string column: keys, line_no (from 1), line."""
    return df.select(*keys, F.posexplode(split_lines(F.col(text))).alias("at", "line")).select(*keys, (F.col("at") + 1).cast("long").alias("line_no"), "line")


def plain_path(column: Column) -> Column:
    """A file's path as users write it: names are not percent-encoded, and local ones have no scheme."""
    decoded = F.url_decode(F.replace(column, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "/")


def _plain(path: str) -> str:
    """plain_path for what Hadoop's Path gives, which is not encoded."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:/") else path


def list_files(spark: SparkSession, paths: list[str] | str, recursive: bool = False) -> tuple[list[tuple[str, int]], list[str], list[str]]:
    """(path, bytes) of each file in the order of paths, children of a directory by name; the paths that
    can be read; and a message for each that is skipped: one that does not exist, or a directory without
    recursive. The listing is that of Hadoop, on the driver. Names that start with _ or . are hidden from
    Hadoop's readers: in directories they are passed over, and named ones are skipped with a message."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: list[tuple[str, int]] = []
    usable, messages = [], []

    def take(status) -> None:
        found.append((_plain(status.getPath().toString()), int(status.getLen())))

    def walk(fs, path) -> None:
        for s in sorted(fs.listStatus(path), key=lambda s: s.getPath().toString()):
            if s.getPath().getName()[:1] in "_.":
                continue
            walk(fs, s.getPath()) if s.isDirectory() else take(s)

    for p in [paths] if isinstance(paths, str) else paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            messages.append(f"{p}: No such file or directory")
            continue
        status = fs.getFileStatus(path)
        if not status.isDirectory() and path.getName()[:1] in "_.":
            messages.append(f"{p}: Is hidden")
            continue
        if status.isDirectory() and not recursive:
            messages.append(f"{p}: Is a directory")
            continue
        usable.append(p)
        walk(fs, path) if status.isDirectory() else take(status)
    return found, usable, messages


def files(spark: SparkSession, paths: list[str] | str, recursive: bool = False) -> DataFrame:
    """path and bytes of each file, empty ones too. A path that does not exist, or a directory without
    recursive, is an error of the plan."""
    found, _, messages = list_files(spark, paths, recursive)
    for m in messages:
        raise (IsADirectoryError if m.endswith("Is a directory") else FileNotFoundError)(m)
    return spark.createDataFrame(found, "path string, bytes long")


def _escaped(paths: list[str] | str) -> list[str]:
    """Spark takes paths for globs; a file's own name is none."""
    return [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in ([paths] if isinstance(paths, str) else paths)]


def read_lines(spark: SparkSession, paths: list[str] | str, recursive: bool = False, numbered: bool = False, after_bad: bool = True) -> DataFrame:
    """Lines of text files: path, line; with numbered, line_no too.

    Without numbers, files are split over tasks wherever they are long. Numbers need the order within a
    file, so then each file is read whole by one task. Lines that are not valid UTF-8 have U+FFFD for
    their bad bytes; without after_bad, a file ends before its first such line."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    path = plain_path(F.col("_metadata.file_path")).alias("path")
    if numbered:
        raw = F.col("value")
        text = raw if after_bad else F.when(F.is_valid_utf8(raw), raw).otherwise(_good_lines(F.when(~F.is_valid_utf8(raw), raw.cast("binary"))))
        return lines_of(reader.text(_escaped(paths), wholetext=True).select(path, text.alias("text")), "text", "path")
    rows = reader.text(_escaped(paths), lineSep="\n").select(path, "value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("turn"))
    if not after_bad:
        # both scans of a file are cut alike, so a line has the same place in both; a row for each bad file
        bad = rows.where(~F.is_valid_utf8("value")).groupBy("path").agg(F.min(F.struct("block", "turn")).alias("stop"))
        rows = rows.join(bad, "path", "left").where(F.col("stop").isNull() | (F.struct("block", "turn") < F.col("stop")))
    return rows.select("path", F.regexp_replace("value", r"\r\z", "").alias("line"))


@F.arrow_udf(T.StringType())
def _good_lines(raw: pa.Array) -> pa.Array:
    """The lines of a file before the first that is not valid UTF-8."""

    def cut(b: bytes | None) -> str | None:
        if b is None:
            return None
        try:
            return b.decode()
        except UnicodeDecodeError as e:
            return b[: b.rfind(b"\n", 0, e.start) + 1].decode()

    return pa.array([cut(b) for b in raw.to_pylist()], pa.string())


def invalid_files(spark: SparkSession, paths: list[str] | str, recursive: bool = False) -> DataFrame:
    """Paths of files that have a line that is not valid UTF-8, in one pass over the lines."""
    rows = spark.read.option("recursiveFileLookup", recursive).text(_escaped(paths), lineSep="\n")
    return rows.select(plain_path(F.col("_metadata.file_path")).alias("path"), "value").where(~F.is_valid_utf8("value")).select("path").distinct()


def scratch_dir(spark: SparkSession) -> str:
    """A folder that all executors share, from spark.checkpoint.dir; only where it is unset and executors are
    threads of this machine, a temporary one, deleted at the end."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: a folder is needed that all executors share")
        where = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, where, True)
        spark.sparkContext.setCheckpointDir(where)
    return str(where).rstrip("/")


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files as they arrive in a directory, as a streaming DataFrame: path, line."""
    rows = spark.readStream.option("lineSep", "\n").text(path)
    return rows.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.regexp_replace("value", r"\r\z", "").alias("line"))
