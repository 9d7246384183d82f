"""What the operators share: tables, sizes, shared folders and Arrow helpers."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of a DataFrame; for a scan, the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


UNKNOWN = 1 << 50


def parts(df: DataFrame, mb: float, least: int = 8, text: str = "text") -> int:
    """How many parts of about mb MB a DataFrame makes. Where Catalyst has no estimate, as for local
    rows and for some joins, the bytes of its texts are summed, in one pass, and halved as if stored."""
    size = size_bytes(df)
    if size >= UNKNOWN:
        size = (df.agg(F.sum(F.octet_length(text))).first()[0] or 0) // 2
    return max(least, math.ceil(size / (mb * 1e6)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Only where it is unset and the
    executors are threads of this machine, one of our own, deleted at the end; else that is an error."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: a folder is needed that all executors share")
        where = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, where, True)
        spark.sparkContext.setCheckpointDir(where)
    return str(where).rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage is cut, lost executors cost nothing done.
    The table stays until discard() or, at the latest, until the driver ends."""
    bounded_batches(df)
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_discard_all)
    _made[path] = df.sparkSession
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._made_at = path
    return out


#: Tables that materialize() has made and nobody has discarded.
_made: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() has made; nothing that is still to be computed may read them."""
    for df in tables:
        path = vars(df).get("_made_at")
        if path in _made:
            _delete(_made.pop(path), path)


def made_tables() -> set[str]:
    """The tables that exist now, for discard_since()."""
    return set(_made)


def discard_since(before: set[str], *keep: DataFrame) -> None:
    """Delete all tables that materialize() has made since, but those to keep."""
    kept = {vars(df).get("_made_at") for df in keep}
    for path in [p for p in _made if p not in before and p not in kept]:
        _delete(_made.pop(path), path)


def _discard_all() -> None:
    from pyspark import SparkContext

    for path, spark in _made.items():
        if SparkContext._active_spark_context is None or spark.sparkContext._jsc is None:
            return
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already, at the end of the driver
            return


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


BATCH_ROWS = 2000


def bounded_batches(df: DataFrame) -> DataFrame:
    """Let Arrow batches of the session hold BATCH_ROWS rows at most, as rows here are whole texts. Plans read
    this setting when they run, after an operator has returned them, so it stays; README says so."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def trim() -> None:
    """Give memory that a task has used back to the system: workers are used again, and what an idle one
    holds counts towards its executor's limit. This changes no result."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def trimmed(function):
    """A function over whole groups or over batches that trims when it is done."""
    import inspect

    def one(t):
        try:
            return function(t)
        finally:
            trim()

    def two(a, b):
        try:
            return function(a, b)
        finally:
            trim()

    def stream(batches):
        yield from function(batches)
        trim()

    return stream if inspect.isgeneratorfunction(function) else two if len(inspect.signature(function).parameters) == 2 else one


def pieces(batches, column: str = "text", mb: float = 4.0):
    """The same rows in batches of about mb MB of a string column; a longer row is a batch of its own."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < b.num_rows:
            before = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, before + mb * 1e6, side="right")))
            yield b.slice(first, last - first)
            first = last


def without_ids(docs: DataFrame, ids: DataFrame, most: int = 200_000) -> DataFrame:
    """Rows of docs whose doc_id is not among ids (doc_id; rows with a null doc_id stay). Broadcasts ids
    only if they are few; beyond that both sides are dealt by doc_id."""
    ids = materialize(ids.select("doc_id").where("doc_id IS NOT NULL").distinct(), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= most else ids, "doc_id", "left_anti").select(*docs.columns)


def with_shard(docs: DataFrame, n: int, *more) -> DataFrame:
    """doc_id, text and the shard that a document is dealt to."""
    return bounded_batches(docs).select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("shard"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)
