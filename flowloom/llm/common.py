"""What the operators of this subpackage share: tables, the shared folder, batches."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch handed to Python: bound a worker's memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the session's ``spark.checkpoint.dir``; only in a local session without
    one a temporary folder takes its place, and a cluster without one is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="flowloom-shared-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/flowloom/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read back.

    Cuts the lineage: what follows reads files that outlive lost executors.
    """
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a table in the shared folder that nothing reads again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trimmed(run):
    """``run`` over batches; what its task has freed goes back to the system when it ends.

    Workers are kept for later tasks, and would keep that memory beside the next one's.
    """

    def wrapped(batches):
        _lean()
        yield from run(batches)
        _trim()

    return wrapped


def tidy(run):
    """``run`` over one group, likewise; groups of some size give back what they freed."""

    def wrapped(group):
        _lean()
        out = run(group)
        _trim(group.nbytes)
        return out

    return wrapped


def tidy_both(run):
    """``run`` over two groups of a key, likewise."""

    def wrapped(left, right):
        _lean()
        out = run(left, right)
        _trim(left.nbytes + right.nbytes)
        return out

    return wrapped


#: Bytes of a group from which a worker gives memory back at once; and of an allocation that is mapped on its own.
TRIM_BYTES, MAP_BYTES = 1 << 20, 2 << 20
_leaned: list[bool] = []


def _lean() -> None:
    """Large arrays are mapped on their own in this worker, so that they go back when they are freed."""
    import ctypes

    if not _leaned:
        _leaned.append(True)
        try:
            ctypes.CDLL("libc.so.6").mallopt(-3, MAP_BYTES)  # M_MMAP_THRESHOLD
        except (OSError, AttributeError):  # another C library
            pass


def _trim(size: int = TRIM_BYTES) -> None:
    import ctypes
    import gc

    import pyarrow as pa

    if size < TRIM_BYTES:
        return
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mapped(df: DataFrame, run, *fields: tuple[str, str]) -> DataFrame:
    """``df`` through ``run`` in Arrow batches, which puts ``fields`` (name, type) behind all other columns.

    Columns may have any names; ``run`` sees odd ones under others.
    """
    from pyspark.sql.types import StructField, StructType

    new = [n for n, _ in fields]
    plain = df.toDF(*(c if re.fullmatch(r"\w+", c) else fresh(f"__column_{i}", df) for i, c in enumerate(df.columns)))
    kept = [(f, c) for f, c in zip(plain.schema.fields, df.columns, strict=True) if c not in new]
    schema = StructType([*(StructField(f.name, f.dataType, True) for f, _ in kept), *(StructField(n, StructType.fromDDL(f"x {t}")[0].dataType, True) for n, t in fields)])
    return plain.mapInArrow(trimmed(run), schema).toDF(*(c for _, c in kept), *new)


def fresh(name: str, *tables: DataFrame) -> str:
    """``name``, or if a column of the tables is called so (in any case), one like it that none is."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fresh_prefix(prefix: str, df: DataFrame) -> str:
    """``prefix``, or one like it that no column's name begins with (in any case)."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix += "_"
    return prefix


def columns(df: DataFrame) -> list:
    """All columns by name, whatever characters are in them."""
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def looked_up(rows: DataFrame, keys: DataFrame, on: str, salts: int, how: str = "left", by: list[str] | None = None) -> DataFrame:
    """``rows`` joined with the one row that ``keys`` has for each ``on``.

    ``keys`` is repeated ``salts`` times, so a key that a third of the rows share
    is spread over that many tasks; equal rows differ by their input partition.
    ``by`` names the columns that the rows differ in, where some are large.
    """
    name = fresh("__salt", rows, keys)
    salt = F.pmod(F.xxhash64(*(columns(rows) if by is None else [F.col(quoted(c)) for c in by]), F.spark_partition_id()), F.lit(salts)).cast("int")
    spread = keys.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # Not broadcast: the size that Spark knows is that of ``keys`` without copies.
    return rows.withColumn(name, salt).join(spread.hint("merge"), [on, name], how).drop(name)


#: Most bytes that are broadcast, by the measured sum over the rows.
BROADCAST_BYTES = 16 << 20


def small_enough(df: DataFrame, row_bytes) -> bool:
    """Whether ``df``, at ``row_bytes`` (a number or a column) a row, is within the bound of what is broadcast."""
    size = df.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def buckets(spark: SparkSession) -> int:
    """Buckets to deal keys into; follows the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
