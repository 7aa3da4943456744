"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.session import shared_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession, rows: int = 2000, size: int = 16 << 20) -> None:
    """Keep the Arrow batches of Python tasks small, so that long texts don't add up in memory."""
    spark.conf.set(_BATCH_ROWS, str(rows))
    with contextlib.suppress(Exception):
        spark.conf.set(_BATCH_BYTES, str(size))


@contextlib.contextmanager
def bounded_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of *rows* rows for the Python tasks that run within."""
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


class Scratch:
    """The intermediate tables of one call in the shared folder.

    A written table cuts the lineage, and a lost executor costs nothing.  Tables that
    are read no more are dropped by name, so that the folder holds what is in use.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, list[str]] = {}

    def write(self, df: DataFrame, name: str, compression: str = "snappy", row_group: int | None = None, rows: int | None = None) -> DataFrame:
        """Write *df* and read it back.  Shuffle files of the write are dropped when it ends, where the session lets them be.

        *row_group*: bytes of a Parquet row group, for tables whose rows are exploded when they are read.
        *rows*: rows of a row group, for rows of megabytes; Spark holds whole row groups, and looks at their bytes every hundred rows only.
        """
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        before = self.spark.conf.get(_CLEANUP, None)
        with contextlib.suppress(Exception):
            self.spark.conf.set(_CLEANUP, "true")
        try:
            writer = df.write.option("compression", compression)
            for key, most in (("parquet.block.size", row_group), ("parquet.block.row.count.limit", rows)):
                writer = writer.option(key, str(most)) if most else writer
            writer.parquet(path)
        finally:
            with contextlib.suppress(Exception):
                self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        self.tables.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove all tables written under *names*; nothing that is still to be computed may read them."""
        for path in [p for name in names for p in self.tables.pop(name, [])]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def replace(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write *df* and drop the tables that were written under the same name before."""
        before = self.tables.pop(name, [])
        out = self.write(df, name, **options)
        now = self.tables.pop(name)
        self.tables[name] = before
        self.drop(name)
        self.tables[name] = now
        return out

    def finish(self, df: DataFrame, name: str) -> DataFrame:
        """Write the result and drop every other table."""
        out = self.write(df, f"{name}-result")
        self.drop(*(n for n in list(self.tables) if n != f"{name}-result"))
        return out


def binary_list(column: pa.Array) -> list:
    """A string or binary Arrow column as ``bytes`` (None for null)."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


@contextlib.contextmanager
def smaller_splits(spark: SparkSession, factor: int) -> Iterator[None]:
    """Read files in splits of a *factor*-th of the session's size, for scans whose rows are exploded that much."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    digits = before.lower().rstrip("bkmg")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(before.lower()[len(digits) : len(digits) + 1], 1)
    spark.conf.set(key, str(max(1 << 20, int(digits) * unit // factor)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


_BLOOM = "spark.sql.optimizer.runtime.bloomFilter."


@contextlib.contextmanager
def bloom_joins(spark: SparkSession, keys: int, most_bits: int = 1 << 28) -> Iterator[None]:
    """Let joins with a filtered scan of *keys* keys drop rows without a partner before they are shuffled.

    Spark builds the Bloom filter of the keys and ships it: 12 bits a key, but no more than *most_bits*, whatever the
    number of keys.  A fuller filter lets more rows through to the join and never loses one.
    """
    bits = max(1 << 16, min(12 * keys, most_bits))
    wanted = {
        "enabled": "true",
        "applicationSideScanSizeThreshold": "1m",
        "creationSideThreshold": str(1 << 60),
        "expectedNumItems": str(max(1, keys)),
        "maxNumItems": str(max(1, keys)),
        "numBits": str(bits),
        "maxNumBits": str(bits),
    }
    before = {key: spark.conf.get(_BLOOM + key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(_BLOOM + key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(_BLOOM + key) if value is None else spark.conf.set(_BLOOM + key, value)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that hands the memory it freed back to the system when its partition ends.

    Python workers outlive their tasks, and several wait in an executor at a time.
    """

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def text_bytes(column: pa.Array) -> list[bytes]:
    """As :func:`binary_list`, null texts as empty ones."""
    return [x or b"" for x in binary_list(column)]


def free_name(df: DataFrame, name: str) -> str:
    """*name*, lengthened until *df* has no such column in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_fold(id_column: str, folds: int):
    """crc32 of the id as text, modulo *folds* (null ids fall in fold 0)."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % F.lit(folds), F.lit(0)).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
