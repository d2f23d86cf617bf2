"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.session import scratch_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and
    not recomputed from its sources when an executor is lost."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table made by :func:`written`."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


Batches = Iterator[pa.RecordBatch]


def hash_share(hashed: Column) -> Column:
    """A 64-bit hash as a number in [0, 1). Keeping the rows below ``n / total``
    leaves about ``n`` of them, so that what is then ranked in one task is
    bounded by the sample and not by the group."""
    return F.pmod(hashed, F.lit(1 << 32)) / F.lit(float(1 << 32))


BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def release() -> None:
    """Gives what Arrow and the C library hold unused back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)    # glibc
    if trim is not None:
        trim(0)


def in_arrow(df: DataFrame, fn: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``mapInArrow`` with this package sent to the workers. Batches hold up to
    :data:`BATCH_BYTES` (a longer row alone) instead of Spark's 64 MB, unless
    the session says otherwise: a batch of texts is held several times over by
    the JVM, by Arrow and by the worker."""
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get(_BATCH_CONF) == f"{64 << 20}b":
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))

    def run(batches: Batches) -> Batches:
        for out in fn(batches):
            yield out
            release()    # else a worker keeps its largest batches

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` on every Arrow batch that has rows."""
    def run(batches: Batches) -> Batches:
        for b in batches:
            if b.num_rows:
                yield fn(b)
    return in_arrow(df, run, schema)
