"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes (the
# size check behind every broadcast of a derived table) and splits skewed
# join partitions; the broadcast threshold bounds what AQE may replicate.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(16 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "wordloom", extra: dict | None = None) -> SparkSession:
    """Local or cluster session with the defaults above.

    On a cluster, ``master`` stays None so spark-submit decides; locally the
    caller passes ``local[N]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", "12g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster names a shared, fault-tolerant folder there; this is read from
    the session. Only a local session without one (tests, the bench) gets a
    fresh folder under the system temporary directory. On a cluster with the
    setting missing we refuse rather than write to a machine-local folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(d)
        return d
    cp = spark.sparkContext.getCheckpointDir()
    if cp:
        return cp
    master = spark.sparkContext.master or ""
    if not master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; configure a shared folder "
            "(for example on HDFS or object storage) for iterative jobs")
    d = tempfile.mkdtemp(prefix="wordloom-ckpt-")
    spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for a written table."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the checkpoint folder and read back: computed once,
    cuts the lineage, survives a lost executor, and gives Catalyst real sizes."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(df: DataFrame) -> None:
    """Deletes the files of a table made by :func:`written`."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """``df`` written like :func:`written`, as a table bucketed by ``key``, a
    file a bucket: what groups or joins by the key reads it without an exchange."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).option(
        "path", scratch_path(spark, name)).saveAsTable(table)
    out = spark.table(table)
    out._wordloom_table = table
    return out


def drop_bucketed(df: DataFrame) -> None:
    """Deletes a table made by :func:`bucketed`, with its files."""
    remove_written(df)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._wordloom_table}")


BATCH_BYTES = 8 << 20       # in an Arrow batch; a longer row alone
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def release() -> None:
    """Gives what Arrow and the C library hold unused back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)    # glibc
    if trim is not None:
        trim(0)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once a session.

    Functions run in Python tasks are pickled by module name, so workers must
    be able to import the package wherever the driver was started. Arrow batches
    hold up to ``BATCH_BYTES`` instead of Spark's 64 MB, unless the session says
    otherwise: the JVM, Arrow and the worker hold a batch several times over.
    """
    if spark.conf.get(_BATCH_CONF) == f"{64 << 20}b":
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_wordloom_shipped", False):
        return
    import zipfile
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="wordloom-"), "wordloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    sc._wordloom_shipped = True
