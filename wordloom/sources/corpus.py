"""Corpus sources and sinks.

A corpus is any DataFrame with an id column and a text column; the names are
parameters, as the reference takes the id and content field names as job
parameters. Readers only select the two columns so the parquet scan prunes
the rest.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.session import ship_package

FILE_CHUNKS = 100_000   # Fixed value: chunks of one text file in the reference program.


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet", id_col: str = "doc_id",
                text_col: str = "text", options: dict | None = None) -> DataFrame:
    """Scan a document collection and project ``(doc_id, text)``.

    ``fmt`` is any Spark data source: parquet/orc/json/csv, ``text`` (one
    document per line, see :func:`read_lines`), or an external connector such
    as ``mongodb`` whose package is on the classpath.
    Missing text becomes the empty string; the document still counts.
    """
    if fmt == "text":
        return read_lines(spark, path, options)
    reader = spark.read.format(fmt)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    df = reader.load(path)
    return df.select(F.col(id_col).alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def read_lines(spark: SparkSession, path: str, options: dict | None = None) -> DataFrame:
    """Each line of text files as a document; ``doc_id`` is ``file:line``,
    lines numbered from 0, the same however the files are split for reading.

    Rows of one block of a file are numbered by their place in the scan; what
    is added is the number of lines in earlier blocks of the file, a window
    over one row per block.
    """
    lines = spark.read.options(**(options or {})).text(path).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    based = blocks.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(based, ["file", "block"]).select(
        F.concat_ws(":", "file", F.col("place") + F.col("shift")).alias("doc_id"), "text")


def unique_ids(corpus: DataFrame, id_col: str = "doc_id") -> int:
    """Number of documents; raises if any id is null or repeated.

    The check is one partially aggregated count per id: a hot id is combined
    map-side before the shuffle. Runs eagerly over the id column alone.
    """
    got = (corpus.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
           .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                F.count(F.when(F.col(id_col).isNull() | (F.col("n") > 1), F.lit(1))).alias("bad"),
                F.sum(F.when(F.col(id_col).isNull() | (F.col("n") > 1), F.col("n"))).alias("bad_rows"))
           .collect()[0])
    if got["bad"]:
        raise ValueError(f"document ids must be unique and not null: {got['bad']} ids "
                         f"cover {got['bad_rows']} rows")
    return int(got["rows"])


def check_unique_ids(corpus: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Raise if any id is null or repeated; returns the corpus unchanged."""
    unique_ids(corpus, id_col)
    return corpus


def parse_json_corpus(df: DataFrame, json_col: str, id_field: str, text_field: str,
                      keep: list[str] | None = None) -> DataFrame:
    """Project the id and content fields of JSON records, field names as parameters.

    Both fields are read under a string schema, so a number becomes its text.
    A missing content field is the empty string. Malformed records are not
    dropped: ``corrupt`` holds the raw record and the fields are null.
    """
    schema = T.StructType([
        T.StructField(id_field, T.StringType()),
        T.StructField(text_field, T.StringType()),
        T.StructField("_corrupt_record", T.StringType()),
    ])
    parsed = F.from_json(F.col(json_col), schema,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    keep = keep or []
    return (df.select(*keep, parsed.alias("_j"))
            .select(*keep,
                    F.col("_j").getField(id_field).alias("doc_id"),
                    F.coalesce(F.col("_j").getField(text_field), F.lit("")).alias("text"),
                    F.col("_j").getField("_corrupt_record").alias("corrupt")))


def chunk_documents(corpus: DataFrame, size: int, drop_tail: bool = False,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut each text into consecutive pieces of ``size`` characters.

    Output ``(doc_id, chunk, text)`` with ``chunk`` numbering pieces from 0.
    Counted in characters, so no code point is split. The last, shorter
    piece is kept unless ``drop_tail``. Empty text gives no chunk. Narrow:
    each row is cut where it is, no shuffle.
    """
    if size <= 0:
        raise ValueError("chunk size must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # One left-to-right regex pass; '.' matches a whole code point.
    pattern = f"((?s).{{{size}}})" if drop_tail else f"((?s).{{1,{size}}})"
    pieces = F.regexp_extract_all(text, F.lit(pattern), 1)
    return (corpus.select(F.col(id_col).alias("doc_id"), F.posexplode(pieces).alias("chunk", "text"))
            .select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), "text"))


def file_size(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen())


def read_file_chunks(spark: SparkSession, path: str, chunks: int = FILE_CHUNKS) -> DataFrame:
    """One large text file as ``chunks`` documents of equal length in bytes:
    ``(doc_id, text)``, ``doc_id`` the chunk number (a shorter file gives one
    chunk per byte at most, an empty file none).

    Chunks are byte ranges read by the tasks that need them, so one file is
    read in parallel and never passes through one task. A code point that
    spans a boundary goes whole to the chunk in which it begins; other bytes
    that are no UTF-8 become U+FFFD. Line ends are ordinary characters, so
    windows cross lines. ``path`` is any URI known to Arrow (file, hdfs, s3).
    """
    ship_package(spark)
    size = file_size(spark, path)
    n = min(chunks, size)
    spans = spark.range(n, numPartitions=max(1, min(n, spark.sparkContext.defaultParallelism * 4)))

    def run(batches):
        fs, name = file_system(path)
        with fs.open_input_file(name) as f:
            for b in batches:
                ids = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([_chunk_text(f, i * size // n, (i + 1) * size // n, size) for i in ids], pa.string())],
                    ["doc_id", "text"])
    return spans.mapInArrow(run, "doc_id bigint, text string")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a URI or plain local path, and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def _chunk_text(f, start: int, end: int, size: int) -> str:
    """Bytes ``start`` to ``end`` as text, whole code points by their first byte."""
    f.seek(start)
    data = f.read(min(end + 3, size) - start)
    def begins(at: int) -> int:
        """The first position from ``at`` that does not continue a code point."""
        k = at
        while k < len(data) and k < at + 3 and data[k] & 0xC0 == 0x80:
            k += 1
        return k
    first = begins(0) if start else 0
    last = begins(end - start) if end < size else len(data)
    return data[first:max(first, last)].decode("utf-8", "replace")


def write_text_files(corpus: DataFrame, path: str, group: str) -> None:
    """Documents ``(doc_id, text)`` as text files, one for each value of the
    column ``group`` in a folder named after it, a line end after each text,
    by document id. A group is one task's: choose groups of a bounded size."""
    lines = corpus.repartition(group).sortWithinPartitions(group, "doc_id")
    lines.select(group, "text").write.partitionBy(group).text(path)


def chunk_source() -> type:
    """The data source ``chunked_text``: text files below a folder, or one
    file, cut into pieces of ``chunkBytes`` bytes.

    ``spark.dataSource.register(chunk_source())``, then
    ``spark.read.format("chunked_text").option("chunkBytes", n).load(path)``
    gives ``(file, chunk, text)``, ``file`` relative to the path. A partition
    is a range of about ``partitionBytes`` (64 MB) of one file, read by the
    task that needs it, so a large file is read in parallel. A code point that
    spans a cut goes whole to the chunk in which it begins; other bytes that
    are no UTF-8 become U+FFFD. ``path`` is any URI known to Arrow.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Span(InputPartition):
        def __init__(self, file: str, name: str, size: int, first: int, last: int):
            self.file, self.name, self.size, self.first, self.last = file, name, size, first, last

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.path = options["path"]
            self.step = int(options.get("chunkbytes", 1 << 20))
            self.run = max(1, int(options.get("partitionbytes", 64 << 20)) // self.step)
            if self.step <= 0:
                raise ValueError("chunkBytes must be positive")

        def open(self):
            import pyarrow.fs
            if self.path.startswith("file:") or "://" not in self.path:
                return pyarrow.fs.LocalFileSystem(), "/" + self.path.removeprefix("file:").lstrip("/")
            return pyarrow.fs.FileSystem.from_uri(self.path)

        def partitions(self):
            import pyarrow.fs
            fs, top = self.open()
            found = fs.get_file_info(top)
            if found.type == pyarrow.fs.FileType.File:
                files = [found]
            else:
                files = [f for f in fs.get_file_info(pyarrow.fs.FileSelector(top, recursive=True)) if f.is_file]
            hidden = [f for f in files if any(x[:1] in "._" for x in f.path[len(top):].split("/") if x)]
            out = []
            for f in sorted((f for f in files if f not in hidden and f.size), key=lambda f: f.path):
                n = -(-f.size // self.step)
                name = f.path[len(top):].lstrip("/") or f.base_name
                out += [Span(f.path, name, f.size, at, min(n, at + self.run)) for at in range(0, n, self.run)]
            return out or [Span("", "", 0, 0, 0)]

        def read(self, partition):
            if not partition.size:
                return
            fs, _ = self.open()
            with fs.open_input_file(partition.file) as f:
                for i in range(partition.first, partition.last):
                    start, end = i * self.step, min((i + 1) * self.step, partition.size)
                    f.seek(start)
                    data = f.read(min(end + 3, partition.size) - start)

                    def begins(at):
                        k = at
                        while k < len(data) and k < at + 3 and data[k] & 0xC0 == 0x80:
                            k += 1
                        return k
                    first = begins(0) if start else 0
                    last = begins(end - start) if end < partition.size else len(data)
                    yield partition.name, i, data[first:max(first, last)].decode("utf-8", "replace")

    class ChunkedText(DataSource):
        @classmethod
        def name(cls):
            return "chunked_text"

        def schema(self):
            return "file string, chunk bigint, text string"

        def reader(self, schema):
            return Reader(self.options)
    return ChunkedText


def write_result(df: DataFrame, path: str, cluster_by: str | list[str] | None = None,
                 partition_by: list[str] | None = None, mode: str = "overwrite",
                 num_partitions: int | None = None) -> None:
    """Write a result table as parquet.

    ``cluster_by`` range-partitions and sorts rows on those columns so each
    file holds a key range: readers filtering on it skip files by their
    min/max statistics. For postings and TF-IDF give ``["term", "doc_id"]``:
    the second column lets a stop word's rows be split over files. No
    coalesce to one file.
    """
    out = df
    if cluster_by:
        keys = [cluster_by] if isinstance(cluster_by, str) else list(cluster_by)
        out = (out.repartitionByRange(num_partitions, *keys) if num_partitions
               else out.repartitionByRange(*keys))
        out = out.sortWithinPartitions(*keys)
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
