"""Shared pieces: the shared folder, written intermediate tables, words and row keys."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Words are maximal runs of anything but these six ASCII characters.
WORD = re.compile("[^\x20\x09-\x0d]+")
#: The same class for Spark's regular expressions.
WORD_JAVA = r"[^\x20\x09-\x0D]+"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where unset (tests, one machine), a temporary one."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="plumbline-")
            atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
        base = "file://" + _own_dir
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"


_temporary: list[list[str]] = []


def drop(spark: SparkSession, *written: DataFrame) -> None:
    """Removes the files of written tables that nothing will read again."""
    for df in written:
        path = spark._jvm.org.apache.hadoop.fs.Path(df.plumbline_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Within, written tables are temporary: at the end all are removed but those given to the function that is yielded.

    Shuffle files of frames that are no longer in use are freed as well.
    """
    made, kept = [], set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.plumbline_path)
        return df

    _temporary.append(made)
    try:
        yield keep
    finally:
        _temporary.pop()
        drop(spark, *[df for df in made if df.plumbline_path not in kept])
        if _temporary:
            _temporary[-1].extend(df for df in made if df.plumbline_path in kept)
        made.clear()
        release(spark)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner free the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


#: Shuffle partitions a file of narrow rows.
NARROW = 16


def materialize(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Write `df` to the shared folder as Parquet and read it back.

    Cuts the lineage: later jobs read fixed rows, also when executors are
    lost, so row keys made before this point stay the same.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.plumbline_path = path
    if _temporary:
        _temporary[-1].append(out)
    return out


def materialize_narrow(df: DataFrame, name: str) -> DataFrame:
    """As `materialize`, for rows of a few numbers: gathered into few files.

    A task a partition would write a file each, for which an executor on local
    disks starts a process (chmod) or two.
    """
    return materialize(df.repartition(max(4, partitions(df.sparkSession) // NARROW)), name)


def materialize_bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """As `materialize`, dealt into buckets of `column`: a later join on it leaves these rows where they are.

    The table is external, in the shared folder; only its name is in the session's catalog.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    table = "plumbline_" + path.rpartition("/")[2].replace("-", "_")
    df.write.option("compression", "zstd").option("path", path).format("parquet").bucketBy(partitions(spark), column).sortBy(column).saveAsTable(table)
    return spark.table(table)


def free_names(df: DataFrame, n: int) -> list[str]:
    """`n` column names that `df` does not have, upper and lower case being alike."""
    taken = {c.lower() for c in df.columns}
    return [x for x in (f"plumbline_{i}" for i in range(n + len(taken))) if x not in taken][:n]


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows of `docs`, written, with a unique key each; and the name of the key's column."""
    (row,) = free_names(docs, 1)
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def least_keys(rows: DataFrame, row: str, roots: DataFrame) -> DataFrame:
    """The unique key `row` of the one of `rows` with the smallest (doc_id, text digest, key) of each root (row, root); null ids last."""
    key = F.col(row)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), key.alias("row"))
    least = rows.select(key.alias("row"), order.alias("rank")).join(roots, "row").groupBy("root").agg(F.min("rank").alias("least"))
    return least.select(F.col("least.row").alias(row))


def least_of_each(rows: DataFrame, row: str, roots: DataFrame) -> DataFrame:
    """Those of the written `rows` that `least_keys` names."""
    return rows.join(least_keys(rows, row, roots), row, "left_semi").drop(row)


#: A chunk's rows, and bytes of rows; its key is the partition and its number there, a row's key ends in its place in the chunk.
CHUNK_BITS, CHUNK_BYTES = 20, 1 << 21


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    chunk, held, size, n = TaskContext.get().partitionId() << CHUNK_BITS, [], 0, 0

    def blob() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.Table.from_batches(held).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "blob"])

    for batch in batches:
        # Rows of about a chunk's bytes at a time; a longer row is a chunk of its own.
        for lo in range(0, batch.num_rows, step := max(1, batch.num_rows * CHUNK_BYTES // 8 // max(batch.nbytes, 1))):
            piece = batch.slice(lo, step)
            if held and (size + piece.nbytes > CHUNK_BYTES or n + piece.num_rows >= 1 << CHUNK_BITS):
                yield blob()
                chunk, held, size, n = chunk + 1, [], 0, 0
            held.append(piece)
            size, n = size + piece.nbytes, n + piece.num_rows
    if held:
        yield blob()


def _rows_of(chunk: int, blob: bytes, names: list[str]) -> pa.Table:
    table = pa.ipc.open_stream(blob).read_all()
    return table.select(names).append_column("", pa.array(range(chunk << CHUNK_BITS, (chunk << CHUNK_BITS) + len(table)), pa.int64()))


class Chunks:
    """The rows of `docs`, written once in compressed chunks, with a unique key each (column `row`).

    The chunks lie in buckets: to take rows by their keys moves the keys to the
    chunks, never a text.
    """

    def __init__(self, docs: DataFrame):
        self.schema = StructType([StructField(f.name, f.dataType) for f in docs.schema])
        (self.row,) = free_names(docs, 1)
        self.written = materialize_bucketed(docs.mapInArrow(_pack, "chunk long, blob binary"), "rows", "chunk")

    def rows(self, *names: str) -> DataFrame:
        """The columns `names`, in the table's order, and the key of all rows."""
        names = [n for n in self.schema.names if n in names]
        return self.map(lambda batches: batches, StructType([*(self.schema[n] for n in names), StructField(self.row, LongType())]), names)

    def map(self, function, schema: StructType | str, names: list[str]) -> DataFrame:
        """What `function` makes of the columns `names` and the key of all rows, in the worker that reads them."""
        key = self.row

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, blob in zip(*batch.columns, strict=True):
                    yield from _rows_of(chunk.as_py(), blob.as_py(), names).rename_columns([*names, key]).to_batches()

        return self.written.select("chunk", "blob").mapInArrow(lambda batches: function(unpack(batches)), schema)

    def take(self, keys: DataFrame, names: list[str] | None = None) -> DataFrame:
        """The columns `names` (all of them) of the row of each of `keys` (its first column), and the other columns of `keys`, of type long."""

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    chunk, blob, wanted = (c[i] for c in batch.columns)
                    wanted = wanted.values.flatten()
                    at, base = wanted[0].to_numpy(), chunk.as_py() << CHUNK_BITS
                    table = pa.ipc.open_stream(blob.as_py()).read_all().select(names)
                    # A few rows at a time: a row may be taken more than once.
                    step = max(1, len(table) * CHUNK_BYTES // max(table.nbytes, 1))
                    for lo in range(0, len(at), step):
                        part = table.take(pa.array(at[lo : lo + step] - base)).combine_chunks()
                        for j, c in enumerate(more):
                            part = part.append_column(c, wanted[j + 1].slice(lo, step))
                        yield from part.to_batches()

        names, (key, *more) = names or self.schema.names, keys.columns
        wanted = keys.groupBy(F.shiftright(key, CHUNK_BITS).alias("chunk")).agg(F.collect_list(F.struct(*keys.columns)).alias("wanted"))
        return self.written.join(wanted, "chunk").select("chunk", "blob", "wanted").mapInArrow(pick, StructType([*(self.schema[n] for n in names), *(StructField(c, LongType()) for c in more)]))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def column_or_null(df: DataFrame, name: str, kind: str):
    """A column cast to `kind`; null where the table lacks it."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)


def open_fs(uri: str):
    """(filesystem, path) for a shared-folder URI: file, hdfs, s3 and what else pyarrow knows."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + (uri.removeprefix("file:") if uri.startswith("file:") else os.path.abspath(uri))
    return fs.FileSystem.from_uri(uri)
