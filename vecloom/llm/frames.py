"""What all operators of this subpackage share: column choice, shared scratch space, array buffers."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: Sequence[str] = ()) -> DataFrame:
    """Only the columns that an operator reads, id as long and text as string.

    Other columns, whatever their names, never reach an operator's plan.
    """
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        *[F.col(f"`{c}`") for c in more],
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a local one only where that is unset and there are no other machines."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="vecloom-")
        atexit.register(shutil.rmtree, local, True)
        sc.setCheckpointDir(local)
        folder = sc.getCheckpointDir() or local
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def stored(df: DataFrame, by: str | None = None) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read again, and its path. Gone when the session ends.

    ``by``: in as many buckets by this column as shuffles have partitions, so that grouping by it again moves nothing; a table of the catalog until :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    if by:
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).option("compression", "none").format("parquet").saveAsTable(_name(path))
    else:
        df.write.parquet(path)
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)
    return spark.table(_name(path)) if by else spark.read.schema(df.schema).parquet(path), path


def _name(path: str) -> str:
    return "vecloom_" + path.rpartition("-")[2]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of :func:`stored` that nothing reads any more."""
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    files, where = _file_system(spark, path)
    files.delete(where, True)
    released(spark)


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner find the shuffle files of plans that are gone, which it does by the driver's garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """``df`` by way of the shared folder: cuts lineage, survives lost executors."""
    return stored(df)[0]


def large_list(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array from its flat values and the length of each list."""
    off = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))


@functools.cache
def memory_kept(size: int = 64 << 20) -> None:
    """Lets this process keep up to ``size`` bytes that it has freed, so that arrays as large as those before need no new pages; does nothing where the C library isn't glibc."""
    if hasattr(c := ctypes.CDLL(None), "gnu_get_libc_version"):
        c.mallopt(-3, size // 2)  # M_MMAP_THRESHOLD
        c.mallopt(-1, size)  # M_TRIM_THRESHOLD


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each compressed by itself, in as few bytes a number as it needs."""
    z, parts = zstandard.ZstdCompressor(level=1), []
    for x in arrays:
        if x.dtype.kind in "iu" and len(x):
            small = np.promote_types(np.min_scalar_type(x.min()), np.min_scalar_type(x.max()))
            x = x.astype(small) if small.itemsize < x.dtype.itemsize else x
        load = z.compress(np.ascontiguousarray(x).tobytes())
        parts += [x.dtype.str.encode().ljust(4), len(load).to_bytes(4, "little"), load]
    return b"".join(parts)


def unpacked(load: memoryview, plain: Sequence[int] = (), only: int | None = None) -> list[np.ndarray]:
    """The arrays of :func:`packed`, or only one of them; whole numbers have 64 bits again, but for those of the arrays ``plain``."""
    z, i, k, out = zstandard.ZstdDecompressor(), 0, 0, []
    while i < len(load):
        kind, size = np.dtype(bytes(load[i : i + 4]).decode().strip()), int.from_bytes(load[i + 4 : i + 8], "little")
        if only is None or k == only:
            x = np.frombuffer(z.decompress(load[i + 8 : i + 8 + size]), kind)
            out.append(x if kind.kind == "f" or k in plain else x.astype(np.uint64 if kind == np.uint64 else np.int64))
        i, k = i + 8 + size, k + 1
    return out
