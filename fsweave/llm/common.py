"""Shared storage, text slicing and packed arrays used by the corpus operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is read from ``spark.checkpoint.dir``.  Only where that is unset and Spark runs
    on one machine (tests) a temporary folder is made and remembered in the session.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="fsweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/fsweave/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark can reach it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Work:
    """Intermediate tables of one operator; they go when its block ends, whole or failed.

    What the operator returns is staged outside, since it is read later.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.names = spark, scratch(spark, name), []

    def __enter__(self) -> Work:
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.at)

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        """As :func:`staged`, until the block ends."""
        path = f"{self.at}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, buckets: int, by: str) -> DataFrame:
        """``df`` as a bucketed table, until the block ends."""
        self.names.append(f"{name}_{uuid.uuid4().hex}")
        df.write.bucketBy(buckets, by).option("path", f"{self.at}/{self.names[-1]}").format("parquet").saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])


@contextmanager
def tidy_shuffles(spark: SparkSession):
    """Within the block, a write's shuffle files go when the write is done."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(batches_to_batches: Callable) -> Callable:
    """A task's function that gives the memory it freed back to the system when it ends.

    Python workers serve one stage after another, so what one stage leaves behind
    would count against the next.
    """

    @wraps(batches_to_batches)
    def run(batches):
        forget()
        try:
            yield from batches_to_batches(batches)
        finally:
            trim_memory()

    return run


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable):
    """An object that a worker keeps from task to task of a stage; one at a time, until another stage begins."""
    if name not in _KEPT:
        forget()
        _KEPT[name] = make()
    return _KEPT[name]


def forget() -> None:
    _KEPT.clear()


def trim_memory() -> None:
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed_share(n: int, bound: int) -> int:
    """Of 2**20 hash slots, how many to keep so that about ``bound`` of ``n`` rows stay."""
    return 1 << 20 if n <= bound else max(1, (bound << 20) // n)


def runs(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose summed size stays near ``limit`` (one item at least)."""
    start = total = 0
    end = 0
    for end, size in enumerate(sizes, 1):
        total += size
        if total >= limit:
            yield start, end
            start, total = end, 0
    if start < end:
        yield start, end


def open_folder(folder: str):
    """A folder's file system and its path there (local, hdfs and object stores alike)."""
    return pyarrow.fs.FileSystem.from_uri(folder)


def publish(fs, folder: str, name: str, end: str, data: bytes) -> str:
    """Write a file under a name of its own and return that.

    A name is never used twice, so attempts of one task do not meet.  What a dead or
    second attempt leaves behind is in no list of files, and readers go by the list.
    """
    fs.create_dir(folder, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}{end}"
    with fs.open_output_stream(f"{folder}/{name}", compression=None) as f:
        f.write(data)
    return name


_PACK = zstandard.ZstdCompressor(level=1)
_UNPACK = zstandard.ZstdDecompressor()


def pack_ints(a: np.ndarray) -> bytes:
    """Compress an unsigned array: byte planes of the values, so that equal high bytes shrink."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T
    return _PACK.compress(np.ascontiguousarray(planes).tobytes())


def unpack_ints(blob: bytes, dtype) -> np.ndarray:
    """Undo :func:`pack_ints`."""
    raw = np.frombuffer(_UNPACK.decompress(blob), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    """Compress an ascending uint64 array as differences."""
    return pack_ints(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    """Undo :func:`pack_sorted`."""
    return np.cumsum(unpack_ints(blob, np.uint64), dtype=np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every input bit (splitmix64's constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered for the words seen lately."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def window_hashes(x: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash of every ``width`` consecutive word hashes, finalised."""
    n = len(x) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = x[:n].copy()
    b = np.uint64(base)
    for k in range(1, width):
        h *= b
        h += x[k : k + n]
    return mix64(h)
