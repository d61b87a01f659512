"""What the operators share: the input projection, shared storage, word and hash helpers."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = " \t\n\r\x0b\x0c"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only the two columns the operators read, so that no other column of any name can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names for helper columns, none of which df has (Spark doesn't tell upper from lower case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def named(*columns: str) -> list[Column]:
    """Columns by name, whatever the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one with a local master (tests)
    and an error on a cluster, whose executors wouldn't see each other's files."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut and nothing is computed twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _steps().append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _steps() -> list[str]:
    if not hasattr(_THREAD, "steps"):
        _THREAD.steps = []
    return _THREAD.steps


def written() -> int:
    """How many steps materialise() has written in this thread and not removed; remove_steps() takes it as a mark."""
    return len(_steps())


def remove_steps(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the steps written after a mark but for the last so many. Frames that read them can't be used any more."""
    steps = _steps()
    gone = steps[since : len(steps) - keep]
    del steps[since : len(steps) - keep]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Schemes of Hadoop paths by those that pyarrow knows; dbfs: is mounted on every machine.
SCHEMES = {"s3a://": "s3://", "s3n://": "s3://", "gcs://": "gs://", "dbfs:/": "file:///dbfs/"}


def store(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that the driver and all executors reach, by pyarrow."""
    uri = next((new + folder.removeprefix(old) for old, new in SCHEMES.items() if folder.startswith(old)), folder)
    try:
        return pafs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid as e:
        raise ValueError(f"no way to write files to {folder}; pyarrow knows file, hdfs, s3, gs and abfs") from e


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keep: str = "") -> DataFrame:
    """mapInArrow in workers that hold little between tasks: what other operators have cached goes first (all but the caches
    whose names begin with keep), and memory that is free goes back to the system at the end."""

    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keep)
        try:
            yield from fn(batch.rename_columns(names) for batch in batches)
        finally:
            give_back()

    # mapInArrow looks its columns up by name, which one with a dot doesn't survive
    odd = any("." in c or "`" in c for c in names)
    return (df.toDF(*(f"c{k}" for k in range(len(names)))) if odd else df).mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, keep: str = "") -> DataFrame:
    """Arrow batch in, Arrow batch out; fn holds no state that a retried task would miss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return map_arrow(df, run, schema, keep)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Memo(dict):
    """A bounded cache: a missing key is computed by fn; at the limit the cache starts anew."""

    def __init__(self, fn: Callable, limit: int = 250_000, longest: int = 200):
        super().__init__()
        self.fn, self.limit, self.longest = fn, limit, longest

    def __missing__(self, key):
        value = self.fn(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def worker_cache(name: str, make: Callable):
    """One object of a kind per Python worker process; workers are reused between tasks."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def forget(keep: str = "") -> None:
    for name in [n for n in _KEPT if not keep or not n.startswith(keep)]:
        del _KEPT[name]


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_KEPT: dict = {}
_THREAD = threading.local()
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
