"""Helpers that the operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES, IDLE_S = 8 << 20, 2.0


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one if all runs on this machine, else an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quartzite-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    """Delete what saved() wrote; results that still need it are gone with the application."""
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cleaned(spark: SparkSession, path: str) -> str:
    """path, which is deleted when the application ends."""
    _written.append((spark, path))
    return path


def saved(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut and lost executors lose nothing. Deleted when the application ends."""
    spark = df.sparkSession
    path = cleaned(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches end by bytes too, so that a worker holds a few MB of very long texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def trim() -> None:
    """Give a worker's free memory back to the system: it is kept for other tasks, and other workers need room beside it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def dropped(*caches: dict) -> Iterator[None]:
    """Empty these caches of a worker when its task ends, and trim its memory."""
    try:
        yield
    finally:
        for c in caches:
            c.clear()
        trim()


class Kept:
    """A value that a worker keeps from task to task, until IDLE_S seconds pass without one."""

    def __init__(self):
        self.lock, self.users = threading.Lock(), 0
        self.value: tuple[object, object] | None = None
        self.timer: threading.Timer | None = None

    @contextlib.contextmanager
    def use(self, key: object, make: Callable[[], object]) -> Iterator[object]:
        with self.lock:
            if self.timer:
                self.timer.cancel()
            if self.value is None or self.value[0] != key:
                self.value = (key, make())
            self.users += 1
            value = self.value[1]
        try:
            yield value
        finally:
            with self.lock:
                self.users -= 1
                self.timer = threading.Timer(IDLE_S, self._expire)
                self.timer.daemon = True
                self.timer.start()

    def _expire(self) -> None:
        with self.lock:
            if self.users:
                return
            self.value = None
        trim()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
