"""Shared plumbing: scratch tables in the cluster's shared folder, published arrays, batched text scans."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only on a local master whose session names no shared folder, as in tests.
LOCAL_FALLBACK = "/tmp/checkpoints/abundex"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, which only a local master may leave unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_FALLBACK).rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/abundex-{tag}-{uuid.uuid4().hex}"


def keep(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut and any executor can be lost.

    rows: about how many there are; few rows go to few files."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    if rows is not None and (files := rows // 100_000 + 1) < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(files)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._abundex_path = path
    return kept


def forget(*tables: DataFrame) -> None:
    """Delete tables written by keep() that no later step reads."""
    for df in tables:
        path = getattr(df, "_abundex_path", None)
        if path:
            jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Arrays:
    """Named numpy arrays that workers memory-map.

    Where the shared folder is a mounted path (file:), the driver writes the files there and workers map them in
    place. On other stores (HDFS, object stores) the files go out with SparkContext.addFile, so that each executor maps
    one local copy. The object is small and travels in closures."""

    def __init__(self, spark: SparkSession, tag: str, add_file: bool | None = None):
        root = shared_dir(spark)
        mounted = root.startswith(("file:", "/"))
        self._ship = (not mounted) if add_file is None else add_file
        self._id = f"abundex-{tag}-{uuid.uuid4().hex}"
        if self._ship:
            import tempfile

            self._dir = os.path.join(tempfile.mkdtemp(), self._id)
        else:
            self._dir = os.path.join("/" + root.removeprefix("file:").lstrip("/"), self._id)
        os.makedirs(self._dir, exist_ok=True)
        self._spark = spark

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_spark"}

    def put(self, name: str, array: np.ndarray) -> None:
        np.save(os.path.join(self._dir, f"{name}.npy"), array)

    def create_raw(self, name: str, dtype, size: int) -> np.ndarray:
        """A file of size items for the driver to fill."""
        path = os.path.join(self._dir, f"{name}.raw")
        if not size:
            open(path, "wb").close()
            return np.empty(0, dtype)
        return np.memmap(path, dtype, "w+", shape=(size,))

    @property
    def mounted(self) -> bool:
        """Whether workers write where others map."""
        return not self._ship

    def reserve(self, name: str, dtype, size: int) -> None:
        """A file of size items for the workers to fill."""
        with open(os.path.join(self._dir, f"{name}.raw"), "wb") as f:
            f.truncate(size * np.dtype(dtype).itemsize)

    def write(self, name: str, start: int, array: np.ndarray) -> None:
        """Items from start on; a task that runs again writes the same."""
        with open(os.path.join(self._dir, f"{name}.raw"), "r+b") as f:
            f.seek(start * array.itemsize)
            f.write(np.ascontiguousarray(array).data)

    def discard(self, names: list[str]) -> None:
        """Delete raw files that only the driver needed."""
        for name in names:
            os.remove(os.path.join(self._dir, f"{name}.raw"))

    def publish(self, names: list[str] | None = None) -> Arrays:
        """Send the named raw files (or all files) to the executors, where the folder isn't a mounted one."""
        if self._ship:
            for f in sorted(os.listdir(self._dir)):
                if not f.startswith(self._id) and (names is None or f.rpartition(".")[0] in names):
                    tagged = os.path.join(self._dir, f"{self._id}-{f}")
                    os.link(os.path.join(self._dir, f), tagged)
                    self._spark.sparkContext.addFile(tagged)
        return self

    def _path(self, file: str) -> str:
        local = os.path.join(self._dir, file)
        if not self._ship or hasattr(self, "_spark"):
            return local
        from pyspark import SparkFiles

        return SparkFiles.get(f"{self._id}-{file}")

    def get(self, name: str) -> np.ndarray:
        return np.load(self._path(f"{name}.npy"), mmap_mode="r")

    def get_raw(self, name: str, dtype, mode: str = "r") -> np.ndarray:
        path = self._path(f"{name}.raw")
        return np.memmap(path, dtype, mode) if os.path.getsize(path) else np.empty(0, dtype)


def crc_mod(col: Column | str, m: int) -> Column:
    """crc32 of the id as text, modulo m; null ids give null."""
    return F.crc32(F.col(col).cast("string").cast("binary") if isinstance(col, str) else col.cast("string").cast("binary")) % F.lit(m)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches):
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def small_batches(df: DataFrame, rows: int = 2000) -> DataFrame:
    """Long texts make wide batches: bound the rows of an Arrow batch (and with 4.x also its bytes)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return df


def rename_clashes(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns that an operator is about to add replace columns of the same name."""
    return df.drop(*[c for c in names if c in df.columns])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
