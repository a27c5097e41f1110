"""Small helpers that the training-data operators share."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (local tests) a temporary folder of this machine stands in; on a cluster, where
    the executors would not see it, that is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or os.path.join(tempfile.gettempdir(), "glyphflow-checkpoints")


def written(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The files survive the loss of any executor, and the job that made them runs
    once. A fresh name per call means that nothing is ever overwritten.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame | SparkSession) -> None:
    """Delete the files of tables that ``written`` gave and that no later job reads; of a session, nothing.

    What finished jobs shuffled goes as well once no DataFrame can ask for it, which a collection of garbage finds out.
    """
    for df in tables:
        if isinstance(df, DataFrame):
            context = df.sparkSession.sparkContext
            for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        else:
            context = df.sparkContext
    # The first collection lets Spark's cleaner go, the second finds what that held.
    for pause in (0.3, 0.0):
        gc.collect()
        context._jvm.System.gc()
        time.sleep(pause)


def fresh(df: DataFrame, stem: str) -> str:
    """A name with which no column of ``df`` begins."""
    while any(c.lower().startswith(stem) for c in df.columns):
        stem = f"_{stem}"
    return stem


def doc_bucket(col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``: the fold of a document."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(modulus)


#: The stores of this worker process.
_STORES: list[TwoGenerations] = []


def only(store: TwoGenerations | None = None) -> None:
    """Empty all other stores of this worker: a worker may run the tasks of several operators in turn."""
    for other in _STORES:
        if other is not store and (other or other.older):
            other.clear()
            other.older = {}


class TwoGenerations(dict):
    """A dictionary filled on demand by ``make``, with at most twice ``entries`` entries.

    With ``MARKS`` a key is stored when it is asked for again, so that keys that occur
    once take no room. When the newer half is full the older half goes; what is still in use moves
    over on its next use. It changes speed only.
    """

    MARKS = 0

    def __init__(self, entries: int, longest: int):
        super().__init__()
        self.entries, self.longest, self.older = entries, longest, {}
        self.asked, self.marked = bytearray(self.MARKS), 0
        _STORES.append(self)

    def make(self, key: str):
        raise NotImplementedError

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            mark = hash(key) & (self.MARKS - 1)
            if self.MARKS and not self.asked[mark]:
                self.asked[mark] = 1
                self.marked += 1
                if self.marked > self.MARKS // 2:
                    self.asked, self.marked = bytearray(self.MARKS), 0
                return value
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value
