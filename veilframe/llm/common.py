"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from functools import wraps
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.session import checkpoint_folder, shuffles_deleted

#: The white space of every word definition here: space and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]+"


#: Paths that `stored` has written, for Scratch.
_written: list[str] = []


class Scratch:
    """Deletes, at its end, the tables that were stored inside it but for those that are kept: use it only where what was kept no
    longer reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, set()

    def __enter__(self) -> Scratch:
        self.start = len(_written)
        return self

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        out = stored(df, label)
        self.kept.add(_written[-1])
        return out

    def keep_by(self, df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
        out = stored_by(df, label, key, buckets)
        self.kept.add(_written[-1])
        return out

    def __exit__(self, kind, *_) -> None:
        new = _written[self.start :]
        _written[self.start :] = [p for p in new if p in self.kept]
        if kind is None:
            for p in set(new) - self.kept:
                _delete(self.spark, p)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Stages:
    """Deletes the tables that a stage stored, once a later stage is asked for whose documents don't read them: what a stage returns
    must have been written by then."""

    def __init__(self):
        self.left: list[str] = []

    def __call__(self, stage):
        @wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            read = [unquote(f) for f in docs.inputFiles()] if self.left else []
            gone = [p for p in self.left if not any(f"/{p.rpartition('/')[2]}/" in f for f in read)]  # tables' names are unique
            self.left = [p for p in self.left if p not in gone]
            for p in gone:
                _delete(spark, p)
            start = len(_written)
            out = stage(spark, docs, sf_dir)
            self.left += _written[start:]
            del _written[start:]
            return out

        return run


class Rolling:
    """A table that is written again and again: each time the one before goes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, None

    def put(self, df: DataFrame, label: str) -> DataFrame:
        out, old = stored(df, label), self.path
        self.path = _written[-1]
        if old:
            _written.remove(old)
            _delete(self.spark, old)
        return out


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to a fresh table in the shared folder and read it back: cuts lineage and fixes every value."""
    path = f"{checkpoint_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with shuffles_deleted(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """As stored, in hash buckets of key: later joins and groups on key read them without an exchange."""
    spark, name = df.sparkSession, f"veilframe_{label}_{uuid.uuid4().hex}"
    path = f"{checkpoint_folder(spark)}/{name}"
    with shuffles_deleted(spark):
        df.write.bucketBy(buckets, key).option("path", path).saveAsTable(name, format="parquet")
    _written.append(path)
    back = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay, and back knows them
    return back


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate value once and hand it to body as a lambda variable, however often body refers to it."""
    return F.transform(F.array(value), body)[0]
