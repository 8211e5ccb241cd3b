"""A session with the settings that the operators expect."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "veilframe", master: str | None = None, **conf: str) -> SparkSession:
    """ANSI mode, UTC and adaptive execution; cluster settings that are already there are kept."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for k, v in (fixed | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the driver has it, if they don't find it otherwise (installed, or shipped with
    --py-files)."""
    root, held = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in held.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        held["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that the session names, or one of this machine where all executors run on
    it. On a cluster without a named one this is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not named and held.isDefined():
        return held.get().rstrip("/")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = (named or tempfile.mkdtemp(prefix="veilframe-")).rstrip("/")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside are deleted once it is written, not when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def checkpointed(df: DataFrame, **options) -> DataFrame:
    """Written in the checkpoint folder, in compressed columns, and read from there: cuts lineage, and outlives lost executors."""
    spark, path = df.sparkSession, f"{checkpoint_folder(df.sparkSession)}/held-{uuid.uuid4().hex}"
    with shuffles_deleted(spark):
        df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def buckets(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpointed_by(df: DataFrame, key: str, placed: bool = False) -> DataFrame:
    """As checkpointed, in hash buckets of key: joins and groups on key read it without an exchange. placed: the rows come from a
    repartition(buckets, key), and lie there."""
    spark, name = df.sparkSession, f"held_{uuid.uuid4().hex}"
    n = buckets(spark)
    path = f"{checkpoint_folder(spark)}/{name.replace('_', '-')}"
    with shuffles_deleted(spark):
        (df if placed else df.repartition(n, key)).write.option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(name, format="parquet")
    back = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay, and back knows them
    return back


def discarded(*held: DataFrame) -> None:
    """Delete tables that `checkpointed` has written and nothing reads any more."""
    for df in held:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(unquote(folder))
            if at.getName().startswith("held-"):
                at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
