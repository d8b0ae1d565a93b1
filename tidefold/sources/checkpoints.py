"""Reliable checkpoints in the folder that all executors share."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use `spark.checkpoint.dir`; where it is unset, on one machine only, a folder in the warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        context.setCheckpointDir(folder)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder's path below the checkpoint folder; `clean` deletes it."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"
    _made.append((weakref.ref(spark), path))
    return path


_made: list[tuple] = []


def clean(spark: SparkSession) -> None:
    """Delete the folders that `scratch` and `written` made in this session; what was read from them must be done."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for entry in [e for e in _made if e[0]() is spark]:
        path = jvm.org.apache.hadoop.fs.Path(entry[1])
        path.getFileSystem(conf).delete(path, True)
        _made.remove(entry)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: `df` written to the checkpoint folder and read from there (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's own switch: the shuffle files of a query go when it has ended, not when the driver's garbage is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Queries begun in here leave no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """As `checkpointed`, in Parquet: smaller, for results of many numbers. What was shuffled for it is deleted."""
    spark = df.sparkSession
    path = scratch(spark, "written")
    with _shuffles_released(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
