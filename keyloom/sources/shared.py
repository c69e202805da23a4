"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

WAVES = 4
#: The folders written inside each open `scratch`.
_SCRATCH: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset (a local test session) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="keyloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame, name: str, scan: bool = False, tasks: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs one re-read, and gives joins a plain scan on
    this side, so that adaptive execution can split a hot key (it can't below an aggregate).
    scan: df comes straight from a table and keeps its tasks. What comes from a shuffle is
    written by at most WAVES tasks a core: a small table in very many partitions would cost a file for each.
    tasks: fewer than that do, as so few rows come out. On a local file system Hadoop starts processes for each file it
    writes, each of which is for a moment a second copy of the executor to those who measure its memory.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    most = WAVES * spark.sparkContext.defaultParallelism
    out = df if scan else df.coalesce(min(tasks or most, most))
    out.write.parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, keep: tuple[str, ...]) -> Iterator[None]:
    """Tables that `cut` writes inside are deleted at the end, but for those of the names in keep, which results still read."""
    held: list[str] = []
    _SCRATCH.append(held)
    try:
        yield
    finally:
        _SCRATCH.remove(held)
        conf = spark._jsc.hadoopConfiguration()
        for path in held:
            if not path.rsplit("/", 1)[1].startswith(tuple(f"{name}-" for name in keep)):
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)
