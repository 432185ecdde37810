"""Cutting lineage and spreading small inputs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame

_LOCAL: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def shared_folder(spark) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    A local session (one machine, as in tests) that names none gets a temporary folder, made once.  On a cluster there
    is no such fallback: executors would write to their own disks, so a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="passagework-")
    return _LOCAL["dir"]


def new_folder(spark, kind: str = "passagework") -> str:
    """The path of a new folder below the shared one, which :func:`clean_up` knows."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Lost executors then cost nothing upstream, the result is computed once however often it is used, and the
    table's size is known, so Spark itself decides whether a join may broadcast it.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark) -> int:
    """Delete the folders that this application made below the shared one, and say how many there were.

    Frames that the library returned may still read them: call it when their results are written.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    return len(made)


def dealt(df: DataFrame, *keys: str, shares: int = 8, least: int = 4) -> DataFrame:
    """Deal rows by ``keys`` over tasks whose share is bounded, for steps that sort the text several times.

    A split of the input has 128 MB at most (``spark.sql.files.maxPartitionBytes``), so an eighth of one (``shares``) is what
    a task holds however large the input is; adaptive execution would join shares up to a core's part of the whole.  Four tasks a
    core at ``least``: one share more than there are cores would take twice the time.  ``df`` must be a scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least * cores, shares * df.rdd.getNumPartitions()), *keys)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows over all cores by ``keys`` where the input has fewer splits than there are cores.

    A table of many files keeps its splits: nothing is shuffled on a cluster for work a scan task can do.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(*keys) if df.rdd.getNumPartitions() < cores else df
