"""Folders that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``; only a local master may go without one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="panelith-"))
        root = _local[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stamp(spark: SparkSession, *paths: str) -> str:
    """Sizes and times of the files under the paths: another text once one of them has changed."""
    out, jvm, conf = [], spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        for f in fs.globStatus(p) or []:
            for g in fs.listStatus(f.getPath()):
                out.append(f"{g.getPath().getName()} {g.getLen()} {g.getModificationTime()}")
    return ", ".join(sorted(out))


_made: list[tuple[str, str]] = []


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new path in the shared folder and read again: plans that read it several times compute it once."""
    spark = df.sparkSession
    path = scratch(spark, name)
    _made.append((spark.sparkContext.applicationId, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def close(spark: SparkSession) -> None:
    """Deletes what ``materialized`` wrote for this application. Call it when no result that reads it is needed any more."""
    own = spark.sparkContext.applicationId
    for app, path in [m for m in _made if m[0] == own]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _made.remove((app, path))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def file_system(path: str):
    """The file system of a shared path, for use in tasks, and the path inside it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:  # Hadoop's names of S3 are not pyarrow's
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
    return fs.LocalFileSystem(), path
