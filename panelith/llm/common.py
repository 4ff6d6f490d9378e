"""Session helpers shared by the training-data operators.

Intermediate tables go to the shared folder that the cluster names in ``spark.checkpoint.dir``; they are plain
Parquet tables written by Spark's own commit protocol, so a lost executor costs a re-run of its tasks and nothing else.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound of an Arrow batch sent to a Python worker, so that a few very long texts never meet in one batch.
ARROW_BATCH_BYTES = "4m"

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master may go without ``spark.checkpoint.dir``."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if root is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelith-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


_made: dict[str, list[str]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/panelith/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def close(spark: SparkSession) -> None:
    """Deletes all that the operators wrote for this application. Call it when no result that they returned is needed any more."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches by bytes; row counts alone say nothing about texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES)


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the table read again, with its lineage cut."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._panelith_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``materialize`` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_panelith_path", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def doc_fold(col: str = "doc_id", folds: int = 5):
    """crc32 of the id as text modulo ``folds``; the text of a null id is empty."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % folds


def free_name(names: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores behind it until no column has the name."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def pick(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Only the columns an operator reads, so that further columns, whatever their names, can't clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


#: A value is hot if it stands in more than one part in so many of all rows; so many hot values there may be, at most.
HOT = 10_000


def look_up(rows: DataFrame, facts: DataFrame, keys: list[str], copies: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``facts`` (keys, ``copies``, values), which are read twice. Rows of the hot keys, at most ``HOT``, stay where they are."""
    values = [c for c in facts.columns if c not in keys and c != copies]
    hot = facts.where(F.col(copies) > max(1, total // HOT)).select(*keys, F.struct(*values).alias("found"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    near = marked.where("found is not null").select(*rows.columns, *[F.col(f"found.{v}").alias(v) for v in values])
    far = marked.where("found is null").drop("found").join(facts.drop(copies), keys, "left").select(*rows.columns, *values)
    return near.unionAll(far)
