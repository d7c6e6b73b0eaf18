"""Tables in the folder that driver and executors share.

Lineage is cut by writing Parquet there and reading it back, so a lost executor costs a re-read, never a lost
result. The folder is the session's ``spark.checkpoint.dir``; only a local session without that setting gets a
folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``; a local session without it has a folder of its own, a cluster an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-mapwright-")
    return _OWN[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` returned, once nothing will read them any more."""
    for t in tables:
        path = getattr(t, "_written", None)
        if path is not None:
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def tasks_for(spark: SparkSession, rows: int, each: int = 250_000) -> int:
    """Tasks for a shuffle of so many rows: none has many more than ``each``, however few the session shuffles into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def dealt_by_range(rows: DataFrame, order: list[str], tag: str) -> DataFrame:
    """``rows`` in parts by range of ``order``, written, with ``_part``: each part's rows come before the next one's.

    For running values over groups of any size: a part is worked on alone, and only what it hands on, a row for each
    part, is gathered.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return materialize(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), tag)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
