"""The job table: latest state, recovery after a restart, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mapwright.storage import dealt_by_range

FINISHED = ("done", "error")


def latest(jobs: DataFrame, key: str = "job_id", order: str = "created_at") -> DataFrame:
    """The last row saved of each job."""
    return jobs.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order), F.desc("status")))).where("_n = 1").drop("_n")


def recent(jobs: DataFrame, limit: int) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), "job_id").limit(limit)


def recover(jobs: DataFrame) -> DataFrame:
    """Jobs that a restart has interrupted end in error."""
    open_ = ~F.col("status").isin(*FINISHED)
    return jobs.withColumn("error", F.when(open_, F.lit("interrupted")).otherwise(F.col("error"))).withColumn("status", F.when(open_, F.lit("error")).otherwise(F.col("status")))


def save(jobs: DataFrame, incoming: DataFrame, key: str = "job_id") -> DataFrame:
    """Jobs with the incoming rows in place of those of the same key."""
    return jobs.join(incoming.select(key).distinct(), key, "left_anti").select(jobs.columns).unionByName(incoming.select(jobs.columns))


def delete(jobs: DataFrame, keys: list, key: str = "job_id") -> DataFrame:
    return jobs.where(~F.col(key).isin(keys))


def retain(jobs: DataFrame, cap: int) -> DataFrame:
    """Without the oldest finished jobs beyond ``cap`` jobs in all; unfinished ones stay.

    Finished jobs are numbered in order of time inside parts by range; only the parts' sizes are summed up in one place.
    """
    over = jobs.count() - cap
    if over <= 0:
        return jobs
    order = ["created_at", "job_id"]
    dealt = dealt_by_range(jobs.where(F.col("status").isin(*FINISHED)).select(*order), order, "jobs-dealt")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row for each part
    sizes = dealt.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")).where(F.col("base") < over)
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order)) + F.col("base")
    gone = dealt.join(F.broadcast(sizes), "_part").withColumn("n", place).where(F.col("n") <= over).select("job_id")
    return jobs.join(gone, "job_id", "left_anti")
