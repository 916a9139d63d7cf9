"""Results of many runs in one place, and what changed from one run to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("run_id", "test_id")


def store_run(results: DataFrame, path: str, run_id: str) -> None:
    """Write the results of a run (one row per check) to the history in ``path``.

    Run and check are the partitions, and only those that are written are replaced: storing a run again, in whole or
    some of its checks, never doubles a row and touches no other run.
    """
    rows = results.withColumn("run_id", F.lit(run_id))
    # One file for each check; without this each task would write one.
    parted = rows.repartition(*KEYS)
    parted.write.partitionBy(*KEYS).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All stored runs. Names of runs and checks are text, whatever they look like."""
    return spark.read.option("inferSchema", "false").parquet(path).withColumns({k: F.col(k).cast("string") for k in KEYS})


def run_changes(history: DataFrame, run_id: str) -> DataFrame:
    """One row per check of a run and of the run before it: status and row count of both, and ``change``.

    The run before is the one with the greatest name below ``run_id``; without one, all checks are NEW. GONE is a check
    that the run lacks, BROKEN and FIXED one that passes no longer or again, MOVED one with another count or another way
    not to pass.
    """
    before_id = history.where(F.col("run_id") < run_id).agg(F.max("run_id")).scalar()

    def run(name: str, chosen: DataFrame) -> DataFrame:
        return chosen.select("test_id", F.col("status").alias(f"{name}_status"), F.col("row_count").alias(f"{name}_count"))

    before = run("before", history.where(F.col("run_id") == before_id))
    after = run("after", history.where(F.col("run_id") == run_id))
    was, now = F.col("before_status"), F.col("after_status")
    change = (
        F.when(was.isNull(), "NEW")
        .when(now.isNull(), "GONE")
        .when((was == "PASS") & (now != "PASS"), "BROKEN")
        .when((was != "PASS") & (now == "PASS"), "FIXED")
        .when((was != now) | ~F.col("before_count").eqNullSafe(F.col("after_count")), "MOVED")
        .otherwise("SAME")
    )
    return before.join(after, "test_id", "full").withColumn("change", change)
