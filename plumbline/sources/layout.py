"""Tables stored by month, so that a date window reads the files of its months only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.slices import month_column


def write_by_month(rows: DataFrame, path: str, day: str, files: int = 1) -> None:
    """Write a table partitioned by the month of ``day``, in about ``files`` files a month.

    The month stands beside the day as a column of its own (``month_column``), which ``in_window`` filters as well when a
    table has it. Rows without a day go to a partition of their own and are in no window. Months are written by as many
    tasks as files, so a month with most rows is no single task, and a write that is repeated replaces the table.
    """
    month = F.date_format(day, "yyyy-MM")
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(files))
    named = rows.withColumn(month_column(day), month).withColumn("_part", part)
    spread = named.repartition(month_column(day), "_part").drop("_part")
    spread.write.partitionBy(month_column(day)).mode("overwrite").parquet(path)


def with_position_date(rows: DataFrame) -> DataFrame:
    """Monthly positions with their file date parsed, for ``write_by_month``: the text itself prunes nothing."""
    return rows.withColumn("position_date", F.try_to_date("file_date", "yyMMdd"))
