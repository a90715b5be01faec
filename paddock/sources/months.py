"""Tables that are partitioned by ``report_month``."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import discard, scratch_path, shuffles_let_go, store


def read_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame | None:
    """The stored table, or nothing if it was never written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def month_order(months: Iterable[str | None]) -> list[str | None]:
    return sorted(set(months), key=lambda month: (month is None, month or ""))


def touched_months(rows: DataFrame) -> list[str | None]:
    """The months some rows fall in: as many as the calendar gives, whatever the rows."""
    return [row[0] for row in rows.select("report_month").distinct().collect()]


def in_months(rows: DataFrame, months: list[str | None]) -> DataFrame:
    named = [month for month in months if month is not None]
    condition = F.col("report_month").isin(*named) if named else F.lit(False)
    if None in months:
        condition = condition | F.col("report_month").isNull()
    return rows.filter(condition)


def drop_months(spark: SparkSession, path: str, months: Iterable[str | None]) -> None:
    for month in months:
        discard(spark, f"{path}/report_month={month if month is not None else '__HIVE_DEFAULT_PARTITION__'}")


def write_months(rows: DataFrame, path: str, add: bool = False) -> None:
    """Replace the months that ``rows`` holds, which must not be read from ``path`` itself, or ``add`` to them."""
    rows = rows.hint("rebalance", "report_month")
    with shuffles_let_go(rows.sparkSession):
        (
            rows.write.mode("append" if add else "overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("report_month")
            .parquet(path)
        )


def first_kept_day(as_of: str, days: int) -> str:
    return str(datetime.date.fromisoformat(as_of) - datetime.timedelta(days))


def trim_days(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    first_day: str,
    write: Callable[[DataFrame, str], None] = write_months,
) -> list[str]:
    """Take the rows of days before ``first_day`` out of a table; returns the months touched.

    Whole months go as folders; only the month of ``first_day`` is written anew, and only if
    it holds earlier days.  Rows without a date stay.
    """
    table = read_table(spark, path, schema)
    if table is None:
        return []
    month = first_day[:7]
    old = month_order(m for m in touched_months(table) if m is not None and m < month)
    drop_months(spark, path, old)
    edge = table.filter(F.col("report_month") == month)
    early = F.col("report_date") < F.lit(first_day).cast("date")
    if edge.filter(early).isEmpty():
        return old
    staged_path = scratch_path(spark, "trimmed")
    staged = store(edge.filter(~early), "trimmed", staged_path)
    if staged.isEmpty():
        drop_months(spark, path, [month])
    else:
        write(staged, path)
    discard(spark, staged_path)
    return [*old, month]
