"""Writing: rows that aren't there yet, one keyed row in place of another, reports, a summary as JSON; tables that change are in ``versions``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unseen(rows: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """IO7: the rows whose key isn't there; of rows with one key the first by all columns."""
    return rows.join(there.select(key), key, "left_anti").dropDuplicates([key])


def replaced(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """IO8: ``rows`` with those of ``new`` in place of the rows with their keys; keys that aren't there are not added. Null keys match nothing.

    Of several new rows with one key the greatest by its other columns, in their order, counts.
    """
    other = [c for c in rows.columns if c != key]
    marked = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*other)).alias("_new"))
    joined = rows.join(marked, key, "left")
    return joined.select(key, *(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in other)).select(*rows.columns)


def write_reports(reports: DataFrame, path: str, column: str = "report") -> None:
    """IO16: reports as text files; line ends inside a report stay."""
    reports.select(column).write.mode("overwrite").text(path)


def payload(**parts: Column) -> Column:
    """IO17: a JSON object of the parts, in their order; nulls are kept."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in parts.items())), {"ignoreNullFields": "false"})
