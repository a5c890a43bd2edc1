"""What the operators of this subpackage share: reading tables and cutting lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.sources import tables
from glyphmill.sources.tables import discard, shared_dir
from glyphmill.sources.tables import written as materialize

__all__ = ["SPACE", "WORD", "UPPER", "ascii_lower", "discard", "fold", "materialize", "read", "shared_dir", "ship", "text_of"]

#: Words are runs of anything but these six bytes.
SPACE = r"\x20\x09-\x0D"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, and keep Arrow batches of texts small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default; texts are long
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    tables.ship(spark)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5
