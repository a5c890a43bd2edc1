"""Exact dedup: 128-bit content hash groups, byte comparison inside groups, one stable id stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import read, text_of


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of ``df``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Rows are grouped by the MD5 of the text and, inside a group, by the text itself, so two
    texts with one MD5 stay apart. That aggregation combines on the map side: a group with a
    third of all rows leaves each task as one row. Ids then find their group by MD5 and SHA-256
    together; should two different texts of one group agree in both, the job stops with an error
    and reports it. Only narrow rows take part in that join, which AQE can split.

    ``keep`` is "smallest" or "largest": the id that stays.

    Null texts count as empty; all empty texts are one group. Ids may be null: a null id never
    stays unless its whole group has null ids, then ``keep_id`` is null and ``kept`` false. Rows
    that repeat an id are the same document and share its verdict; each counts in ``group_size``.
    Other columns of ``df`` are not read. An empty table gives an empty result.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    rows = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).withColumn("_key", F.unhex(F.md5("_text")))
    classes = rows.groupBy("_key", "_text").agg(pick("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    classes = classes.select("_key", F.sha2("_text", 256).alias("_sha"), "_keep", "_n")
    classes = classes.groupBy("_key", "_sha").agg(F.first("_keep").alias("_keep"), F.first("_n").alias("_n"), F.count(F.lit(1)).alias("_texts"))
    one = F.when(F.col("_texts") > 1, F.raise_error(F.lit("two texts with one MD5 and one SHA-256")).cast("bigint"))
    classes = classes.select("_key", "_sha", "_keep", F.coalesce(one, F.col("_n")).alias("_n"))
    ids = rows.select("_id", "_key", F.sha2("_text", 256).alias("_sha"))
    return ids.join(classes, ["_key", "_sha"]).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.coalesce(F.col("_id") == F.col("_keep"), F.lit(False)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), keep="largest")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
