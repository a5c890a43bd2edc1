"""Reading tables, computing columns once, and tables written on the way."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a query set that one block holds, and so the most that is broadcast.
BLOCK_ROWS = 2000
#: Rows that a numbered range has on average.
RANGE_ROWS = 500_000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once for each application; what runs Python there calls this first."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    path = os.path.join(tempfile.mkdtemp(prefix="glyphmill-"), "glyphmill.zip")  # only the driver reads it; Spark serves it to the executors
    with open(path, "wb") as f:
        f.write(packed.getvalue())
    context.addPyFile(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly where the input has fewer partitions than the cluster has cores; else leave it as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def kept(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row, however often later expressions use them.

    The planner otherwise puts an expression in the place of each use, also inside lambdas.
    """
    return df.select(*df.columns, F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))))) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, a session on one machine gets a temporary folder; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        there = context._jsc.sc().getCheckpointDir()
        found = there.get() if there.isDefined() else None
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("no shared folder: set spark.checkpoint.dir or call setCheckpointDir")
        found = tempfile.mkdtemp(prefix="glyphmill-")
        context.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    The lineage ends there, so a lost executor costs a reread and not a recomputation,
    and several consumers share one computation.
    """
    path = f"{shared_dir(df.sparkSession)}/glyphmill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._glyphmill_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` wrote; nothing that is still to run may depend on them."""
    for df in tables:
        if path := getattr(df, "_glyphmill_path", None):
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, order: str, name: str = "place", by: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in ``order`` within ``by``, null first; equal values go by ``ties``, then in any order.

    More than RANGE_ROWS rows are dealt out by ranges of (by, order, ties, row), whose boundaries Spark samples from the rows themselves, and
    written; rows are counted by range, a window numbers them within a range, and what the ranges before hold is added. So no window has more than a
    range, about RANGE_ROWS rows, however the values are spread: far outliers, clusters, and a value or group that a third of all rows have
    only move the boundaries.
    """
    by, ties = by or [], ties or []
    columns, parts = df.columns, -(-df.count() // RANGE_ROWS)
    within = [F.asc_nulls_first(c) for c in (order, *ties)]
    if parts <= 1:
        return df.withColumn(name, (F.row_number().over(W.partitionBy(*by or [F.lit(0)]).orderBy(*within)) - 1).cast("bigint"))
    ranged = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *map(F.asc_nulls_first, by), *within, "_row")
    ranged = written(ranged.withColumn("_range", F.spark_partition_id()), "ranged")
    before = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select(*by, "_range", (F.sum("_n").over(W.partitionBy(*by or [F.lit(0)]).orderBy("_range")) - F.col("_n")).alias("_before"))
    same = reduce(Column.__and__, (F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_range"]))
    inside = F.row_number().over(W.partitionBy(*by, "_range").orderBy(*within, "_row")) - 1
    placed = ranged.withColumn("_inside", inside).alias("r").join(before.alias("b"), same)
    return placed.select(*[f"r.{c}" for c in columns], (F.col("_inside") + F.col("_before")).cast("bigint").alias(name))


def running(df: DataFrame, order: str, amounts: list[str], by: list[str] | None = None) -> DataFrame:
    """``df`` with ``<amount>_before``: the sum of each amount over the rows of ``by`` whose ``order`` is lower, null first. ``order`` is distinct within ``by``.

    Sums by range come first: more than RANGE_ROWS rows are dealt out by ranges of (by, order) as Spark samples them, a window adds up within
    a range, and what the ranges before hold is added. No window holds more than a range.
    """
    by, total = by or [], {a: F.sum(a) for a in amounts}
    first = F.asc_nulls_first(order)
    parts = -(-df.count() // RANGE_ROWS)
    ranged = df.withColumn("_range", F.lit(0))
    if parts > 1:
        ranged = df.repartitionByRange(parts, *map(F.asc_nulls_first, by), first).withColumn("_range", F.spark_partition_id())
        ranged = written(ranged, "ranged")
    window = W.partitionBy(*by, "_range").orderBy(first)
    inside = ranged.withColumns({f"{a}_before": t.over(window) - F.col(a) for a, t in total.items()})
    if parts <= 1:
        return inside.drop("_range")
    sums = ranged.groupBy(*by, "_range").agg(*(t.alias(f"_{a}") for a, t in total.items()))
    earlier = W.partitionBy(*by or [F.lit(0)]).orderBy("_range")  # a row a range
    sums = sums.select(*by, "_range", *((F.sum(f"_{a}").over(earlier) - F.col(f"_{a}")).alias(f"_{a}_to") for a in amounts))
    same = reduce(Column.__and__, (F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_range"]))
    added = inside.alias("r").join(sums.alias("b"), same)
    return added.select(*(F.col(f"r.{c}") for c in df.columns), *((F.col(f"r.{a}_before") + F.col(f"b._{a}_to")).alias(f"{a}_before") for a in amounts))


def against(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Every row with every row of a query set, in blocks: a set of up to BLOCK_ROWS is broadcast, a larger one dealt out.

    A larger set is cut into blocks by hash; each row goes once to every block, and blocks are
    dealt out by block and a hash of the row, so no task holds a whole block's rows.
    """
    n = asked.count()
    if n <= BLOCK_ROWS:
        return rows.crossJoin(F.broadcast(asked))
    blocks, parts = -(-n // BLOCK_ROWS), max(1, rows.sparkSession.sparkContext.defaultParallelism)
    left = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("_block", F.pmod(F.xxhash64(*asked.columns[:1]), F.lit(blocks)).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.join(right, ["_block", "_part"]).drop("_block", "_part")
