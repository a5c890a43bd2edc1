"""Values as of a time, and a seeded sample of titles with their revision as of a date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.operators.corpus import seeded
from glyphmill.sources import tables
from glyphmill.sources.tables import written

#: Titles that are lists or portals rather than prose, and the least length of a cleaned text.
SKIPPED_TITLES = ("Daftar ", "Lampiran ", "Daftar")
MIN_CHARS = 800


def as_of(asked: DataFrame, revisions: DataFrame, key: str, at: str, name: str = "revision", ties: list[str] | None = None) -> DataFrame:
    """``asked`` with ``name``: the other columns of the last of ``revisions`` with its key at its time or before; null if there is none.

    Both sides become one table in order of key and time, and the last revision seen is carried along. Rows are dealt out by ranges of (key, time)
    whose boundaries Spark samples, about RANGE_ROWS rows each, and the last revision that the ranges before hold of a key is
    carried in; so a key with a third of all rows is cut by time and never in one task. A join by key would pair all its rows.

    Revisions of one time go by ``ties``, the last one counts. Null keys and null times find nothing. Rows that repeat stay rows of their own.
    """
    ties = ties or []
    others = [c for c in revisions.columns if c not in (key, at)]
    own = asked.select(F.struct(*asked.columns).alias("_row"), F.col(key).alias("_key"), F.col(at).alias("_at"))
    payload = F.struct(*others)
    left = own.select("_key", "_at", F.lit(1).alias("_kind"), *(F.lit(None).cast(dict(revisions.dtypes)[c]).alias(f"_t{i}") for i, c in enumerate(ties)), F.lit(None).cast(revisions.select(payload.alias("x")).schema["x"].dataType).alias("_value"), "_row")
    right = revisions.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    right = right.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(0).alias("_kind"), *(F.col(c).alias(f"_t{i}") for i, c in enumerate(ties)), payload.alias("_value"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"))
    none = left.where("_key IS NULL OR _at IS NULL").select("_row.*", F.col("_value").alias(name))
    rows = left.where("_key IS NOT NULL AND _at IS NOT NULL").unionByName(right)
    order = ["_at", "_kind", *(f"_t{i}" for i in range(len(ties)))]
    ranges = max(1, -(-rows.count() // tables.RANGE_ROWS))
    dealt = rows.repartitionByRange(ranges, "_key", *order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "as-of")
    last = F.last("_value", ignorenulls=True)
    inside = W.partitionBy("_key", "_range").orderBy(*order)
    found = dealt.withColumn("_found", last.over(inside))
    if ranges > 1:
        ends = dealt.where("_kind = 0").groupBy("_key", "_range").agg(F.max_by("_value", F.struct(*order)).alias("_end"))
        places = dealt.select("_key", "_range").distinct().join(ends, ["_key", "_range"], "left")  # a row for each key of each range
        before = W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
        carried = places.select("_key", "_range", F.last("_end", ignorenulls=True).over(before).alias("_before"))
        found = found.join(carried, ["_key", "_range"]).withColumn("_found", F.coalesce("_found", "_before"))
    return found.where("_kind = 1").select("_row.*", F.col("_found").alias(name)).unionByName(none)


def sample_as_of(titles: DataFrame, revisions: DataFrame, date: Column, cleaned: Column, keep: int, seed: int = 42, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """IO12: the first ``keep`` titles in seeded order whose revision as of ``date`` is long enough, and a row of counters of what was seen on the way.

    ``titles`` has (page, title); ``revisions`` (page, at, text and others). Titles are seen in the order of a seeded
    digest. One seen before is a duplicate, one that starts like a list is skipped, one without any revision is missing, without one by the date has no old revision,
    and one whose ``cleaned`` text (an expression over the revision's columns) has under ``min_chars`` characters is short. Null and empty titles aren't seen.
    The digest of the last one kept bounds what was seen, so the counts need no loop.
    """
    seen = titles.where(F.trim(F.coalesce("title", F.lit(""))) != "").withColumn("_o", seeded(seed, "title", "page"))
    seen = seen.join(seen.groupBy("title").agg(F.min("_o").alias("_least")), "title").withColumn("_first", F.col("_o") == F.col("_least"))
    listed = reduce(Column.__or__, (F.col("title").startswith(p) for p in SKIPPED_TITLES))
    found = as_of(seen.withColumn("at", date), revisions, "page", "at")
    exists = revisions.select("page").distinct().withColumn("_any", F.lit(True))
    found = found.join(exists, "page", "left").withColumn("_clean", F.when(F.col("revision").isNotNull(), cleaned))
    status = F.when(~F.col("_first"), "dup_title").when(listed, "list_title").when(F.col("_any").isNull(), "missing").when(F.col("revision").isNull(), "no_oldrev").when(F.length("_clean") < min_chars, "short").otherwise("ok")
    found = written(found.withColumn("status", status), "seen-titles")
    kept = found.where("status = 'ok'").orderBy("_o").limit(keep)
    last = kept.agg(F.when(F.count(F.lit(1)) == keep, F.max("_o")).alias("_last"))
    counts = found.crossJoin(F.broadcast(last)).where("_last IS NULL OR _o <= _last").groupBy("status").agg(F.count(F.lit(1)).alias("n"))  # one row
    return kept.select("page", "title", "revision", F.col("_clean").alias("text")), counts
