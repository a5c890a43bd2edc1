"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm.common import WORD, materialize, read, text_of

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_REPEATS = 2
BLOCK_TOKENS = 1024
#: 2^32 / golden ratio: multiples of it mod 2^32 are the golden-ratio points in whole numbers.
GOLDEN = 2654435769
ROUND = 1 << 32
CHUNK = 1 << 14
#: Rows that stand in one hash range of the line, about; a window sorts one range of one source.
RANGE_ROWS = 200_000
#: Cells of the schedule's circle; a cell holds the sources whose arcs meet it, mostly one.
CELLS = 1 << 12
#: Up to so many sources are broadcast; more are joined.
BROADCAST_SOURCES = 20_000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS) -> list[tuple[str | None, int, float]]:
    """(source, size, target) by code point, null last.

    Weights repeat over the sources. ``share`` times all sizes is dealt out by weight; a target
    stops at ``max_repeats`` times its source's size and the excess goes to the others by weight,
    until none is above. A source without words has target 0.
    """
    rows = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(rows))]
    left = share * sum(n for _, n in rows)
    out: dict[int, float] = {}
    free = list(range(len(rows)))
    while free:
        total = sum(weight[i] for i in free)
        over = [i for i in free if left * weight[i] / total > max_repeats * rows[i][1]]
        if not over:
            out |= {i: left * weight[i] / total for i in free}
            break
        for i in over:
            out[i] = float(max_repeats * rows[i][1])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in over]
    return [(s, n, float(out[i])) for i, (s, n) in enumerate(rows)]


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``_mx_source``, ``_mx_key`` (MD5 of id and text), ``_mx_size`` (words) of every row, and its id."""
    size = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("bigint")
    key = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.md5(text_of(text_col))))
    return df.select(F.col(id_col).alias("_mx_id"), F.col(source_col).alias("_mx_source"), key.alias("_mx_key"), size.alias("_mx_size"))


def taken_words(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """For rows of ``measured`` (a table: it is read several times): _mx_source, _mx_key, _mx_taken, _mx_from, and the source's size and target.

    One row for each distinct (source, key); rows that repeat share what it takes alike (see ``mix``).
    """
    spark = rows.sparkSession
    found = [(r[0], int(r[1]), int(r[2])) for r in rows.groupBy("_mx_source").agg(F.sum("_mx_size"), F.count(F.lit(1))).collect()]
    plan = targets([(s, n) for s, n, _ in found], weights, share, max_repeats)
    ranges = max(1, -(-max([k for _, _, k in found], default=0) // RANGE_ROWS))
    total = sum(t for _, _, t in plan)
    block = int(max(1, min(block_tokens, total // 4096)))
    slots = int(-(-total // block))
    edges, cum = [], 0.0
    for i, (s, n, t) in enumerate(plan):
        low = round(cum / total * ROUND) if total else 0
        cum += t
        edges.append((i, s, n, t, low, round(cum / total * ROUND) if total else 0, -(-n // block)))
    schema = "_mx_i int, _mx_source string, source_size bigint, target double, _mx_low bigint, _mx_high bigint, _mx_blocks bigint"
    few = F.broadcast if len(edges) <= BROADCAST_SOURCES else (lambda x: x)
    sources = spark.createDataFrame(edges, schema)  # one row per source
    # Slots: the point's cell names its source, or the few whose arcs meet there; then its rank in the chunk, and what earlier chunks had of that source.
    width = ROUND // CELLS
    arcs = few(sources.where("_mx_low < _mx_high").withColumn("_mx_cell", F.explode(F.sequence(F.floor(F.col("_mx_low") / width), F.floor((F.col("_mx_high") - 1) / width)))))
    slot = spark.range(slots).select((F.col("id") / CHUNK).cast("bigint").alias("_mx_chunk"), "id", F.pmod(F.pmod(F.col("id"), F.lit(ROUND)) * F.lit(GOLDEN), F.lit(ROUND)).alias("_mx_point"))
    slot = slot.withColumn("_mx_cell", F.floor(F.col("_mx_point") / width)).join(arcs, "_mx_cell").where("_mx_point >= _mx_low AND _mx_point < _mx_high").select("_mx_chunk", "id", "_mx_i", "_mx_blocks")
    per = slot.groupBy("_mx_i", "_mx_chunk").agg(F.count(F.lit(1)).alias("_mx_n"))
    before = per.select("_mx_i", "_mx_chunk", (F.sum("_mx_n").over(W.partitionBy("_mx_i").orderBy("_mx_chunk")) - F.col("_mx_n")).alias("_mx_before"))
    rank = F.row_number().over(W.partitionBy("_mx_i", "_mx_chunk").orderBy("id")) - 1
    taken = slot.withColumn("_mx_r", rank).join(before, ["_mx_i", "_mx_chunk"]).withColumn("_mx_r", F.col("_mx_r") + F.col("_mx_before"))
    taken = taken.where(F.col("_mx_r") < max_repeats * F.col("_mx_blocks")).select("_mx_i", (F.col("_mx_r") % F.col("_mx_blocks")).alias("_mx_block"))
    times = taken.groupBy("_mx_i", "_mx_block").agg(F.count(F.lit(1)).alias("_mx_times"))
    # Documents on their source's line, cut at block ends.
    named = few(sources.select("_mx_i", F.col("_mx_source").alias("_mx_s"), "source_size", "target"))
    numbered = rows.join(named, F.col("_mx_source").eqNullSafe(F.col("_mx_s"))).drop("_mx_s")
    ranged = numbered.withColumn("_mx_range", (F.conv(F.substring("_mx_key", 1, 8), 16, 10).cast("bigint") * F.lit(ranges) / F.lit(ROUND)).cast("int"))
    by_range = ranged.groupBy("_mx_i", "_mx_range").agg(F.sum("_mx_size").alias("_mx_sum"))
    start = by_range.select("_mx_i", "_mx_range", (F.sum("_mx_sum").over(W.partitionBy("_mx_i").orderBy("_mx_range")) - F.col("_mx_sum")).alias("_mx_start"))
    within = ranged.groupBy("_mx_i", "_mx_range", "_mx_source", "_mx_key", "source_size", "target").agg(F.sum("_mx_size").alias("_mx_size"), F.count(F.lit(1)).alias("_mx_rows"))
    sofar = F.sum("_mx_size").over(W.partitionBy("_mx_i", "_mx_range").orderBy("_mx_key")) - F.col("_mx_size")
    placed = within.withColumn("_mx_at", sofar).join(start, ["_mx_i", "_mx_range"]).withColumn("_mx_from", F.col("_mx_at") + F.col("_mx_start"))
    to = F.col("_mx_from") + F.col("_mx_size")
    blocks = F.sequence((F.col("_mx_from") / block).cast("bigint"), ((to - 1) / block).cast("bigint"))
    pieces = placed.withColumn("_mx_block", F.explode(F.when(F.col("_mx_size") > 0, blocks).otherwise(F.array(-1 - F.pmod(F.xxhash64("_mx_key"), F.lit(1 << 20))))))  # rows without words spread out
    overlap = F.least(to, (F.col("_mx_block") + 1) * block) - F.greatest(F.col("_mx_from"), F.col("_mx_block") * block)
    got = pieces.join(times, ["_mx_i", "_mx_block"], "left").groupBy("_mx_i", "_mx_key").agg(
        F.sum(F.when(F.col("_mx_size") > 0, overlap * F.coalesce("_mx_times", F.lit(0))).otherwise(0)).alias("_mx_taken"), *(F.first(c).alias(c) for c in ("_mx_source", "_mx_rows", "_mx_from", "source_size", "target")),
    )
    return got.select("_mx_source", "_mx_key", (F.col("_mx_taken") / F.col("_mx_rows")).cast("bigint").alias("_mx_taken"), "_mx_from", "source_size", "target")


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """All columns of ``df`` with ``size``, ``source_size``, ``target``, ``taken``. ``df`` is read twice.

    Every source's documents stand in the order of their id's MD5 on one line of words, cut into
    blocks of equal length. Slot i of the schedule maps the golden-ratio point i * GOLDEN mod 2^32
    through the cumulative targets to a source; the r-th slot of a source takes its block r, going
    round at most ``max_repeats`` times. ``taken`` is the number of a document's words in the blocks
    taken, repeats counted.

    Blocks have ``block_tokens`` words, fewer if the mix has under 4,096 blocks (then 1/4,096 of it),
    so a source misses its target by little more than one block. Words are counted once, into a narrow table.
    Positions on the line are sums over hash ranges plus sums within a range, and slots are counted
    by chunk before they are ranked, so no window holds a whole source. The driver sees one row per source, as
    its targets are shares of a whole; sources are broadcast up to BROADCAST_SOURCES.

    Null text: size 0, taken 0. Null source: a source of its own, last. Rows that repeat (same id and text)
    take alike, rounded down. Empty tables give empty results. Columns named like the four new ones are replaced;
    names starting with ``_mx_`` are reserved.
    """
    new = {"size", "source_size", "target", "taken"}
    rows = materialize(measured(df, id_col, text_col, source_col), "sizes")
    got = taken_words(rows, weights, share, max_repeats, block_tokens).select("_mx_source", "_mx_key", "_mx_taken", F.col("source_size").alias("_mx_ss"), F.col("target").alias("_mx_t"))
    size = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("bigint")
    key = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.md5(text_of(text_col))))
    base = df.withColumns({"_mx_size": size, "_mx_k": key})
    out = base.join(got, (F.col("_mx_k") == F.col("_mx_key")) & F.col(source_col).eqNullSafe(F.col("_mx_source")))
    out = out.withColumns({"size": F.col("_mx_size"), "source_size": F.col("_mx_ss"), "target": F.col("_mx_t"), "taken": F.col("_mx_taken")})
    return out.select(*[c for c in df.columns if c not in new], "size", "source_size", "target", "taken")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(measured(read(spark, sf_dir, "documents")), "sizes")
    got = taken_words(rows).select(F.col("_mx_source").alias("_s"), F.col("_mx_key").alias("_k"), "_mx_taken", "source_size", "target")
    out = rows.join(got, (F.col("_mx_key") == F.col("_k")) & F.col("_mx_source").eqNullSafe(F.col("_s")))
    return out.select(F.col("_mx_id").alias("doc_id"), F.col("_mx_size").alias("size"), "source_size", "target", F.col("_mx_taken").alias("taken"))
