"""Nearest vectors by cosine: an inverted file of cells round centroids, probed by cell, exact where asked for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.sources.tables import ship, spread, written

#: Rows that the centroids are fitted on, about, and the most cells there are.
SAMPLE, CELLS = 32_768, 1_024
#: Rows, and probes, of a cell that meet in one task; larger cells are cut by a hash of the id.
BLOCK_ROWS, BLOCK_ASKED = 50_000, 20_000
ROUNDS = 12
#: Rows, and rows of the query set, of a block whose products one task makes.
MET_ROWS = 1_000


def units(column: pa.Array, size: int) -> np.ndarray:
    """Vectors scaled to length 1 in double precision; one that is missing, has another size, a null or no length is all zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(lists), size))
    lengths = np.asarray(lists.value_lengths().fill_null(0))
    if size:
        starts, values = np.asarray(lists.offsets)[:-1], np.asarray(lists.values.cast(pa.float64()).fill_null(np.nan))
        good = np.flatnonzero((lengths == size) & ~np.asarray(lists.is_null()))
        out[good] = values[starts[good][:, None] + np.arange(size)]
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.where(np.isfinite(norm) & (norm > 0), out / np.where(norm > 0, norm, 1), 0.0)


def products(there: pa.Array, asked: pa.Array) -> np.ndarray:
    """Cosines of every asked vector (a line) with every other: 0 where one is missing, has a null or no length, or sizes differ; not a number where one holds such."""

    def parts(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        sizes = np.where(np.asarray(lists.is_null()), -1, np.asarray(lists.value_lengths().fill_null(0)))
        values = lists.values.cast(pa.float64())
        void, odd = np.asarray(values.is_null()), ~np.isfinite(np.asarray(values.fill_null(0.0)))
        starts, by = np.asarray(lists.offsets)[:-1], {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(sizes == size)
            unit = units(lists.take(pa.array(at)), size)
            cells = starts[at][:, None] + np.arange(size)
            unit[odd[cells].any(axis=1) & ~void[cells].any(axis=1)] = np.nan
            by[size] = at, unit, void[cells].any(axis=1)
        return by

    left, right = parts(asked), parts(there)
    out = np.zeros((len(asked), len(there)))
    for size in left.keys() & right.keys():
        (i, x, no), (j, y, none) = left[size], right[size]
        sims = x @ y.T
        sims[no] = 0.0
        sims[:, none] = 0.0
        out[np.ix_(i, j)] = sims
    return out


def cosines(rows: DataFrame, asked: DataFrame, digits: int = 6) -> DataFrame:
    """(q, v, sim) of every one of ``asked`` (q, x) with every row (v, vector) but itself: rounded cosines, as ``products`` has them.

    As many rows as there are pairs. Both sides are cut into blocks by a hash of the id, and a task multiplies a block with a block, so
    none holds more than about MET_ROWS squared, whatever the tables' sizes. Rows without an id meet none.
    """
    ship(rows.sparkSession)
    rows, asked = rows.toDF("v", "vector").where("v IS NOT NULL"), asked.toDF("q", "x").where("q IS NOT NULL")
    n, m = (max(1, -(-df.count() // MET_ROWS)) for df in (rows, asked))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    left = rows.select(block("v", n).alias("a"), every(m).alias("b"), F.col("v").cast("bigint").alias("v"), "vector")
    right = asked.select(every(n).alias("a"), block("q", m).alias("b"), F.col("q").cast("bigint").alias("q"), "x")

    def meet(there: pa.Table, of: pa.Table) -> pa.Table:
        if not len(there) or not len(of):
            return pa.table({"q": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        v, q = there.column("v").to_numpy(), of.column("q").to_numpy()
        sims = np.round(products(there.column("vector"), of.column("x")), digits) + 0.0
        other = q[:, None] != v[None, :]
        return pa.table({"q": np.repeat(q, len(v))[other.ravel()], "v": np.tile(v, len(q))[other.ravel()], "sim": sims[other]})

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(meet, "q bigint, v bigint, sim double")


def fitted(sample: np.ndarray, cells: int, seed: int = 42) -> np.ndarray:
    """Centroids of length 1: rounds of assignment and averaging on the sample, from rows drawn with a fixed seed."""
    some = sample[np.abs(sample).sum(axis=1) > 0]
    if not len(some):
        return np.zeros((1, sample.shape[1]))
    rng = np.random.default_rng(seed)
    centres = some[rng.choice(len(some), min(cells, len(some)), replace=False)]
    for _ in range(ROUNDS):
        of = (some @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, of, some)
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        centres = np.where(norm > 0, total / np.where(norm > 0, norm, 1), centres)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, target: float) -> int:
    """Cells to probe so that ``target`` of the sample's own k nearest lie in them, from up to 500 of its rows as queries."""
    asked = sample[:: max(1, len(sample) // 500)]
    sims = asked @ sample.T
    sims[np.arange(len(asked)), np.arange(0, len(sample), max(1, len(sample) // 500))] = -2
    near = np.argsort(-sims, axis=1)[:, :k]
    rank = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    cell = (sample @ centres.T).argmax(axis=1)
    return int(np.quantile(np.take_along_axis(rank, cell[near], axis=1), target)) + 1 if near.size else 1


def met(indexed: DataFrame, probes: DataFrame, size: int, k: int, digits: int) -> DataFrame:
    """(q, id, sim): the first k of each probe (q, x, cell) in each block of its cell.

    A cell is cut into blocks of rows and of probes by counts taken first, so a cell that holds a third of all
    vectors is many tasks; each block of rows meets each block of probes of its cell, as a product of matrices.
    """
    blocks = lambda df, most, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    cut = blocks(indexed, BLOCK_ROWS, "rows").join(blocks(probes, BLOCK_ASKED, "sets"), "cell")
    cut = written(cut, "blocks")
    left = indexed.join(cut, "cell").withColumns({"a": F.pmod(F.xxhash64("id"), "rows").cast("int"), "b": F.explode(F.sequence(F.lit(0), F.col("sets") - 1))}).select("cell", "a", "b", "id", "vector")
    right = probes.join(cut, "cell").withColumns({"b": F.pmod(F.xxhash64("q"), "sets").cast("int"), "a": F.explode(F.sequence(F.lit(0), F.col("rows") - 1))}).select("cell", "a", "b", "q", "x")

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(rows) and len(asked):
            ids, there = rows.column("id").to_numpy(), units(rows.column("vector"), size)
            for part in asked.to_batches(max_chunksize=512):
                q = part.column("q").to_numpy()
                sims = np.round(units(part.column("x"), size) @ there.T, digits) + 0.0
                sims[q[:, None] == ids[None, :]] = -np.inf
                bar = np.partition(sims, max(0, sims.shape[1] - k), axis=1)[:, max(0, sims.shape[1] - k)]
                i, j = np.nonzero((sims >= bar[:, None]) & np.isfinite(sims))
                order = np.lexsort([ids[j], -sims[i, j], i])
                i, j = i[order], j[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                for c, v in zip(out, (q[i[keep]], ids[j[keep]], sims[i[keep], j[keep]]), strict=True):
                    c.append(v)
        q, i, s = (np.concatenate(c) if c else np.empty(0) for c in out)
        return pa.table({"q": pa.array(q, pa.int64(), from_pandas=False) if len(q) else pa.array([], pa.int64()), "id": pa.array(i, pa.int64()) if len(i) else pa.array([], pa.int64()), "sim": pa.array(s, pa.float64())})

    return left.groupBy("cell", "a", "b").cogroup(right.groupBy("cell", "a", "b")).applyInArrow(meet, "q bigint, id bigint, sim double")


def first_k(found: DataFrame, k: int) -> DataFrame:
    """The planner keeps the first k of each task before it deals rows out by query."""
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def nearest(rows: DataFrame, asked: DataFrame, k: int = 12, exact: bool = False, target: float = 0.97, digits: int = 6, cells: int | None = None) -> DataFrame:
    """(q, id, sim, place): for each of ``asked`` (q, x) the k rows (id, vector) of the highest cosine, rounded; equal ones by id; never itself.

    Every row goes into the cell of its nearest centroid; centroids are fitted on about SAMPLE rows, taken by a hash of the
    id. There are about as many cells as the square root of the rows, up to CELLS. A query probes its nearest cells: as many
    as hold ``target`` of the nearest in the sample. With ``exact`` those lists only set a floor, and a second pass
    probes each other cell that could hold something better: what a cell holds is no nearer to the query than the angle
    to its centroid less the cell's widest angle. Where vectors form clusters most cells drop out; where they
    are all alike none does, and the exact answer costs all products, dealt out by cell.

    Vectors that are missing, of another size or without length have cosine 0 with all; they are a cell of their own. Ids are whole numbers; null ids are left out.
    """
    ship(rows.sparkSession)
    rows = rows.toDF("id", "vector").where("id IS NOT NULL").withColumn("id", F.col("id").cast("bigint"))
    asked = asked.toDF("q", "x").where("q IS NOT NULL").withColumn("q", F.col("q").cast("bigint"))
    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // SAMPLE)))) == 0)
    most = some.where("size(vector) > 0").groupBy(F.size("vector").alias("s")).count().orderBy(F.desc("count"), "s").first()
    size = most["s"] if most else 0
    sample = units(some.orderBy("id").select("vector").limit(2 * SAMPLE).toArrow().column(0), size)
    centres = fitted(sample, cells or min(CELLS, max(1, round(n**0.5))))
    nprobe = probes_for(sample, centres, k, target)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sims = (x := units(b.column(1), size)) @ centres.T
            cell = np.where(np.abs(x).sum(axis=1) > 0, sims.argmax(axis=1), -1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int64()), pa.array(np.arccos(np.clip(sims.max(axis=1), -1, 1)))], names=["id", "vector", "cell", "angle"])

    kind = dict(rows.dtypes)["vector"]
    indexed = written(spread(rows).mapInArrow(assign, f"id bigint, vector {kind}, cell bigint, angle double"), "cells")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = np.argsort(-(units(b.column(1), size) @ centres.T), axis=1, kind="stable")[:, :nprobe]
            at = np.repeat(np.arange(len(b)), order.shape[1])
            yield pa.RecordBatch.from_arrays([c.take(pa.array(at)) for c in b.columns] + [pa.array(order.ravel(), pa.int64())], names=["q", "x", "cell"])

    asked_kind = dict(asked.dtypes)["x"]
    probes = written(asked.mapInArrow(probe, f"q bigint, x {asked_kind}, cell bigint"), "probes")
    found = met(indexed, probes, size, k, digits)
    if not exact:
        return first_k(found, k)
    found = written(first_k(found, k).drop("place"), "floors")
    widest = {r["cell"]: r["a"] for r in indexed.groupBy("cell").agg(F.max("angle").alias("a")).collect()}  # a row a cell
    width = np.array([widest.get(i, -1.0) for i in range(len(centres))])
    floors = found.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).alias("floor"))
    again = asked.join(floors, "q", "left").select("q", "x", F.coalesce("floor", F.lit(-2.0)).alias("floor"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sims = units(b.column(1), size) @ centres.T
            first = np.argsort(-sims, axis=1, kind="stable")[:, :nprobe]
            best = np.cos(np.maximum(0, np.arccos(np.clip(sims, -1, 1)) - width[None, :]))
            floor = b.column(2).to_numpy()[:, None] - 2 * 10.0**-digits
            open_ = (best >= floor) & (width >= 0)[None, :]
            np.put_along_axis(open_, first, False, axis=1)
            i, cell = np.nonzero(np.concatenate([open_, (floor <= 0) if -1 in widest else np.zeros_like(floor, bool)], axis=1))
            cell = np.where(cell == len(centres), -1, cell)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i)), pa.array(cell, pa.int64())], names=["q", "x", "cell"])

    more = written(again.mapInArrow(rest, f"q bigint, x {asked_kind}, cell bigint"), "more-probes")
    return first_k(found.unionByName(met(indexed, more, size, k, digits)), k)
