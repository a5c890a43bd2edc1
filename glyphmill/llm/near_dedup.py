"""Near-dedup with bottom-k sketches from one hash function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import materialize, read, text_of
from glyphmill.llm.components import components
from glyphmill.llm.shingles import Shingler, mixed, set_id
from glyphmill.llm.stream import by_group

WORDS = 5
SIMILARITY = 80
SKETCH = 96
MISS = 1e-8
#: Members and bytes of sets that a block of a group has, about; two blocks meet in a task.
BLOCK, BLOCK_BYTES = 700, 32 << 20
#: Up to so many ids are broadcast to find their texts again; more are joined.
BROADCAST_IDS = 1_000_000


def no_run(k: int, p: float, r: int) -> float:
    """Probability that k trials of chance p have no r successes in a row."""
    state = np.zeros(r)
    state[0] = 1
    for _ in range(k):
        state = np.concatenate([[(1 - p) * state.sum()], p * state[:-1]])
    return float(state.sum())


def run_lengths(percent: int, k: int = SKETCH) -> tuple[int, int]:
    """Lengths of runs of retained values that linked sets share: for unions under 20 elements, and for others.

    Two linked sets differ in at most (100 - percent) % of their union. In the order of the hash the
    differences cut the common elements into runs, so the longest has at least g(union) elements;
    for sketches of large sets the chance that none of r elements occurs stays under MISS.
    """
    apart = lambda u: (100 - percent) * u // 100
    g = lambda u: -(-(u - apart(u)) // (apart(u) + 1))
    small = min([g(u) for u in range(1, 20) if apart(u)], default=1)
    big = min(g(u) for u in range(20, 2000))
    while big > 1 and no_run(k, percent / 100, big) > MISS:
        big -= 1
    return max(1, small), max(1, big)


def run_keys(sketch: np.ndarray, n: int, lengths: tuple[int, int], percent: int) -> np.ndarray:
    """Hashes of the runs of consecutive retained values by which a set is listed."""
    out = []
    if n * percent <= 2000:
        out.append(lengths[0])
    if n * 100 >= 20 * percent:
        out.append(lengths[1])
    keys = []
    for r in dict.fromkeys(out):
        if len(sketch) >= r:
            key = np.full(len(sketch) - r + 1, r, np.uint64)
            for j in range(r):
                key = mixed(key + sketch[j : len(sketch) - r + 1 + j])
            keys.append(key)
    return np.unique(np.concatenate(keys)) if keys else np.empty(0, np.uint64)


def find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def linked(sets: list[np.ndarray], percent: int, left: int | None = None, k: int = SKETCH) -> list[tuple[int, int]]:
    """Links that join what all links between the sets join; with ``left``, of pairs of one of the first ``left`` and one other.

    Overlaps of the sketches come from the inverted lists of retained values (a product of 0/1
    matrices over the values that occur twice). Below the smaller of two sketches' largest values
    both are complete, so overlap over union there estimates the similarity; pairs more than six
    standard errors under the threshold go. The others are verified on the full sets, likeliest
    first, unless earlier links already join them.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    sketches = [s[:k] for s in sets]
    flat = np.concatenate(sketches)
    values, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(s) for s in sketches])
    often = times > 1
    new = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], new[column[keep]]
    overlap = np.zeros((m, m), np.float32)
    for a in range(0, int(often.sum()), 4096):
        part = (column >= a) & (column < a + 4096)
        x = np.zeros((m, 4096), np.float32)
        x[row[part], column[part] - a] = 1
        overlap += x @ x.T
    i, j = np.nonzero(np.triu(overlap, 1))
    if left is not None:
        cross = (i < left) & (j >= left)
        i, j = i[cross], j[cross]
    fits = np.minimum(size[i], size[j]) * 100 >= np.maximum(size[i], size[j]) * percent
    i, j = i[fits], j[fits]
    if not len(i):
        return []
    whole = np.array([len(s) <= k for s in sets])
    last = np.array([s[min(k, len(s)) - 1] for s in sets])
    limit = np.where(whole, np.iinfo(np.uint64).max, last)
    top = np.minimum(limit[i], limit[j])
    below = lambda who: np.array([np.searchsorted(sketches[w], t, "right") for w, t in zip(who.tolist(), top, strict=True)])
    uncut = whole[i] & whole[j]
    count_i, count_j = size[i].copy(), size[j].copy()
    if not uncut.all():
        cut = np.flatnonzero(~uncut)
        top = top[cut]
        count_i[cut], count_j[cut] = below(i[cut]), below(j[cut])
    o = overlap[i, j]
    union = count_i + count_j - o
    estimate = o / union
    t = percent / 100
    good = np.flatnonzero(estimate >= np.where(uncut, t - 1e-6, t - 6 * np.sqrt(t * (1 - t) / union)))
    parent, out = list(range(m)), []
    for p in good[np.argsort(-estimate[good], kind="stable")].tolist():
        x, y = int(i[p]), int(j[p])
        a, b = find(parent, x), find(parent, y)
        if a == b:
            continue
        common = int(o[p]) if uncut[p] else len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
            parent[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """Per row of ``df``: the id, ``n_shingles``, ``component_id``, ``kept``.

    Documents whose sets of distinct ``words``-word shingles have a Jaccard similarity of at least
    ``similarity`` percent are linked; a component's smallest id names it and that document stays.

    Equal sets become one representative first, so copies never meet as pairs. Each representative
    is listed under the runs of consecutive values in its bottom-k sketch (``run_lengths`` says why
    linked sets share one). A list's smallest id is its pivot; a pivot's group is all that its lists
    hold, so any two that share a list meet in a group, and the rows dealt out are one a list member
    at most. Inside groups ``linked`` finds overlaps, estimates and verifies, and emits a spanning
    forest. A group that is more than a block (BLOCK members, BLOCK_BYTES) meets its pivot first, pair by pair: what is linked to the
    pivot need not meet each other. The rest is cut into blocks, which meet each other and the
    blocks of the linked ones, every pair of blocks in a task of its own, so no task holds the group
    and a group of copies of one text costs a row a member.

    Sets are of 64-bit shingle hashes; verification is exact on them. Ids are whole numbers. Rows that
    repeat an id are one document, linked with whatever one of its texts is linked with; n_shingles is each row's own. A null id is its own component and stays (component_id null,
    kept false). Null texts count as empty; texts without words have no shingles and no links. Other
    columns aren't read; an empty table gives an empty result.
    """
    lengths = run_lengths(similarity)
    base = df.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(words)
        for b in batches:
            sets = [of(t) for t in b.column(1).to_pylist()]
            keys = [run_keys(s[:SKETCH], len(s), lengths, similarity).view(np.int64) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.binary()), lists], names=["id", "n", "sid", "keys"])

    sets = materialize(base.mapInArrow(scan, "id bigint, n bigint, sid binary, keys array<bigint>"), "sketches")
    reps = sets.where("n > 0 AND id IS NOT NULL").groupBy("sid").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    members = reps.select("rep", "n", F.explode("keys").alias("key"))
    lists = members.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("_most")).where("pivot < _most").select("key", "pivot")
    groups = materialize(members.join(lists, "key").groupBy("pivot", "rep").agg(F.max("n").alias("n")), "groups")
    ids = groups.select(F.col("rep").alias("id")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(words)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["rep", "set"])

    full = base.join(ids, "id").mapInArrow(again, "rep bigint, set binary").withColumn("_s", F.xxhash64("set"))
    full = materialize(full.dropDuplicates(["rep", "_s"]).drop("_s"), "sets")
    blocks_of = lambda count, size: F.ceil(F.greatest(F.col(count) / BLOCK, F.col(size) * 8 / BLOCK_BYTES)).cast("int")
    sizes = groups.groupBy("pivot").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size")).withColumn("nb", blocks_of("m", "size"))
    large = materialize(sizes.where("nb > 1").select("pivot"), "large-groups")

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True)) if min(len(p), len(q)) * 100 >= max(len(p), len(q)) * similarity else 0
                hit.append(100 * common >= similarity * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit, pa.bool_())], names=["pivot", "rep", "near"])

    rays = groups.join(large, "pivot").join(full, "rep").join(full.select(F.col("rep").alias("pivot"), F.col("set").alias("first")), "pivot").select("pivot", "rep", "first", "set")
    rays = materialize(rays.mapInArrow(star, "pivot bigint, rep bigint, near boolean").groupBy("pivot", "rep").agg(F.max("near").alias("near")), "rays")
    small = groups.join(large, "pivot", "left_anti").select("pivot", "rep", F.lit(0).alias("mine"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    far = F.when(~F.col("near"), 1).otherwise(0)
    cut = groups.join(rays, ["pivot", "rep"])
    per = cut.groupBy("pivot").agg(F.sum(far).alias("fm"), F.sum(far * F.col("n")).alias("fs"), F.sum(1 - far).alias("nm"), F.sum((1 - far) * F.col("n")).alias("ns"))
    per = per.select("pivot", blocks_of("fm", "fs").alias("fb"), blocks_of("nm", "ns").alias("nb")).where("fb > 0")  # no far member: nothing left to meet
    cut = cut.join(per, "pivot").withColumn("mine", F.when(F.col("near"), F.col("fb") + F.pmod(F.xxhash64("rep"), F.col("nb"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("fb"))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("near"), F.col("fb") - 1).otherwise(F.col("fb") + F.col("nb") - 1)))
    cut = cut.withColumn("other", other).select("pivot", "rep", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    placed = small.unionByName(cut).select("pivot", "lo", "hi", "rep", "mine")

    def meet(key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        _, lo, hi = key
        at = np.argsort(np.array(rows.column("mine").to_pylist()), kind="stable")
        rep = rows.column("rep").to_numpy()[at]
        data = rows.column("set").to_pylist()
        arrays = [np.frombuffer(data[x], np.uint64) for x in at.tolist()]
        left = None if lo == hi else int((rows.column("mine").to_numpy() == lo).sum())
        if len(rep) > 1 and left not in (0, len(rep)):
            found = linked(arrays, similarity, left)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(rep[list(a)]), pa.array(rep[list(b)])], names=["a", "b"])

    links = by_group(placed.join(full, "rep"), ["pivot", "lo", "hi"], meet, "a bigint, b bigint")
    links = links.unionByName(rays.where("near AND pivot < rep").select(F.col("pivot").alias("a"), F.col("rep").alias("b")))
    # Rows of one id with different texts: their sets' representatives are linked.
    several = sets.where("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min(F.xxhash64("sid")).alias("x"), F.max(F.xxhash64("sid")).alias("y")).where("x <> y").select("id")
    one = sets.where("n > 0").join(several, "id").select("id", "sid").distinct().join(reps.select("sid", "rep"), "sid")
    links = links.unionByName(one.select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")).where("a < b"))
    found = components(links)
    named = sets.join(reps.select("sid", "rep"), "sid", "left").select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("rep")).otherwise(F.col("id")).alias("rep"))
    out = named.join(found, F.col("rep") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"), words=3, similarity=85)
