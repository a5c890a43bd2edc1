"""SimHash near-dedup: fingerprints of word shingles, linked by a self-join over binary tries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import materialize, read, text_of
from glyphmill.llm.components import components
from glyphmill.llm.lattice import word_bytes

WORDS = 3
BITS = 3
SEED = 42
#: Shingles whose hashes are held at once.
SLICE = 1 << 16
#: Fingerprints of a unit of work, at most, unless it can't be split any more.
UNIT = 50_000
#: Levels by which a larger node of a trie is split.
STEP = 6
#: Node pairs that are held at once.
FRONT = 1 << 20
#: Fingerprints of a task that are joined together, about.
WINDOW = 200_000

LANES = np.uint64(0x0101010101010101)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest first: eight counters in eight bytes of a word, up to 255 rows at a time."""
    total = np.zeros(64, np.int64)
    at = np.arange(0, len(h), 255)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & LANES, at).view(np.uint8).reshape(-1, 8)
        total[k::8] += lanes.sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str, words: int = WORDS) -> int:
    """Bit b is 1 if over half of the text's shingles, repeats included, have it in their XXH64."""
    found = word_bytes(text.encode("utf-8", "surrogatepass"))
    if not found:
        return 0
    joined, n = b" ".join(found), min(words, len(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[: len(found) - n + 1].tolist(), ends[n - 1 :].tolist()
    total, hashed = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for a in range(0, len(first), SLICE):
        part = [hashed(joined[i:j], SEED) for i, j in zip(first[a : a + SLICE], last[a : a + SLICE], strict=True)]
        total += bit_counts(np.array(part, np.uint64))
    return int(sum(1 << b for b in np.flatnonzero(2 * total > len(first)).tolist()))


class Forest:
    """Binary tries over sorted 64-bit keys: a node at depth d is a range of keys of one unit that agree in their first d bits."""

    def __init__(self, keys: np.ndarray, bits: int):
        self.keys, self.bits, self.ones = keys, bits, {}
        self.label = np.arange(len(keys))

    def cut(self, lo: np.ndarray, hi: np.ndarray, d: int) -> np.ndarray:
        """Where the keys with bit d begin in nodes at depth d; they come last, so counting them is enough."""
        if d not in self.ones:
            bit = (self.keys >> np.uint64(63 - d)) & np.uint64(1)
            self.ones[d] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        return hi - (self.ones[d][hi] - self.ones[d][lo])

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the classes of a and b; a class's label is its smallest member."""
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            np.minimum.at(self.label, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up

    def join(self, depth: int, lo1: np.ndarray, hi1: np.ndarray, lo2: np.ndarray, hi2: np.ndarray, spent: np.ndarray) -> None:
        """Link all leaves under pairs of nodes at ``depth`` that differ in at most ``bits`` bits, ``spent`` of them above.

        Pairs go down together. A pair (or a node with itself) gives the pairs of its children: those on one side keep
        the bits spent, those on two sides spend one more, and a pair that spends more than the budget is
        cut with all below it. A node with one leaf stands for the rest of its path, so a pair of two such nodes ends there.
        """
        stack = [(depth, lo1, hi1, lo2, hi2, spent)]
        while stack:
            d, a0, a1, b0, b1, e = stack.pop()
            if len(a0) > FRONT:
                half = len(a0) // 2
                stack += [(d, *(x[:half] for x in (a0, a1, b0, b1, e))), (d, *(x[half:] for x in (a0, a1, b0, b1, e)))]
                continue
            single = (a1 - a0 == 1) & (b1 - b0 == 1)
            if single.any():
                x, y = a0[single], b0[single]
                near = np.bitwise_count(self.keys[x] ^ self.keys[y]) <= self.bits
                self.link(x[near], y[near])
                a0, a1, b0, b1, e = (v[~single] for v in (a0, a1, b0, b1, e))
            if not len(a0) or d == 64:
                continue
            a, b = self.cut(a0, a1, d), self.cut(b0, b1, d)
            same = a0 == b0
            parts = [(a0, a, b0, b, e), (a, a1, b, b1, e), (a0, a, b, b1, e + 1)]
            parts.append(tuple(v[~same] for v in (a, a1, b0, b, e + 1)))  # a node with itself has this pair already
            w = [np.concatenate(c) for c in zip(*parts, strict=True)]
            keep = (w[0] < w[1]) & (w[2] < w[3]) & (w[4] <= self.bits) & ~((w[0] == w[2]) & (w[1] - w[0] == 1))
            stack.append((d + 1, *(v[keep] for v in w)))


def top(c: Column, depth: Column | int) -> Column:
    """The first ``depth`` bits of a 64-bit number, the others 0."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth >= 64, c).otherwise(c.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("bigint"), (F.lit(64) - depth).cast("int"))))


def units(turned: DataFrame, bits: int, unit: int) -> DataFrame:
    """(turn, key, rep, lo, hi, depth, side): each fingerprint in each unit of work that needs it.

    A unit is a node of a trie with itself (lo = hi), or two nodes at one depth that differ in at most ``bits`` bits. The
    first units are the nodes below the block that must agree. One with more than ``unit``
    keys becomes the pairs of its descendants STEP levels down, level by level, as joins
    of node counts; the tables of nodes have about (keys / unit) * 2^STEP rows.
    """
    block = 64 // (bits + 1)
    first = turned.withColumn("lo", top(F.col("key"), block))
    counts = first.groupBy("turn", "lo").agg(F.count(F.lit(1)).alias("n"))
    large = materialize(counts.where(F.col("n") > unit).select("turn", "lo", F.col("lo").alias("hi")), "trie-large")
    small = first.join(large.select("turn", "lo"), ["turn", "lo"], "left_anti") if not large.isEmpty() else first
    out = small.select("turn", "key", "rep", "lo", F.col("lo").alias("hi"), F.lit(block).alias("depth"), F.lit(0).alias("side"))
    depth, active = block, large
    while not active.isEmpty():
        below = min(64, depth + STEP)
        nodes = active.select("turn", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("node")).distinct()
        of = turned.withColumn("node", top(F.col("key"), depth)).join(nodes, ["turn", "node"])
        kids = materialize(of.groupBy("turn", "node", top(F.col("key"), below).alias("kid")).agg(F.count(F.lit(1)).alias("n")), "trie-nodes")
        left = kids.select("turn", F.col("node").alias("lo"), F.col("kid").alias("lo2"), F.col("n").alias("n1"))
        right = kids.select("turn", F.col("node").alias("hi"), F.col("kid").alias("hi2"), F.col("n").alias("n2"))
        pairs = active.join(left, ["turn", "lo"]).join(right, ["turn", "hi"])
        pairs = pairs.where((F.bit_count(F.col("lo2").bitwiseXOR(F.col("hi2"))) <= bits) & ((F.col("lo") != F.col("hi")) | (F.col("lo2") <= F.col("hi2"))))
        alone = F.col("lo2") == F.col("hi2")
        n = F.col("n1") + F.when(alone, 0).otherwise(F.col("n2"))
        pairs = materialize(pairs.where(~alone | (F.col("n1") > 1)).select("turn", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), ((n > unit) & F.lit(below < 64)).alias("more")), "trie-pairs")
        done = pairs.where("NOT more").drop("more")
        sides = done.select("turn", "lo", "hi", F.col("lo").alias("node"), F.lit(0).alias("side"))
        sides = sides.unionByName(done.where("lo <> hi").select("turn", "lo", "hi", F.col("hi").alias("node"), F.lit(1).alias("side")))
        dealt = turned.withColumn("node", top(F.col("key"), below)).join(sides, ["turn", "node"])
        out = out.unionByName(dealt.select("turn", "key", "rep", "lo", "hi", F.lit(below).alias("depth"), "side"))
        depth, active = below, pairs.where("more").drop("more")
    return out


def trie_links(fingerprints: DataFrame, bits: int = BITS, unit: int = UNIT) -> DataFrame:
    """(a, b): links that join what all pairs of (``key``, ``rep``) within ``bits`` differing bits join. Keys are distinct.

    Two keys that differ in at most ``bits`` bits agree wholly in one of ``bits + 1`` blocks. So each key
    goes into that many tries, each with another block turned to the top, and there nodes
    are only joined with nodes of the same block: its bits get no budget. That deals the tries out
    by block; ``units`` cuts those nodes that hold too much. In a task many units are joined
    level by level at once, and each class found gives one link a member, not its pairs.
    """
    block = 64 // (bits + 1)
    # Spark's numbers are signed: the turned keys compare as unsigned in numpy.
    turned = fingerprints.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(bits))))
    by = F.col("turn") * block
    key = F.when(by == 0, F.col("key")).otherwise(F.call_function("shiftleft", F.col("key"), by).bitwiseOR(F.call_function("shiftrightunsigned", F.col("key"), F.lit(64) - by)))
    turned = turned.withColumn("key", key)

    def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
        c = {n: t.column(n).to_numpy() for n in ("turn", "lo", "hi", "depth", "side", "rep")}
        keys = t.column("key").to_numpy().view(np.uint64)
        order = np.lexsort([keys, c["side"], c["hi"], c["lo"], c["depth"], c["turn"]])
        c, keys = {n: v[order] for n, v in c.items()}, keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = (c["turn"][1:] != c["turn"][:-1]) | (c["depth"][1:] != c["depth"][:-1]) | (c["lo"][1:] != c["lo"][:-1]) | (c["hi"][1:] != c["hi"][:-1])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(keys))
        sides = np.concatenate([[0], np.cumsum(c["side"])])
        middle = end - (sides[end] - sides[start])
        forest = Forest(keys, bits)
        for d in np.unique(c["depth"]).tolist():
            at = c["depth"][start] == d
            one = at & (middle == end) & (end - start > 1)
            two = at & (middle < end) & (middle > start)
            s, m, e = start[one], end[one], start[two]
            spent = np.bitwise_count((c["lo"][e] ^ c["hi"][e]).view(np.uint64)).astype(np.int64)
            forest.join(d, np.append(s, e), np.append(m, middle[two]), np.append(s, middle[two]), np.append(m, end[two]), np.append(np.zeros(len(s), np.int64), spent))
        moved = np.flatnonzero(forest.label != np.arange(len(keys)))
        yield pa.RecordBatch.from_arrays([pa.array(c["rep"][forest.label[moved]]), pa.array(c["rep"][moved])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if n >= WINDOW:  # cut between units
                turn, lo, hi, depth = (b.column(k).to_numpy() for k in (0, 1, 2, 3))
                last = held[-1]
                other = np.flatnonzero((turn != last.column(0)[-1].as_py()) | (lo != last.column(1)[-1].as_py()) | (hi != last.column(2)[-1].as_py()) | (depth != last.column(3)[-1].as_py()))
                if len(other):
                    held.append(b.slice(0, int(other[0])))
                    yield from flush(pa.Table.from_batches(held))
                    b, held, n = b.slice(int(other[0])), [], 0
            held.append(b)
            n += len(b)
        if n:
            yield from flush(pa.Table.from_batches(held))

    dealt = units(turned, bits, unit).select("turn", "lo", "hi", "depth", "side", "key", "rep")
    dealt = dealt.repartition("turn", "lo", "hi", "depth").sortWithinPartitions("turn", "lo", "hi", "depth")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS, unit: int = UNIT) -> DataFrame:
    """Per row of ``df``: the id, ``fingerprint`` (16 lowercase hex digits) and ``component_id``.

    Shingles are ``words`` words of the whole text with A-Z lower-cased, repeats included; a shorter text
    is one shingle. Fingerprints that differ in at most ``bits`` bits link all documents that
    have them; a component's smallest id names it. Equal fingerprints become one first, in a combined
    aggregation, so a group of copies of any size is one leaf of the tries. ``bits`` is 1 to 15.

    Ids are whole numbers. Null texts count as empty; texts without words have fingerprint zero and are linked like
    any other. A row with a null id gets its fingerprint, links nothing and has component_id null. Rows that repeat
    an id are one document: what any of its texts is linked with is one component. Other columns aren't read; an
    empty table gives an empty result.
    """
    if not 1 <= bits <= 15:
        raise ValueError("bits is from 1 to 15")
    base = df.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["id", "key"])

    prints = materialize(base.mapInArrow(scan, "id bigint, key bigint"), "fingerprints")
    leaves = materialize(prints.where("id IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep")), "leaves")
    links = trie_links(leaves, bits, unit)
    # Rows of one id with different texts: their fingerprints' representatives are linked.
    several = prints.where("id IS NOT NULL").groupBy("id").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select("id")
    one = prints.join(several, "id").select("id", "key").distinct().join(leaves, "key")
    links = links.unionByName(one.select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")).where("a < b"))
    named = prints.join(leaves, "key", "left").join(components(links), F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep"))
    return named.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("key"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(read(spark, sf_dir, "documents"))
