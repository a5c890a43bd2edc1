"""Prefix trie of conversations: radix partitioning by the turn ids from the front, quicksort by turn in what is left."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm.common import materialize, read, text_of
from glyphmill.sources.tables import numbered

#: Conversations are rebuilt in groups of so many ids; h is below HEADS.
GROUP, HEADS = 100, 6
#: Different sequences and turns of a bucket that one task finishes; a single sequence always is.
BUCKET, BUCKET_TURNS = 20_000, 1_000_000
#: Turns of a sequence that one row holds; longer ones go in several parts, one after the other.
PART = 100_000
NOTHING = hashlib.sha256(b"").hexdigest()

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, bucket bigint"


def coded_turns(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(id, turn, digest, code, n): every turn with its number in the dictionary of distinct (role, text), and its code points."""
    role, text = text_of(role_col), text_of(text_col)
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(turn_col).cast("bigint").alias("turn"), digest.alias("digest"), F.length(text).cast("bigint").alias("n"))
    turns = materialize(turns, "turns")
    codes = materialize(turns.select("digest").distinct().withColumn("code", F.monotonically_increasing_id()), "turn-codes")
    return materialize(turns.join(codes, "digest"), "coded-turns")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(id, part, codes, lens, last): rebuilt sequences in parts of PART turns, all full but the last. A turnless one has one empty part.

    Turns go by turn (null first), equal ones by the digest of role and text. A conversation of up to PART / 2
    turns is one row of one aggregation; a longer one is numbered by ranges of its turns, so not even its turns meet in one task.
    """
    h = F.crc32(F.col("id").cast("string")) % HEADS
    base = F.col("id") - F.col("id") % GROUP
    long = turns.groupBy("id").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > PART // 2).select("id")
    long = materialize(long, "long-conversations")
    some_long = not long.isEmpty()
    short = turns.join(long, "id", "left_anti") if some_long else turns
    own = short.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "code", "n"))).alias("own"))
    own = own.select("id", F.col("own.code").alias("codes"), F.col("own.n").alias("lens"))
    first = lambda c: F.slice(c, 1, HEADS - 1)
    heads = own.where(F.col("id") % GROUP == 0).select(F.col("id").alias("base"), first("codes").alias("head"), first("lens").alias("head_lens"))
    if some_long:
        ordered = turns.join(long, "id").withColumn("order", F.coalesce(F.col("turn"), F.lit(-(1 << 63))))
        placed = materialize(numbered(ordered, "order", "place", ["id"], ["digest"]), "placed-turns")
        of = placed.where((F.col("place") < HEADS - 1) & (F.col("id") % GROUP == 0)).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "code", "n"))).alias("own"))
        heads = heads.unionByName(of.select(F.col("id").alias("base"), F.col("own.code").alias("head"), F.col("own.n").alias("head_lens")))
    heads = materialize(heads, "heads")
    none = F.array().cast("array<bigint>")
    known = own.withColumns({"h": h.cast("int"), "base": base}).join(heads, "base", "left")
    glued = lambda head, rest: F.concat(F.slice(F.coalesce(head, none), F.lit(1), F.col("h")), F.slice(rest, F.col("h") + 1, F.greatest(F.size(rest), F.lit(1))))
    out = known.select("id", F.lit(0).alias("part"), glued(F.col("head"), F.col("codes")).alias("codes"), glued(F.col("head_lens"), F.col("lens")).alias("lens"), F.lit(True).alias("last"))
    if some_long:
        sizes = placed.groupBy("id").agg(F.count(F.lit(1)).alias("m")).withColumns({"h": h.cast("int"), "base": base}).join(heads, "base", "left")
        sizes = materialize(sizes.withColumn("from", F.least(F.col("h"), F.size(F.coalesce("head", none)))).withColumn("total", F.col("from") + F.col("m") - F.col("h")), "long-sizes")
        rows = placed.join(sizes.select("id", "h", "from", "total"), "id").where("place >= h").select("id", (F.col("place") - F.col("h") + F.col("from")).alias("place"), "code", "n", "total")
        front = sizes.select("id", "total", F.posexplode(F.slice(F.arrays_zip("head", "head_lens"), F.lit(1), F.col("from"))).alias("place", "x"))
        rows = rows.unionByName(front.select("id", F.col("place").cast("bigint").alias("place"), F.col("x.head").alias("code"), F.col("x.head_lens").alias("n"), "total"))
        parts = rows.groupBy("id", F.floor(F.col("place") / PART).cast("int").alias("part")).agg(F.sort_array(F.collect_list(F.struct("place", "code", "n"))).alias("own"), F.first("total").alias("total"))
        out = out.unionByName(parts.select("id", "part", F.col("own.code").alias("codes"), F.col("own.n").alias("lens"), (F.col("total") <= (F.col("part") + 1).cast("bigint") * PART).alias("last")))
    return out


def end_lists(members: DataFrame) -> DataFrame:
    """(root, key, ends): SHA-256 of the decimal ids, ascending and joined by commas, of the members that end in each class.

    SHA-256 takes its input in order, so a class's ids pass through one task, sorted by Spark and never held: 8 bytes each.
    """

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        root, key, ends = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(root, pa.int64()), pa.array(key, pa.binary()), pa.array(ends, pa.string())], names=["root", "key", "ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out = None, hashlib.sha256(), []
        for b in batches:
            start, roots, keys, ids = 0, *(c.to_pylist() for c in b.columns)
            cuts = [i for i in range(1, len(ids)) if keys[i] != keys[i - 1] or roots[i] != roots[i - 1]]
            for start, end in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                part = ",".join(map(str, ids[start:end])).encode()
                if (roots[start], keys[start]) == now:
                    sha.update(b"," + part)
                else:
                    if now:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (roots[start], keys[start]), hashlib.sha256(part)
            if len(out) >= 10_000:
                yield batch(out)
                out = []
        if now:
            yield batch([*out, (*now, sha.hexdigest())])

    dealt = members.where("last").select("root", "key", "id").repartition("root", "key").sortWithinPartitions("root", "key", "id")
    return dealt.mapInArrow(run, "root bigint, key binary, ends string")


class Bucket:
    """The nodes of some sequences that share their first ``depth`` + 1 turns, by multikey quicksort."""

    def __init__(self, rows: list[tuple], depth: int):
        """rows: (codes, lens, members, smallest member, ends or None, children, leaves, saved) of each class; the last three are of what goes on in the next part."""
        self.rows = rows
        self.depth, self.parent, self.tokens, self.n, self.first, self.ends = [], [], [], [], [], []
        self.children, self.leaves, self.saved = [], [], []
        # Each entry sorts classes that agree up to a depth, below a node.
        todo = [(list(range(len(rows))), depth, -1)]
        while todo:
            which, d, up = todo.pop()
            if len(which) == 1:
                self.chain(which[0], d, up)
                continue
            goes_on = [i for i in which if len(rows[i][0]) > d]
            if not goes_on:
                continue
            v = rows[goes_on[len(goes_on) // 2]][0][d]
            less, same, more = [], [], []
            for i in goes_on:
                c = rows[i][0][d]
                (same if c == v else less if c < v else more).append(i)
            if less:
                todo.append((less, d, up))
            if more:
                todo.append((more, d, up))
            node = self.open(d + 1, up, rows[same[0]][1][d], sum(rows[i][2] for i in same), min(rows[i][3] for i in same))
            for i in same:
                if len(rows[i][0]) == d + 1:
                    self.close(node, i)
            todo.append((same, d + 1, node))
        for i in range(len(self.depth) - 1, -1, -1):  # children come after their parents
            self.leaves[i] = self.leaves[i] or 1
            self.saved[i] += (self.n[i] - 1) * self.tokens[i]
            if (p := self.parent[i]) >= 0:
                self.children[p] += 1
                self.leaves[p] += self.leaves[i]
                self.saved[p] += self.saved[i]

    def open(self, depth: int, up: int, tokens: int, n: int, first: int) -> int:
        for c, v in zip((self.depth, self.parent, self.tokens, self.n, self.first, self.ends, self.children, self.leaves, self.saved), (depth, up, tokens, n, first, NOTHING, 0, 0, 0), strict=True):
            c.append(v)
        return len(self.depth) - 1

    def close(self, node: int, i: int) -> None:
        """Class i is what ends at the node, or goes on in another part."""
        _, _, _, _, ends, children, leaves, saved = self.rows[i]
        self.ends[node] = ends or NOTHING
        self.children[node] += children
        self.leaves[node] += leaves
        self.saved[node] += saved

    def chain(self, i: int, d: int, up: int) -> None:
        codes, lens, n, first = self.rows[i][:4]
        for j in range(d, len(codes)):
            up = self.open(j + 1, up, lens[j], n, first)
        if len(codes) > d:
            self.close(up, i)


def finished(local: DataFrame, depth0: int) -> DataFrame:
    """Nodes of local buckets (``bucket``, ``code``, ``d``: what they share); those right below the bucket carry its number."""

    def nodes(now: tuple, d: int, up: int, rows: list[tuple]) -> Iterator[tuple]:
        trie = Bucket(rows, d)
        for i, p in enumerate(trie.parent):
            yield trie.first[i], depth0 + trie.depth[i], up if p < 0 else trie.first[p], trie.n[i], trie.children[i], trie.leaves[i], trie.saved[i], trie.ends[i], now[0] if p < 0 else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, of, rows = None, None, []
        for b in batches:
            for bucket, code, d, first, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (bucket, code) != now:
                    if rows:
                        yield from nodes(now, *of, rows)
                    now, of, rows = (bucket, code), (d, first), []
                rows.append(tuple(row))
        if rows:
            yield from nodes(now, *of, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = each(batches)
        while part := list(islice(found, 5_000)):
            columns = zip(zip(*part, strict=True), [pa.int64()] * 7 + [pa.string(), pa.int64()], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=[c.split()[0] for c in NODE.split(", ")])

    dealt = local.select("bucket", "code", "d", "bucket_first", "codes", "lens", "n", "first", "ends", "children", "leaves", "saved")
    return dealt.repartition("bucket", "code").sortWithinPartitions("bucket", "code").mapInArrow(run, NODE)


def chains(active: DataFrame, sums: DataFrame, depth0: int) -> DataFrame:
    """The nodes from a large bucket's parent down to where its sequences part; ``sums`` is of what hangs below its last node."""
    whole = active.join(sums.withColumnRenamed("bucket", "b"), F.col("bucket") == F.col("b"), "left").drop("b")
    whole = whole.withColumns({c: F.coalesce(c, F.lit(0)) + F.coalesce(f"sum_{c}", F.lit(0)) for c in ("children", "leaves", "saved")})
    each = whole.select("*", F.posexplode("chain").alias("at", "tokens"), (F.size("chain") - 1).alias("end"))
    below = F.sum((F.col("n") - 1) * F.col("tokens")).over(W.partitionBy("bucket").orderBy(F.desc("at")))
    last, top = F.col("at") == F.col("end"), F.col("at") == 0
    return each.select(
        F.col("first").alias("conv_id"), (F.lit(depth0 + 1) + F.col("d") + F.col("at")).cast("bigint").alias("depth"), F.when(top, F.col("parent_first")).otherwise(F.col("first")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(1).cast("bigint").alias("n_children"), F.greatest("leaves", F.lit(1)).cast("bigint").alias("n_leaves"), (F.col("saved") + below).cast("bigint").alias("saved_tokens"),
        F.when(last, F.coalesce("ends", F.lit(NOTHING))).otherwise(NOTHING).alias("ends_sha256"), F.when(top, F.col("parent")).alias("bucket"),
    )


def summed(nodes: DataFrame) -> DataFrame:
    """What hangs directly below each bucket: children, and the leaves and saved code points of their subtrees."""
    below = nodes.where("bucket IS NOT NULL").groupBy("bucket")
    return below.agg(F.count(F.lit(1)).alias("sum_children"), F.sum("n_leaves").alias("sum_leaves"), F.sum("saved_tokens").alias("sum_saved"))


def radix(classes: DataFrame, depth0: int, bucket: int, bucket_turns: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes below the roots of ``classes``, and what hangs directly below each root (as ``summed``).

    Round by round the rows of a bucket go by their next turn id. A part that is small enough is local: a task finishes it by
    quicksort. A larger one is a bucket of the next round; the turns that all its sequences share are passed over at once
    (``chain``), so a round ends where sequences part. Then the rounds are gone through backwards, and each bucket
    gets the sums of what hangs below it.
    """
    state = classes.withColumns({"bucket": F.col("root"), "d": F.lit(0), "bucket_first": F.col("root_first")}).drop("root", "root_first")
    rounds: list[tuple[DataFrame, DataFrame | None]] = []
    while True:
        rest = state.where(F.size("codes") > F.col("d")).withColumn("code", F.get("codes", F.col("d")))
        kids = rest.groupBy("bucket", "code").agg(F.count(F.lit(1)).alias("m"), F.sum((F.size("codes") - F.col("d")).cast("bigint")).alias("turns"))
        large = materialize(kids.where((F.col("m") > 1) & ((F.col("m") > bucket) | (F.col("turns") > bucket_turns))).select("bucket", "code", F.monotonically_increasing_id().alias("child")), "radix-large")
        more = not large.isEmpty()
        local = materialize(finished(rest.join(large, ["bucket", "code"], "left_anti") if more else rest, depth0), "trie-nodes")
        rounds.append((local, None))
        if not more:
            break
        inside = rest.join(large, ["bucket", "code"])
        pivot = materialize(inside.groupBy("child").agg(F.min_by("codes", "first").alias("pivot"), F.min_by("lens", "first").alias("pivot_lens")), "radix-pivots")
        parts = F.array_position(F.zip_with("codes", "pivot", lambda x, y: ~x.eqNullSafe(y)), True)
        inside = inside.join(pivot, "child").withColumn("shared", F.when(parts == 0, F.size("codes")).otherwise(parts - 1).cast("int")).drop("pivot", "pivot_lens")
        inside = materialize(inside, "radix-rows")
        at = inside.groupBy("child").agg(F.min("shared").alias("to"), F.sum("n").alias("bucket_n"), F.min("first").alias("child_first"), F.first("bucket").alias("parent"), F.first("bucket_first").alias("parent_first"), F.first("d").alias("d"))
        at = materialize(at, "radix-active")
        placed = inside.drop("d", "bucket", "bucket_first", "code", "shared").join(at.select("child", "to", "child_first"), "child")
        state = placed.withColumnsRenamed({"child": "bucket", "to": "d", "child_first": "bucket_first"})
        ended = state.where(F.size("codes") == F.col("d")).select(F.col("bucket").alias("child"), "ends", "children", "leaves", "saved")
        chain = F.slice("pivot_lens", F.col("d") + 1, F.col("to") - F.col("d"))
        active = at.join(pivot, "child").join(ended, "child", "left")
        active = active.select(F.col("child").alias("bucket"), "parent", "parent_first", "d", F.col("bucket_n").alias("n"), F.col("child_first").alias("first"), chain.alias("chain"), "ends", "children", "leaves", "saved")
        rounds[-1] = (local, materialize(active, "radix-chains"))
    nodes, below = [], None
    for local, active in reversed(rounds):
        here = [local]
        if active is not None:
            here.append(materialize(chains(active, below, depth0), "trie-chains"))
        nodes += here
        below = materialize(summed(reduce(DataFrame.unionByName, here)), "trie-sums")
    return nodes, below


def forest(members: DataFrame, later: DataFrame, part: int, size: int, bucket: int, bucket_turns: int) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Nodes below the roots of ``members`` (id, root, codes, lens, last), what hangs below each root, and the classes.

    Equal sequences of one root are one class first, in a combined aggregation, so a conversation that a third of all
    repeat is one row. Classes that go on are the roots of the next part, which comes first, as its sums hang below them.
    """
    key = F.unhex(F.sha2(F.array_join(F.col("codes").cast("array<string>"), ","), 256))
    members = materialize(members.withColumn("key", key), "sequences")
    classes = members.groupBy("root", "key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.first("codes").alias("codes"), F.first("lens").alias("lens"), F.max(~F.col("last")).alias("more"))
    classes = classes.join(end_lists(members), ["root", "key"], "left").withColumn("cid", F.monotonically_increasing_id())
    classes = materialize(classes, "classes")
    zero, nodes = F.lit(0).cast("bigint"), []
    if classes.where("more").isEmpty():
        whole = classes.withColumns({"children": zero, "leaves": zero, "saved": zero})
    else:
        goes_on = members.where("NOT last").select("id", "root", "key").join(classes.select("root", "key", "cid"), ["root", "key"]).select("id", F.col("cid").alias("root"))
        after = later.where(F.col("part") == part + 1).join(goes_on, "id").select("id", "root", "codes", "lens", "last")
        nodes, below, _ = forest(after, later, part + 1, size, bucket, bucket_turns)
        whole = classes.join(below.withColumnRenamed("bucket", "cid"), "cid", "left")
        whole = whole.withColumns({c: F.coalesce(f"sum_{c}", zero) for c in ("children", "leaves", "saved")}).drop("sum_children", "sum_leaves", "sum_saved")
    roots = classes.groupBy("root").agg(F.min("first").alias("root_first"))
    own, below = radix(whole.drop("key", "more", "cid").join(roots, "root"), part * size, bucket, bucket_turns)
    return nodes + own, below, classes


def prefix_trie(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", bucket: int = BUCKET, bucket_turns: int = BUCKET_TURNS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations; the columns are those of ``op13``'s contract.

    Turns become numbers of a dictionary of the distinct (role, text), told apart by SHA-256, and
    each conversation a sequence of them (``rebuilt``). Equal sequences are one class (``forest``), classes go into buckets by their turns from the
    front until a bucket is local (``radix``), and a task finishes a local bucket by three-way quicksort by turn (``Bucket``), whose
    middle parts are the nodes. Texts are read once and never shuffled.

    Null roles and texts count as empty; a null turn comes first; turns of one number go by the digest of role and text, and repeated rows are
    turns of their own. Rows without a conversation id belong to no conversation and are left out. Ids are whole numbers, negative ones with the
    remainder's sign of SQL. Other columns aren't read. An empty table has no conversations and so no nodes, not even a root.
    """
    turns = coded_turns(df, id_col, turn_col, role_col, text_col)
    parts = materialize(rebuilt(turns), "rebuilt")
    start = parts.where("part = 0").select("id", F.lit(0).cast("bigint").alias("root"), "codes", "lens", "last")
    nodes, below, classes = forest(start, parts, 0, PART, bucket, bucket_turns)
    top = classes.agg(F.min("first").alias("conv_id"), F.sum("n").alias("n_convs"), F.max(F.when(F.size("codes") == 0, F.col("ends"))).alias("ends"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    root = top.where("n_convs > 0").crossJoin(below.agg(*(F.max(f"sum_{c}").alias(c) for c in ("children", "leaves", "saved"))))  # a row with a row
    root = root.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs", count("children").alias("n_children"), F.greatest(count("leaves"), F.lit(1)).cast("bigint").alias("n_leaves"), count("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))
    return reduce(DataFrame.unionByName, [root, *(n.drop("bucket") for n in nodes)])


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


#: crc32 of the decimal id: the fold of the reflected polynomial 0xEDB88320 over its bytes.
CRC = "xor(list_reduce(list_prepend(4294967295, [ord(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]), lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295)"
OP13_SQL = f"""
WITH turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {CRC} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM turns)),
heads AS (SELECT c.conv_id, c.h, count(b.place) AS k FROM convs c LEFT JOIN turns b ON b.conv_id = c.base AND b.place < c.h GROUP BY ALL),
rebuilt AS (SELECT c.conv_id, b.place + 1 AS depth, b.role, b.text FROM convs c JOIN turns b ON b.conv_id = c.base AND b.place < c.h
  UNION ALL SELECT t.conv_id, t.place - c.h + c.k + 1, t.role, t.text FROM turns t JOIN heads c ON t.conv_id = c.conv_id WHERE t.place >= c.h),
paths AS (SELECT conv_id, depth, length(text) AS len, string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM rebuilt UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
nodes AS (SELECT path, any_value(depth) AS depth, any_value(len) AS len, min(conv_id) AS conv_id, count(*) AS n, left(path, greatest(0, length(path) - 32)) AS up FROM paths GROUP BY path),
kids AS (SELECT up AS path, count(*) AS k FROM nodes WHERE depth > 0 GROUP BY up),
below AS (SELECT m.path, sum(CASE WHEN kids.k IS NULL THEN 1 ELSE 0 END)::BIGINT AS leaves, sum((d.n - 1) * d.len)::BIGINT AS saved FROM nodes d JOIN paths m ON m.conv_id = d.conv_id AND m.depth <= d.depth LEFT JOIN kids ON kids.path = d.path GROUP BY m.path),
ends AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM (SELECT conv_id, arg_max(path, depth) AS path FROM paths GROUP BY conv_id) GROUP BY path)
SELECT a.conv_id, a.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, a.n AS n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, coalesce(sha, '{NOTHING}') AS ends_sha256
FROM nodes a LEFT JOIN nodes p ON a.depth > 0 AND p.path = a.up LEFT JOIN kids ON kids.path = a.path JOIN below ON below.path = a.path LEFT JOIN ends ON ends.path = a.path
"""
