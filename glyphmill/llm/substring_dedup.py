"""Substring dedup: bytes that repeat what an earlier document has go, found with suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import discard, materialize, read, text_of
from glyphmill.llm.shingles import hashes, mixed
from glyphmill.llm.stream import by_group
from glyphmill.llm.suffix_array import expanded, suffix_array, suffix_arrays

LENGTH = 50
ANCHOR = 24
RUN = LENGTH - ANCHOR + 1
SLICE_BYTES = 1 << 20
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
#: Classes of contexts that one suffix array takes; groups with more are dealt out by longer common strings.
MEET = 2000
#: Width of the cells of anchor offsets that such groups are dealt out by, level after level; cells of 1 have one class a group.
CELLS = (4, 1)
MEET_BYTES = 1 << 20
BROADCAST_IDS = 1_000_000


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each string of LENGTH bytes in each text: the text's number, its start and its anchor.

    The anchor is the least hash of the ANCHOR-byte strings inside, so equal strings have equal
    anchors, and neighbours mostly share theirs. The last array holds those hashes by place in all texts joined.
    """
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    empty = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty, np.empty(0, np.uint64), np.empty(0, np.uint64)
    least = strings = hashes(data, ANCHOR)
    width = 1
    while width * 2 <= RUN:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < RUN:
        least = np.minimum(least[: len(least) - (RUN - width)], least[RUN - width :])
    start = np.cumsum(size) - size
    text = np.repeat(np.arange(len(texts)), size)[: len(least)]
    at = np.arange(len(least)) - start[text]
    inside = at + LENGTH <= size[text]
    return text[inside], at[inside], least[inside], strings


def runs(text: np.ndarray, at: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run of neighbours with one anchor, RUN windows at most."""
    if not len(text):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(text)))
    pieces = -(-count // RUN)
    f = np.repeat(first, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * RUN
    end = np.repeat(first + count, pieces)
    return f, np.minimum(RUN, end - f)


def slices(texts: list[bytes], most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Texts in portions of about ``most`` bytes: number of the text, offset in it, bytes.

    A longer text comes in parts that overlap by LENGTH - 1 bytes, so each string is in just one.
    """
    most = most or SLICE_BYTES
    owner, offset, held, total = [], [], [], 0
    for i, t in enumerate(texts):
        for o in range(0, max(1, len(t) - LENGTH + 1), most):
            part = t[o : o + most + LENGTH - 1]
            if held and total + len(part) > most:
                yield np.array(owner), np.array(offset), held
                owner, offset, held, total = [], [], [], 0
            owner.append(i)
            offset.append(o)
            held.append(part)
            total += len(part)
    if held:
        yield np.array(owner), np.array(offset), held


def sorted_suffixes(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Suffix arrays of strings, many of like length at a time; single long ones by themselves."""
    if int(size.max()) * 16 > len(data):
        ends = np.cumsum(size).tolist()
        parts = [np.array(suffix_array(data[e - n : e].tolist())) + e - n for e, n in zip(ends, size.tolist(), strict=True)]
        return np.concatenate(parts)
    return suffix_arrays(data, size)


def shared_windows(contexts: list[bytes], doc: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each context a bit mask of its windows that also start in a context of its group with a smaller document.

    ``group`` is ascending. Windows whose hash no other window of the group has are left out. What
    stays of a group's contexts, a separator after each stretch, is one string; its suffix array puts
    the suffixes of equal windows side by side, and neighbours' bytes are compared. The strings of a
    task are sorted together, longest first, in portions.
    """
    mask = np.zeros(len(contexts), np.int64)
    size = np.array([len(c) for c in contexts], np.int64) + 1
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    count = np.diff(np.append(first, len(group)))
    whole = np.add.reduceat(size, first)
    by = np.argsort(-whole, kind="stable")
    portion = np.cumsum(whole[by]) // MEET_BYTES
    for k in np.unique(portion).tolist():
        mine = by[portion == k]
        at = expanded(first[mine], count[mine])
        n = size[at]
        text = np.frombuffer(b"\0".join([contexts[i] for i in at.tolist()]) + b"\0", np.uint8)
        owner = np.repeat(np.arange(len(at)), n)
        offset = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        begin = np.flatnonzero(offset + LENGTH < n[owner])
        key = mixed(hashes(text, LENGTH)[begin] ^ group[at[owner[begin]]].view(np.uint64))
        order = np.argsort(key)
        twice = key[order[1:]] == key[order[:-1]]
        shared = np.zeros(len(begin), bool)
        shared[order[1:][twice]] = shared[order[:-1][twice]] = True
        begin = begin[shared]
        if not len(begin):
            continue
        edge = np.flatnonzero(np.concatenate([[True], np.diff(begin) > 1]))
        length = np.diff(np.append(edge, len(begin))) + LENGTH  # of each stretch and its separator
        place = expanded(begin[edge], length)
        ends = np.cumsum(length) - 1
        data = text[place].astype(np.int64) + 1
        data[ends] = 0
        left = np.repeat(ends, length) - np.arange(len(data))  # bytes up to the separator
        of = group[at[owner[begin[edge]]]]
        string = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        p = sorted_suffixes(data, np.add.reduceat(length, string))
        p = place[p[left[p] >= LENGTH]]
        who = at[owner[p]]
        same = np.concatenate([[False], group[who[1:]] == group[who[:-1]]])
        eight = np.lib.stride_tricks.as_strided(text, (len(text) - 7, 8), (1, 1))
        for o in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            x = np.ascontiguousarray(eight[p + o]).view(np.uint64)[:, 0]
            same[1:] &= x[1:] == x[:-1]
        run = np.flatnonzero(~same)
        late = doc[who] > np.minimum.reduceat(doc[who], run)[np.cumsum(~same) - 1]
        mask += np.bincount(who[late], 2.0 ** offset[p[late]], len(contexts)).astype(np.int64)  # every bit once
    return mask


def cells(contexts: list[bytes], anchor: np.ndarray, width: int) -> list[tuple[int, int, int, int, bytes]]:
    """Contexts of one anchor cut by where their windows have it: number, first window, windows, 64 bits of group, bytes.

    Windows whose first anchor is at offsets of one cell (``width`` of them) have a longer string around
    it in common, the core. Equal windows have the anchor at one offset and one core, so they meet in
    the cell and core's group. Neighbours go together while their anchor is the same one.
    """
    out = []
    for i, c in enumerate(contexts):
        n = len(c) - LENGTH + 1
        found = np.flatnonzero(hashes(np.frombuffer(c, np.uint8), ANCHOR) == anchor[i])
        at = found[np.searchsorted(found, np.arange(n))]
        first = (at - np.arange(n)).tolist()
        at = at.tolist()
        begin = [o for o in range(n) if not o or at[o] != at[o - 1] or first[o] // width != first[o - 1] // width]
        for a, b in zip(begin, [*begin[1:], n], strict=True):
            cell = first[a] // width * width
            core = c[at[a] - cell : at[a] + LENGTH + 1 - min(RUN, cell + width)]
            h = xxhash.xxh3_64_intdigest(core, seed=int(anchor[i]) ^ (cell * RUN + width))
            out.append((i, a, b - a, h - (1 << 63), c[a : b + LENGTH - 1]))
    return out


def masks(classes: DataFrame, tables: list[DataFrame], widths: tuple[int, ...] = CELLS) -> DataFrame:
    """(h, c, mask): windows of each class that a smaller document has in another class of its group.

    Columns of ``classes``: group h, class c, smallest document low, anchor, context, and the group's
    number of classes k (over 1). Groups of up to MEET classes get a suffix array; a larger one's contexts
    are cut into cells, which are classes of smaller groups in turn. What is written on the way is added to ``tables``.
    """
    few_bytes, many = classes.agg(F.coalesce(F.sum(F.when(F.col("k") <= MEET, F.octet_length("context"))), F.lit(0)), F.coalesce(F.max(F.col("k") > MEET), F.lit(False))).first()

    def sort(key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        h = rows.column("h").to_numpy()
        order = np.argsort(h, kind="stable")
        context = rows.column("context").to_pylist()
        h, c, low = h[order], rows.column("c").to_numpy()[order], rows.column("low").to_numpy()[order]
        done = shared_windows([context[i] for i in order.tolist()], low, h)
        got = np.flatnonzero(done)
        if len(got):
            yield pa.RecordBatch.from_arrays([pa.array(h[got]), pa.array(c[got]), pa.array(done[got])], names=["h", "c", "mask"])

    parts = max(1, int(few_bytes) // MEET_BYTES)
    few = classes.where(F.col("k") <= MEET).withColumn("part", F.pmod(F.xxhash64("h"), F.lit(parts)))
    found = by_group(few.select("part", "h", "c", "low", "context"), ["part"], sort, "h bigint, c bigint, mask bigint", parts)
    if not many or not widths:
        return found

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            anchor = b.column("anchor").to_numpy()
            got = cells(b.column("context").to_pylist(), anchor.view(np.uint64), widths[0])
            if got:
                i, start, n, group, sub = zip(*got, strict=True)
                at = np.array(i)
                yield pa.RecordBatch.from_arrays([*(b.column(x).take(pa.array(at)) for x in ("h", "c", "low")), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(group, pa.int64()), pa.array(anchor[at]), pa.array(sub, pa.binary())], names=["h", "c", "low", "start", "n", "g", "anchor", "context"])

    schema = "h bigint, c bigint, low bigint, start bigint, n bigint, g bigint, anchor bigint, context binary"
    big = classes.where(F.col("k") > MEET).select("h", "c", "low", "anchor", "context")
    subs = materialize(big.mapInArrow(cut, schema).withColumn("d", F.xxhash64("context")), "cells")
    lower = subs.groupBy(F.col("g").alias("h"), F.col("d").alias("c")).agg(F.min("low").alias("low"), F.min("anchor").alias("anchor"), F.min("context").alias("context"))
    lower = materialize(lower, "cell-classes")
    several = lower.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    meeting = materialize(lower.join(several, "h"), "meeting-cells")
    tables += [subs, lower, meeting]
    below = lower.select(F.col("h").alias("g"), F.col("c").alias("d"), F.col("low").alias("least")).join(masks(meeting, tables, widths[1:]).select(F.col("h").alias("g"), F.col("c").alias("d"), "mask"), ["g", "d"], "left")
    met = subs.select("h", "c", "low", "start", "n", "g", "d").join(below, ["g", "d"])
    whole = F.when(F.col("low") > F.col("least"), F.expr("shiftleft(1L, cast(n AS int)) - 1")).otherwise(F.coalesce("mask", F.lit(0)))
    up = met.withColumn("mask", whole).where("mask <> 0").groupBy("h", "c").agg(F.expr("bit_or(shiftleft(mask, cast(start AS int)))").alias("mask"))
    return found.unionByName(up)


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: id, ``n_bytes``, ``kept`` (binary), ``spans`` (array of removed (start, end) in bytes, maximal).

    A byte goes if some LENGTH-byte string over it also starts in a document with a smaller id;
    strings are judged on the input and never cross documents.

    1. Of equal texts (SHA-256 and length) only the smallest id goes on; of the others every byte
       goes, or none if they are shorter than LENGTH.
    2. Every string has an anchor (``windows``). Anchors are dealt out by value, packed; each chunk of
       documents gets back those that it shares with another document. A task sees 5 bytes for each
       distinct anchor and chunk, however many documents have it.
    3. Chunks cut out the contexts of shared anchors. Equal contexts of an anchor (128 bits of hash) are a class; its
       smallest document keeps them, all others lose them: a combined aggregation.
    4. Classes of one anchor meet and a suffix array over them (``suffix_arrays``) finds the strings
       that the smallest document of a class shares with a smaller one. Where an anchor has more than
       MEET classes, strings meet by the anchor's place in them and by what is around it (``cells``),
       so that its contexts spread over many suffix arrays and no task has them all.
    5. Documents get their covered stretches and are cut.

    Chunks are by the hash of the id and have CHUNK_BYTES on average. Ids are whole numbers. Null
    texts count as empty. Rows that repeat an id are one document in the order of documents: they
    never cover each other's bytes, and each loses what its own text repeats of smaller ids (rows
    of one id are told apart by 64 bits of their texts' hash); a null id is larger than every id. Other columns aren't read; empty tables stay empty.
    """
    spark = df.sparkSession
    base = df.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit((1 << 63) - 1)).alias("id"), text_of(text_col).cast("binary").alias("text")).withColumn("t", F.xxhash64("text"))
    total = int(base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    n_chunks = max(1, total // CHUNK_BYTES)
    n_buckets = max(1, total * 5 // ((RUN + 1) // 2) // BUCKET_BYTES)
    digests = base.select("id", "t", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("n"))
    least = digests.groupBy("sha", "n").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("m")).where("m > 1")
    copies = materialize(digests.join(least, ["sha", "n"]).where("id > low").select("id", "t", F.lit(True).alias("copy")).distinct(), "copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    docs = base.join(copies, ["id", "t"], "left").withColumn("chunk", F.pmod(F.xxhash64("id", "t"), F.lit(n_chunks)))
    originals = docs.where("copy IS NULL").select("chunk", "id", "t", "text")

    def placed(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and 40 bits within it."""
        spread = anchor >> np.uint64(24)
        low = anchor & np.uint64((1 << 40) - 1)
        return (spread % np.uint64(n_buckets)).astype(np.int64), low

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        many = 0

        def flush() -> Iterator[pa.RecordBatch]:
            chunk, anchor = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket, low = placed(anchor)
            order = np.lexsort((low, chunk, bucket))
            bucket, chunk, low = bucket[order], chunk[order], low[order]
            edge = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (chunk[1:] != chunk[:-1])]))
            raw = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
            ends = np.append(edge[1:], len(low))
            parts = [raw[5 * a : 5 * b] for a, b in zip(edge.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edge]), pa.array(chunk[edge]), pa.array(parts, pa.binary())], names=["bucket", "chunk", "packed"])

        for b in batches:
            chunks = b.column(0).to_numpy()
            for owner, _, texts in slices(b.column(2).to_pylist()):
                text, _, anchor, _ = windows(texts)
                if not len(text):
                    continue
                keep = np.concatenate([[True], (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])])
                order = np.lexsort((anchor[keep], text[keep]))
                text, anchor = text[keep][order], anchor[keep][order]
                once = np.concatenate([[True], (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])])  # once a document
                held.append((chunks[owner[text[once]]], anchor[once]))
                many += int(once.sum())
                if many > 1_500_000:
                    yield from flush()
                    held, many = [], 0
        if held:
            yield from flush()

    def unpack(packed: list[bytes]) -> np.ndarray:
        five = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, 5)
        out = np.zeros((len(five), 8), np.uint8)
        out[:, :5] = five
        return out.view("<u8")[:, 0]

    def meet(key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        packed = rows.column("packed").to_pylist()
        low = unpack(packed)
        chunk = np.repeat(rows.column("chunk").to_numpy(), [len(p) // 5 for p in packed])
        order = np.argsort(low, kind="stable")
        low, chunk = low[order], chunk[order]
        same = low[1:] == low[:-1]
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        low, chunk = low[shared], chunk[shared]
        order = np.lexsort((low, chunk))
        low, chunk = low[order], chunk[order]
        if len(low):
            edge = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
            parts = [np.unique(x).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for x in np.split(low, edge[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(chunk[edge]), pa.array(np.full(len(edge), key[0])), pa.array(parts, pa.binary())], names=["chunk", "bucket", "packed"])

    dealt = originals.select("chunk", "id", "text").mapInArrow(anchors, "bucket bigint, chunk bigint, packed binary")
    shared = materialize(by_group(dealt, ["bucket"], meet, "chunk bigint, bucket bigint, packed binary"), "shared-anchors")

    def cut(key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket = np.array(rows.column("bucket").to_pylist(), object)
        is_doc = np.array([x is None for x in bucket])
        data = rows.column("data").to_pylist()
        known: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(~is_doc).tolist():
            known[int(bucket[i])] = np.union1d(known.get(int(bucket[i]), np.empty(0, np.uint64)), unpack([data[i]]))
        if not known:
            return
        at_docs = np.flatnonzero(is_doc)
        ids = np.array(rows.column("id").to_pylist(), object)[at_docs]
        own = np.array(rows.column("t").to_pylist(), object)[at_docs]
        texts = [data[i] for i in at_docs.tolist()]
        # One sorted array: bucket in front of the 40 bits.
        wanted = np.sort(np.concatenate([v + (np.uint64(b) << np.uint64(40)) for b, v in known.items()]))
        for owner, offset, part in slices(texts):
            text, at, anchor, _ = windows(part)
            first, count = runs(text, at, anchor)
            if not len(first):
                continue
            b, low = placed(anchor[first])
            full = low + (b.astype(np.uint64) << np.uint64(40))
            p = np.minimum(np.searchsorted(wanted, full), len(wanted) - 1)
            hit = wanted[p] == full
            first, count = first[hit], count[hit]
            if not len(first):
                continue
            t, s, n = text[first], at[first], count
            begin = np.cumsum([0, *map(len, part)])[t] + s
            size = n + LENGTH - 1
            ends = np.concatenate([[0], np.cumsum(size)])
            data_ = np.frombuffer(b"".join(part), np.uint8)[expanded(begin, size)]
            out = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data_)])
            yield pa.RecordBatch.from_arrays([pa.array(anchor[first].view(np.int64)), pa.array(ids[owner[t]].astype(np.int64)), pa.array(own[owner[t]].astype(np.int64)), pa.array(s + offset[t]), pa.array(n), out], names=["h", "id", "t", "start", "n", "context"])

    texts = originals.select("chunk", "id", "t", F.lit(None).cast("bigint").alias("bucket"), F.col("text").alias("data"))
    asked = shared.select("chunk", F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("t"), "bucket", F.col("packed").alias("data"))
    cuts = by_group(texts.unionByName(asked), ["chunk"], cut, "h bigint, id bigint, t bigint, start bigint, n bigint, context binary")
    contexts = materialize(cuts.withColumn("c", F.xxhash64("context")), "contexts", "zstd")
    discard(shared)
    # A class is named by its anchor's and its bytes' hash, 128 bits together; bytes move only where classes meet.
    classes = materialize(contexts.groupBy("h", "c").agg(F.min("id").alias("low"), F.max("id").alias("high")), "classes")
    per = classes.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    meeting = classes.join(per, "h").select("h", "c", "low", "k")
    bytes_of = contexts.select("h", "c", F.col("id").alias("low"), "context").join(meeting, ["h", "c", "low"])
    together = materialize(bytes_of.groupBy("h", "c", "low", "k").agg(F.first("context").alias("context")).withColumn("anchor", F.col("h")), "meeting")
    tables = [contexts, classes, together]
    verdicts = classes.select("h", "c", "low", "high").join(masks(together, tables), ["h", "c"], "left").where("mask IS NOT NULL OR low < high")
    hits = contexts.select("h", "c", "id", "t", "start", "n").join(verdicts, ["h", "c"])
    whole = F.when(F.col("id") > F.col("low"), F.expr("shiftleft(1L, cast(n AS int)) - 1")).otherwise(F.coalesce("mask", F.lit(0)))
    covered = hits.withColumn("mask", whole).where("mask <> 0").select(F.pmod(F.xxhash64("id", "t"), F.lit(n_chunks)).alias("chunk"), "id", "t", "start", "mask")
    covered = materialize(covered, "covered")
    discard(*tables)  # what follows reads the covered stretches and the texts
    touched = covered.select("id", "t", F.lit(True).alias("cut")).distinct()
    touched = F.broadcast(touched) if touched.count() <= BROADCAST_IDS else touched

    def finish(key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        marks = rows.column("mask").to_numpy(zero_copy_only=False)
        is_doc = np.isnan(marks) if marks.dtype.kind == "f" else np.zeros(len(marks), bool)
        ids, own = rows.column("id").to_numpy(), rows.column("t").to_numpy()
        docs_at = np.flatnonzero(is_doc)
        texts = rows.column("text").take(pa.array(docs_at)).to_pylist()
        size = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(size + 1) - size - 1  # a place behind each text
        # Rows of one document have one place to add to.
        number = {(i, t): k for k, (i, t) in enumerate(zip(ids[docs_at].tolist(), own[docs_at].tolist(), strict=True))}
        at = np.flatnonzero(~is_doc)
        at = at[np.lexsort((own[at], ids[at]))]
        i, t = ids[at], own[at]
        edge = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])])) if len(at) else np.empty(0, np.int64)
        of = np.repeat(np.array([number.get(k, -1) for k in zip(i[edge].tolist(), t[edge].tolist(), strict=True)], np.int64), np.diff(np.append(edge, len(at))))
        at, of = at[of >= 0], of[of >= 0]
        mask = marks[at].astype(np.int64)
        base = first[of] + rows.column("start").to_numpy(zero_copy_only=False)[at].astype(np.int64)
        total = int(size.sum()) + len(size) + 1
        up, down = [], []
        for bit in range(RUN):  # a run of windows begins or ends here
            here = mask >> bit & 1 > 0
            up.append(base[here & (mask << 1 >> bit & 1 == 0)] + bit)
            down.append(base[here & (mask >> bit + 1 & 1 == 0)] + bit + LENGTH)
        gone = np.bincount(np.concatenate(up), minlength=total) - np.bincount(np.concatenate(down), minlength=total)
        away = np.cumsum(gone) > 0
        out = []
        # Rows that repeat a document have the places of the last of them.
        for d, text in zip(docs_at.tolist(), texts, strict=True):
            k = int(first[number[int(ids[d]), int(own[d])]])
            cut = away[k : k + len(text)]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]])))
            out.append((int(ids[d]), len(text), np.frombuffer(text, np.uint8)[~cut].tobytes(), [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]))
            if len(out) >= 500:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        a, b, c, d = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary()), pa.array(d, pa.list_(span))], names=["id", "n_bytes", "kept", "spans"])

    null = lambda t: F.lit(None).cast(t)
    marked = docs.join(touched, ["id", "t"], "left")
    left = marked.where("cut AND copy IS NULL").select("chunk", "id", "t", null("bigint").alias("start"), null("bigint").alias("mask"), "text")
    right = covered.select("chunk", "id", "t", "start", "mask", null("binary").alias("text"))
    schema = "id bigint, n_bytes bigint, kept binary, spans array<struct<start:bigint,end:bigint>>"
    changed = by_group(left.unionByName(right), ["chunk"], finish, schema)
    # Copies lose all, documents without a covered byte nothing: they need no dealing out.
    size = F.octet_length("text").cast("bigint")
    gone = F.col("copy").isNotNull() & (size >= LENGTH)
    whole_span = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), size.alias("end")))
    rest = marked.where("cut IS NULL OR copy IS NOT NULL").select("id", size.alias("n_bytes"), F.when(gone, F.lit(b"")).otherwise(F.col("text")).alias("kept"), F.when(gone, whole_span).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"))
    result = changed.unionByName(rest)
    return result.select(F.when(F.col("id") < (1 << 63) - 1, F.col("id")).alias(id_col), "n_bytes", "kept", "spans")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(read(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
