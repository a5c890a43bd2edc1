"""BPE encoding and decoding: guess by longest match, verify adjacent pairs, merge only where the guess fails."""

from __future__ import annotations

import gc
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.common import read, text_of

#: Fixed value: the pre-tokenisation pattern of the byte-level format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces in a table before a new one begins; the one before stays at hand.
WORDS_KEPT = 300_000
SLICE_BYTES = 2 << 20


def byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary with the tables that guessing, verifying and merging need."""

    def __init__(self, spec: bytes):
        d = json.loads(spec)
        chars = byte_chars()
        to_bytes = lambda s: bytes(chars[c] for c in s)
        model = d["model"]
        self.ids = {to_bytes(s): i for s, i in model["vocab"].items()}
        added = {x["content"]: x["id"] for x in d.get("added_tokens", [])}
        self.added = added
        self.n = 1 + max([*self.ids.values(), *added.values()])
        self.token = [b""] * self.n
        for b, i in self.ids.items():
            self.token[i] = b
        for s, i in added.items():
            self.token[i] = s.encode()
        self.flat = np.frombuffer(b"".join(self.token), np.uint8)
        self.length = np.array([len(b) for b in self.token], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([self.ids[to_bytes(a)] for a, _ in pairs], np.int64)
        right = np.array([self.ids[to_bytes(b)] for _, b in pairs], np.int64)
        made = [self.ids[self.token[a] + self.token[b]] for a, b in zip(left, right, strict=True)]
        self.made = made
        self.rank = {k: r for r, k in enumerate((left * self.n + right).tolist())}
        self.single = [self.ids[bytes([c])] for c in range(256)]
        self.born = np.full(self.n + 1, -1, np.int64)  # rank of the merge that makes a token
        self.first = np.full(self.n + 1, self.n, np.int64)  # its left part; n: none
        self.last = np.full(self.n + 1, self.n, np.int64)
        self.twice = set()
        for r, m in enumerate(made):
            if self.born[m] >= 0:
                self.twice.add(m)
            else:
                self.born[m], self.first[m], self.last[m] = r, left[r], right[r]
        key = left * self.n + right
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order
        self.longest: dict[bytes, int] = {}  # of the tokens that begin with three given bytes
        for x in self.ids:
            if len(x) > 2:
                self.longest[x[:3]] = max(self.longest.get(x[:3], 0), len(x))
        self.sound: dict[int, bool] = {}
        self.pairs_seen = np.empty(0, np.int64)
        self.pairs_ok = np.empty(0, bool)
        split = "|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True))
        self.split = regex.compile(f"({split})") if split else None
        self.words = regex.compile(PATTERN)
        self.white = frozenset(regex.findall(r"\s", "".join(map(chr, range(0x10000 - 0x2800)))))  # as the pattern has it, which str.isspace() does not; none is higher

    def guess(self, word: bytes) -> list[int]:
        """Longest match from the left."""
        out, i, n, ids, longest = [], 0, len(word), self.ids, self.longest
        while i < n:
            k = longest.get(word[i : i + 3], 0)
            if i + k > n:
                k = n - i
            while k > 2 and word[i : i + k] not in ids:
                k -= 1
            if k < 3:
                k = 2 if i + 2 <= n and word[i : i + 2] in ids else 1
            out.append(ids[word[i : i + k]])
            i += k
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merge by rank, leftmost first."""
        ids = [self.single[c] for c in word]
        if len(ids) > 48:
            return self.exact_long(ids)
        rank, made, none = self.rank, self.made, len(self.made)
        base = self.n
        ranks = [rank.get(a * base + b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            m = ids[i] = made[r]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank.get(ids[i - 1] * base + m, none)
            if i < len(ranks):
                ranks[i] = rank.get(m * base + ids[i + 1], none)
        return ids

    def exact_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of merges and links between pieces."""
        n, rank, made, base = len(ids), self.rank, self.made, self.n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get(ids[i] * base + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            m = made[r]
            ids[i], ids[j] = m, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := rank.get(m * base + ids[k])) is not None:
                    heapq.heappush(heap, (x, i, m, ids[k]))
            if (p := before[i]) >= 0 and (x := rank.get(ids[p] * base + m)) is not None:
                heapq.heappush(heap, (x, p, ids[p], m))
        return [t for t in ids if t >= 0]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of tokens: do they stay apart when their joined bytes are merged?

        They don't if some merge joins a piece at the end of the left token to a piece at the start
        of the right one before either piece is used up inside its own token. Pieces at the end of
        a token are its right part, that part's right part and so on; each is used up at the rank
        at which its whole is made. Of equal ranks the leftmost merge comes first.
        """
        ok = np.ones(len(a), bool)
        big = np.int64(1) << 40
        x, used_x = a.copy(), np.full(len(a), big)
        while (live := (x < self.n) & ok).any():
            y, used_y = b.copy(), np.full(len(a), big)
            while (here := live & (y < self.n)).any():
                at = np.flatnonzero(here)
                key = x[at] * self.n + y[at]
                p = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                rank = np.where(self.keys[p] == key, self.ranks[p], big + 1)
                ok[at] &= ~((rank < used_x[at]) & (rank <= used_y[at]) & (rank <= big))
                used_y = np.where(y < self.n, self.born[y], used_y)
                y = self.first[y]
            used_x = np.where(x < self.n, self.born[x], used_x)
            x = self.last[x]
        return ok

    def known_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        new = np.setdiff1d(key, self.pairs_seen)
        if len(new):
            if len(self.pairs_seen) > 2_000_000:
                self.pairs_seen, self.pairs_ok, new = np.empty(0, np.int64), np.empty(0, bool), np.unique(key)
            ok = self.compatible(new // self.n, new % self.n)
            at = np.searchsorted(self.pairs_seen, new)
            self.pairs_seen, self.pairs_ok = np.insert(self.pairs_seen, at, new), np.insert(self.pairs_ok, at, ok)
        return self.pairs_ok[np.searchsorted(self.pairs_seen, key)]

    def is_sound(self, t: int) -> bool:
        """Is the token what its own bytes merge to?"""
        if (found := self.sound.get(t)) is None:
            found = self.sound[t] = t not in self.twice and self.exact(self.token[t]) == [t]
        return found

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        if not words:
            return []
        out = [self.guess(w) for w in words]
        flat = np.array([t for ids in out for t in ids], np.int64)
        size = np.array([len(ids) for ids in out])
        word = np.repeat(np.arange(len(out)), size)
        good = np.ones(len(out), bool)
        unsound = [t for t in np.unique(flat).tolist() if not self.is_sound(t)]
        if unsound:
            good[word[np.isin(flat, unsound)]] = False
        if len(flat) > 1:
            inside = np.flatnonzero(word[1:] == word[:-1])
            if len(inside):
                ok = self.known_pairs(flat[inside], flat[inside + 1])
                good[word[inside[~ok]]] = False
        for i in np.flatnonzero(~good).tolist():
            out[i] = self.exact(words[i])
        return out


class Encoder:
    """Encodes texts with a table of pieces seen, which starts anew when it is full.

    A space between two characters that aren't white space begins a word of the pattern whatever
    stands around it. So texts are cut at spaces, and what stands between two of them is looked up
    as a whole. A text in which some space stands beside white space or at an end shows it by an
    empty piece or a piece with white space at an end, and goes through the pattern.
    """

    def __init__(self, bpe: Bpe, kept: int = WORDS_KEPT):
        self.bpe, self.kept = bpe, kept
        self.clear()

    def clear(self) -> None:
        """Begin a new table; the one so far is still looked up, and what is found there moves over."""
        self.old = getattr(self, "table", {}), getattr(self, "flat", None), getattr(self, "start", None), getattr(self, "size", None)
        #: By what follows a space: the number of its list of ids; after a space of its own: of a word of the pattern as it is, or an added token.
        self.table: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.int32)
        self.used = 0
        self.start, self.size, self.count = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), 0

    def ids(self, key: str) -> list[int]:
        i = self.number(key)
        return self.flat[self.start[i] : self.start[i] + self.size[i]].tolist()

    def number(self, key: str) -> int:
        """Of a piece that has ids; one that only shows white space at an edge has none."""
        if (i := self.table[key]) < 0:
            raise ValueError(f"no ids are known for {key!r}")
        return i

    def add(self, found: list[list[int]]) -> range:
        """Room for lists of ids; their numbers."""
        size = np.fromiter(map(len, found), np.int64, len(found))
        need, count = self.used + int(size.sum()), self.count + len(found)
        grow = lambda a, n: a if n <= len(a) else np.concatenate([a, np.empty(max(n - len(a), len(a)), a.dtype)])
        self.flat, self.start, self.size = grow(self.flat, need), grow(self.start, count), grow(self.size, count)
        self.start[self.count : count], self.size[self.count : count] = self.used + np.cumsum(size) - size, size
        self.flat[self.used : need] = np.fromiter(chain.from_iterable(found), np.int32, need - self.used)
        numbers = range(self.count, count)
        self.used, self.count = need, count
        return numbers

    def learn(self, keys: set[str]) -> None:
        """Put keys into the table that aren't there."""
        new = keys.difference(self.table)
        table, flat, start, size = self.old
        if moved := [k for k in new if table.get(k, -1) >= 0]:
            at = [table[k] for k in moved]
            self.table.update(zip(moved, self.add([flat[start[i] : start[i] + size[i]].tolist() for i in at]), strict=True))
            new.difference_update(moved)
        white = self.bpe.white
        edge = {k for k in new if not k or k[0] != " " and (k[0] in white or k[-1] in white)}
        self.table.update(dict.fromkeys(edge, -1))
        new = list(new - edge)
        words = [[k] if k[0] == " " else self.bpe.words.findall(" " + k) for k in new]
        single = [(k, w[0]) for k, w in zip(new, words, strict=True) if len(w) == 1]
        special = [(k, w[1:]) for k, w in single if k[0] == " " and w[1:] in self.bpe.added]
        self.table.update(zip([k for k, _ in special], self.add([[self.bpe.added[w]] for _, w in special]), strict=True))
        plain = [(k, w[1:] if k[0] == " " else w) for k, w in single if not (k[0] == " " and w[1:] in self.bpe.added)]
        self.table.update(zip([k for k, _ in plain], self.add(self.bpe.encode_words([w.encode("utf-8", "replace") for _, w in plain])), strict=True))
        more = [(k, [w[1:] if w[0] == " " and len(w) > 1 else " " + w for w in ws]) for k, ws in zip(new, words, strict=True) if len(ws) > 1]
        if more:
            self.learn(set(chain.from_iterable(ws for _, ws in more)))
            self.table.update(zip([k for k, _ in more], self.add([[t for w in ws for t in self.ids(w)] for _, ws in more]), strict=True))

    def words(self, text: str) -> list[str]:
        b = self.bpe
        if b.split is None or not any(s in text for s in b.added):
            return b.words.findall(text)
        out = []
        for part in b.split.split(text):
            out += [part] if part in b.added else b.words.findall(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text."""
        if len(self.table) > self.kept:
            self.clear()
        cut = [t.split(" ") for t in texts]
        self.learn(set(chain.from_iterable(x[1:] for x in cut)))
        heads: list[list[str]] = []  # words of the pattern
        tails: list[np.ndarray] = []  # numbers of the pieces that each follow a space
        find = self.table.__getitem__
        for t, x in zip(texts, cut, strict=True):
            at = np.fromiter(map(find, x[1:]), np.int64, len(x) - 1)
            if (len(at) and at.min() < 0) or any(s in t for s in self.bpe.added):
                heads.append([" " + w for w in self.words(t)])
                tails.append(at[:0])
            else:
                heads.append([" " + w for w in self.words(x[0])])
                tails.append(at)
        self.learn(set(chain.from_iterable(heads)))
        h, t = np.array([len(x) for x in heads], np.int64), np.array([len(x) for x in tails], np.int64)
        at = np.empty(int(h.sum() + t.sum()), np.int64)
        both = np.stack([h, t], 1).reshape(-1)
        in_tail = np.repeat(np.arange(len(both)) % 2 == 1, both)
        at[~in_tail] = np.fromiter(map(self.number, chain.from_iterable(heads)), np.int64, int(h.sum()))
        at[in_tail] = np.concatenate(tails) if tails else 0
        size = self.size[at]
        cum = np.cumsum(size)
        if not len(cum):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        ids = self.flat[np.arange(int(cum[-1])) + np.repeat(self.start[at] - (cum - size), size)]
        return ids, np.diff(np.concatenate([[0], cum])[np.concatenate([[0], np.cumsum(h + t)])])


def decode(bpe: Bpe, ids: np.ndarray) -> np.ndarray:
    """The tokens' bytes, joined."""
    size = bpe.length[ids]
    cum = np.cumsum(size)
    return bpe.flat[np.arange(int(cum[-1]) if len(cum) else 0) + np.repeat(bpe.offset[ids] - (cum - size), size)]


@lru_cache(maxsize=2)
def _bpe(spec: bytes) -> Bpe:
    return Bpe(spec)


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that together have at most ``most``, or one row."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def list_array(ids: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(ids))


def text_array(bpe: Bpe, ids: np.ndarray, size: np.ndarray) -> pa.Array:
    """The texts that lists of ids stand for; bytes that aren't UTF-8 become U+FFFD."""
    whole = decode(bpe, ids).tobytes()
    ends = np.concatenate([[0], np.cumsum(bpe.length[ids])])[np.concatenate([[0], np.cumsum(size)]).astype(np.int64)]
    try:
        whole.decode()
        text = pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(whole))
        text.validate(full=True)
        return text
    except (UnicodeDecodeError, pa.ArrowInvalid):
        return pa.array([whole[i:j].decode("utf-8", "replace") for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())


def bpe_encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``df`` with the array ``ids_col`` (replaced if it is there): the text's token ids.

    With ``decoded_col`` the ids are decoded again in the same pass, into that column.

    The file is read on the driver and broadcast (its size is the vocabulary's). Tokens are those
    of the format's own library without added special tokens; an added token's string inside a
    text gives its id. Null texts count as empty; empty texts have no ids. Rows are kept as they
    are, repeated ones too; an empty table stays empty. Memory: two tables of ``WORDS_KEPT`` pieces
    and one batch; the pieces of a batch are encoded once however often they occur.
    """
    spec = df.sparkSession.sparkContext.broadcast(load(tokenizer_path))
    new = [ids_col, decoded_col] if decoded_col else [ids_col]
    kinds = [T.ArrayType(T.IntegerType()), T.StringType()]
    base = df.drop(*new)
    schema = T.StructType([*base.schema.fields, *(T.StructField(c, k) for c, k in zip(new, kinds, strict=False))])
    base = base.select(*base.columns, F.coalesce(df[text_col], F.lit("")).alias("_bpe_text")) if text_col in new else base.withColumn("_bpe_text", text_of(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(spec.value)
        encoder = Encoder(bpe)
        gc.disable()  # many short lists, no cycles
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            rest = batch.select(range(batch.num_columns - 1))
            for a, b in slices(pa.compute.binary_length(text).to_numpy(zero_copy_only=False), SLICE_BYTES):
                ids, size = encoder.encode(text[a:b].to_pylist())
                made = [list_array(ids, size)]
                if decoded_col:
                    made.append(text_array(bpe, ids.astype(np.int64), size))
                yield pa.RecordBatch.from_arrays([*rest.slice(a, b - a).columns, *made], names=[*rest.schema.names, *new])
        gc.enable()

    return base.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the string ``out_col`` (replaced if it is there): the text that the ids stand for.

    A null list of ids gives an empty text; bytes that aren't UTF-8 become U+FFFD.
    """
    spec = df.sparkSession.sparkContext.broadcast(load(tokenizer_path))
    fields = df.drop(out_col).schema.fields
    base = df.drop(out_col).withColumn("_bpe_ids", F.col(ids_col))
    schema = T.StructType([*fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(spec.value)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            rest = batch.select(range(batch.num_columns - 1))
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(sizes, SLICE_BYTES // 4):
                ids = lists[a:b].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*rest.slice(a, b - a).columns, text_array(bpe, ids, sizes[a:b])], names=[*rest.schema.names, out_col])

    return base.mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    path = tokenizer_path or default_tokenizer()
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_encode(docs, path, decoded_col="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
