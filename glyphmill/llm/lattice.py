"""LM scoring by subword lattices: a unigram model over the pieces of a public vocabulary."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import fold, materialize, read, text_of

#: The most frequent words of the training part that are broadcast with their scores; all others are joined.
HEAD_WORDS = 100_000
#: Weight of the vocabulary's own scores, in pieces, against the corpus's expected counts.
PRIOR_PIECES = 10_000.0
#: Rounds of expectation over all training words.
EM_ROUNDS = 2
MARK = "▁"
SPLIT = str.maketrans("\t\n\x0b\x0c\r", "     ")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PRIME = np.uint64(0x100000001B3)
SLICE_CHARS = 1 << 19
#: Characters up to which products of piece probabilities stay far from underflow.
LINEAR = 24
#: Sums of products under this are computed again from logarithms.
TINY = 1e-200
#: Bits of the filter that rules out most strings that are no pieces, and what spreads hashes over it.
FILTER_BITS, SPREAD = 17, np.uint64(0x9E3779B97F4A7C15)
#: Distinct words that a task counts before it passes them on.
TABLE_WORDS = 300_000


def words_of(text: str) -> list[str]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased."""
    return [w for w in text.translate(LOWER).translate(SPLIT).split(" ") if w]


LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_bytes(text: bytes) -> list[bytes]:
    """The same words in UTF-8; bytes.split() cuts at just the six bytes."""
    return text.translate(LOWER_BYTES).split()


def pieces_of(model_path: str) -> tuple[list[str], np.ndarray]:
    """Pieces of a sentencepiece file and the natural log of their weights, from the file's scores.

    A file whose scores are log-probabilities keeps them. In one whose scores are merge ranks
    (0, -1, -2, ...) the piece of rank r weighs 1 / (r + 10). Byte pieces <0xNN> stand for the
    bytes of characters that no piece has; they and the pieces in no rank weigh as the last one.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = sp.vocab_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    score = np.array([sp.get_score(i) for i in range(n)])
    special = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)])
    byte = np.array([sp.is_byte(i) for i in range(n)])
    plain = ~special & ~byte & (score > -1e8)
    ranks = score[plain].min() < -100
    weight = np.where(plain, -np.log(10 - score) if ranks else score, 0.0)
    weight[~plain] = weight[plain].min()
    weight[special] = -np.inf
    weight[~special] -= np.log(np.exp(weight[~special]).sum())
    return pieces, weight


class Lattice:
    """Pieces by the hash of their characters, for words as rows of code points."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.bytes_at = np.full(256, -1)
        by_length: dict[int, list[tuple[int, int]]] = {}
        for i, p in enumerate(pieces):
            if len(p) == 6 and p.startswith("<0x"):
                self.bytes_at[int(p[3:5], 16)] = i
            elif p and not (p[0] == "<" and p[-1] == ">" and len(p) > 2):
                by_length.setdefault(len(p), []).append((self.hash(p), i))
        self.longest = max(by_length)
        self.table = {k: (np.array([h for h, _ in sorted(v)], np.uint64), np.array([i for _, i in sorted(v)])) for k, v in by_length.items()}
        self.filter = {k: np.zeros(1 << FILTER_BITS, bool) for k in self.table}
        for k, (keys, _) in self.table.items():
            self.filter[k][self.slot(keys)] = True
        self.single = np.full(0x110000, -1)
        for h, i in by_length.get(1, []):
            self.single[h - 1] = i

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return ((h * SPREAD) >> np.uint64(64 - FILTER_BITS)).view(np.int64)

    @staticmethod
    def hash(s: str) -> int:
        h = 0
        for c in s:
            h = (h * int(PRIME) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def arcs(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length k from 1: which piece starts at each position of each row with k characters; -1 for none."""
        rows, n = codes.shape
        codes = np.ascontiguousarray(codes.T)  # positions by rows: long loops, as words are short and many
        prefix = np.zeros((n + 1, rows), np.uint64)
        for j in range(n):
            prefix[j + 1] = prefix[j] * PRIME + codes[j] + np.uint64(1)
        out = [self.single[codes.astype(np.int64)].T]
        for k in range(2, min(n, self.longest) + 1):
            found = np.full((n - k + 1, rows), -1)
            out.append(found.T)
            if k in self.table:
                keys, ids = self.table[k]
                h = (prefix[k:] - prefix[:-k] * np.uint64(pow(int(PRIME), k, 1 << 64))).reshape(-1)
                able = np.flatnonzero(self.filter[k][self.slot(h)])  # most strings are no pieces; only these are looked up
                h = h[able]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                found.reshape(-1)[able] = np.where(keys[at] == h, ids[at], -1)
        return out

    def unknown(self, codes: np.ndarray, arcs: list[np.ndarray], log_p: np.ndarray) -> np.ndarray:
        """Log weight of each character that no single piece covers, spelt in bytes; -inf for the others."""
        out = np.full(codes.shape, -np.inf)
        bare = arcs[0] < 0
        if bare.any():
            for c in np.unique(codes[bare]).tolist():
                try:
                    spelt = chr(c).encode()
                except UnicodeEncodeError:
                    spelt = b"?"
                out[bare & (codes == c)] = sum(log_p[self.bytes_at[b]] for b in spelt)
        return out

    def forward(self, codes: np.ndarray, arcs: list[np.ndarray], log_p: np.ndarray, spelt: np.ndarray) -> np.ndarray:
        """Log of the summed weight of all segmentations of each prefix: rows by positions."""
        rows, n = codes.shape
        alpha = np.full((rows, n + 1), -np.inf)
        alpha[:, 0] = 0
        padded = np.append(log_p, -np.inf)
        for j in range(1, n + 1):
            ways = [alpha[:, j - 1] + spelt[:, j - 1]]
            ways += [alpha[:, j - k] + padded[arcs[k - 1][:, j - k]] for k in range(1, min(j, self.longest) + 1)]
            alpha[:, j] = np.logaddexp.reduce(ways, 0)
        return alpha

    def backward(self, codes: np.ndarray, arcs: list[np.ndarray], log_p: np.ndarray, spelt: np.ndarray) -> np.ndarray:
        rows, n = codes.shape
        beta = np.full((rows, n + 1), -np.inf)
        beta[:, n] = 0
        padded = np.append(log_p, -np.inf)
        for i in range(n - 1, -1, -1):
            ways = [beta[:, i + 1] + spelt[:, i]]
            ways += [beta[:, i + k] + padded[arcs[k - 1][:, i]] for k in range(1, min(n - i, self.longest) + 1)]
            beta[:, i] = np.logaddexp.reduce(ways, 0)
        return beta

    def expected(self, codes: np.ndarray, times: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the rows, each counted ``times``."""
        arcs = self.arcs(codes)
        spelt = self.unknown(codes, arcs, log_p)
        by = self.expected_short if codes.shape[1] <= LINEAR else self.expected_long
        return by(codes, times, log_p, arcs, spelt)

    def expected_long(self, codes: np.ndarray, times: np.ndarray, log_p: np.ndarray, arcs: list[np.ndarray], spelt: np.ndarray) -> np.ndarray:
        alpha, beta = self.forward(codes, arcs, log_p, spelt), self.backward(codes, arcs, log_p, spelt)
        total = alpha[:, -1:]
        padded = np.append(log_p, -np.inf)
        out = np.zeros(self.n)
        for k, ids in enumerate(arcs, 1):
            with np.errstate(invalid="ignore"):
                w = np.exp(alpha[:, :-k] + padded[ids] + beta[:, k:] - total) * times[:, None]
            keep = ids >= 0
            out += np.bincount(ids[keep], w[keep], self.n)
        with np.errstate(invalid="ignore"):
            w = np.exp(alpha[:, :-1] + spelt + beta[:, 1:] - total) * times[:, None]
        for i, j in zip(*np.nonzero(np.isfinite(spelt)), strict=True):
            for b in chr(int(codes[i, j])).encode("utf-8", "replace"):
                out[self.bytes_at[b]] += w[i, j]
        return out

    @staticmethod
    def ways(arcs: list[np.ndarray], log_p: np.ndarray, spelt: np.ndarray) -> list[np.ndarray]:
        """Probability of the piece of each length at each position: positions by rows; 0 for none."""
        p = np.append(np.exp(log_p), 0.0)
        out = [p[np.ascontiguousarray(ids.T)] for ids in arcs]
        if (bare := np.isfinite(spelt)).any():
            out[0] += np.where(bare, np.exp(spelt), 0.0).T
        return out

    @staticmethod
    def sums(ways: list[np.ndarray], rows: int, n: int) -> np.ndarray:
        """Summed weight of all segmentations of each prefix: positions by rows."""
        alpha = np.zeros((n + 1, rows))
        alpha[0] = 1
        for j in range(1, n + 1):
            for k in range(1, min(j, len(ways)) + 1):
                alpha[j] += alpha[j - k] * ways[k - 1][j - k]
        return alpha

    def expected_short(self, codes: np.ndarray, times: np.ndarray, log_p: np.ndarray, arcs: list[np.ndarray], spelt: np.ndarray) -> np.ndarray:
        """The same by sums of products, for words too short for them to vanish; those of characters spelt in bytes, where they do, by logarithms."""
        rows, n = codes.shape
        ways = self.ways(arcs, log_p, spelt)
        alpha = self.sums(ways, rows, n)
        if (low := alpha[n] < TINY).any():
            parts = [(by, (codes[on], times[on], log_p, [ids[on] for ids in arcs], spelt[on])) for by, on in ((self.expected_short, ~low), (self.expected_long, low)) if on.any()]
            return sum(by(*part) for by, part in parts)
        beta = np.zeros((n + 1, rows))
        beta[n] = 1
        for i in range(n - 1, -1, -1):
            for k in range(1, min(n - i, len(ways)) + 1):
                beta[i] += ways[k - 1][i] * beta[i + k]
        scale = times / alpha[n]
        out = np.zeros(self.n)
        for k, ids in enumerate(arcs, 1):
            w = alpha[:-k] * ways[k - 1] * beta[k:] * scale
            if k == 1:
                for i, j in zip(*np.nonzero(np.isfinite(spelt)), strict=True):
                    for b in chr(int(codes[i, j])).encode("utf-8", "replace"):
                        out[self.bytes_at[b]] += w[j, i]
            ids = ids.T.reshape(-1)
            at = np.flatnonzero(ids >= 0)
            out += np.bincount(ids[at], w.reshape(-1)[at], self.n)
        return out

    def log_prob(self, codes: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        arcs = self.arcs(codes)
        spelt = self.unknown(codes, arcs, log_p)
        if codes.shape[1] > LINEAR:
            return self.forward(codes, arcs, log_p, spelt)[:, -1]
        whole = self.sums(self.ways(arcs, log_p, spelt), *codes.shape)[-1]
        low = whole < TINY
        out = np.log(np.where(low, 1.0, whole))
        if low.any():
            out[low] = self.forward(codes[low], [ids[low] for ids in arcs], log_p, spelt[low])[:, -1]
        return out


def grouped(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Numbers of words of one length and their code points after the mark, in slices of bounded size."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for n, all_at in by.items():
        step = max(1, SLICE_CHARS // (16 * (n + 1)))
        for a in range(0, len(all_at), step):
            at = all_at[a : a + step]
            flat = np.frombuffer("".join(MARK + words[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield at, flat.reshape(len(at), n + 1).astype(np.uint64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): how often each word occurs in all training rows, 0 if only in others. Columns of ``docs``: train, text."""

    def flushed(train: Counter, every: set) -> Iterator[pa.RecordBatch]:
        words = [*train, *(w for w in every if w not in train)]
        for a in range(0, len(words), 50_000):
            part = words[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()).cast(pa.string()), pa.array([train.get(w, 0) for w in part], pa.int64())], names=["word", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, every = Counter(), set()
        for b in batches:
            for t, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                (train if t else every).update(word_bytes(text))
                if len(train) + len(every) > TABLE_WORDS:
                    yield from flushed(train, every)
                    train, every = Counter(), set()
        yield from flushed(train, every)

    return docs.mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def expected_uses(seen: DataFrame, pieces: list[str], log_p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in all words of (word, c); one number a piece comes to the driver."""
    sent = seen.sparkSession.sparkContext.broadcast((pieces, log_p))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, p = sent.value
        lattice, total = Lattice(names), np.zeros(len(names))
        for b in batches:
            words, times = b.column(0).to_pylist(), b.column(1).to_numpy()
            for at, codes in grouped(words):
                total += lattice.expected(codes, times[at].astype(float), p)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["piece", "n"])

    out = np.zeros(len(pieces))
    for piece, n in seen.mapInArrow(expect, "piece bigint, n double").groupBy("piece").agg(F.sum("n")).collect():
        out[piece] = n
    return out


def lattice_scores(df: DataFrame, train: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS, rounds: int = EM_ROUNDS) -> DataFrame:
    """``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` for every row of ``df``.

    ``train`` is the boolean column (an expression) that says which rows the model learns from.

    A text is a sequence of words and one end. The model draws pieces one by one; a word is drawn
    with the mark in front, and its probability is the sum over all segmentations into pieces of
    the products of the pieces' probabilities, by forward recursion in log space. As words don't
    share pieces, a text's log-probability is the sum over its words, plus the end's. The pieces'
    probabilities start from the vocabulary's own scores; ``rounds`` (1 or more) rounds of expectation over
    all segmentations of all training words re-estimate them, the vocabulary's weights counting for
    PRIOR_PIECES pieces, so every piece keeps some probability. ``base_score`` is the smoothed
    word-unigram score. Both are log10.

    Counting and scoring work on distinct words: (word, count, log-probability) is a table of the
    whole corpus that grows with it. Texts look frequent words up in a broadcast head of at most
    ``head_words``; the remaining (text, word, times) rows join the table, none of whose words is
    frequent, so no key is hot. What comes to the driver is one number a piece, two totals and
    the head.

    Null texts count as empty: one token, the end. With no training rows N = 0, V = 0, every count is
    0 (base: log10(0.5 / 0.5) a token) and the pieces keep the vocabulary's weights. Repeated rows are
    rows of their own. Words of any length are scored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    base = df.select(F.col(id_col).alias("_id"), train.alias("_train"), text_of(text_col).alias("_text"))
    counts = materialize(word_counts(base.select("_train", "_text")), "words")
    ends = base.where("_train").count()
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("c") > 0, 1)), F.lit(0))).first()
    n_all, v_all = int(tokens) + ends, int(distinct) + (ends > 0)
    pieces, prior = pieces_of(model_path)
    seen = counts.where("c > 0").select("word", "c")
    log_p, end = prior, 0.0
    for _ in range(rounds):
        expected = expected_uses(seen, pieces, log_p)
        weight = expected + PRIOR_PIECES * np.where(np.isfinite(prior), np.exp(prior), 0)
        whole = weight.sum() + ends + 1
        with np.errstate(divide="ignore"):
            log_p = np.log(weight / whole)
        end = math.log10((ends + 1) / whole)
    second = spark.sparkContext.broadcast((pieces, log_p))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, p = second.value
        lattice = Lattice(names)
        for b in batches:
            words = b.column(0).to_pylist()
            out = np.empty(len(words))
            for at, codes in grouped(words):
                out[at] = lattice.log_prob(codes, p) / math.log(10)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], names=["word", "c", "lp"])

    table = materialize(counts.mapInArrow(score, "word string, c bigint, lp double"), "word-scores")
    head_rows = table.where("c > 1").orderBy(F.desc("c"), "word").limit(head_words).collect()
    head = spark.sparkContext.broadcast(([r["word"].encode() for r in head_rows], [r["c"] for r in head_rows], [r["lp"] for r in head_rows]))
    low = n_all + 0.5 * (v_all + 1)
    of_count = lambda c: math.log10((c + 0.5) / low)
    end_base, known_end = of_count(ends), int(ends > 0)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts_, logs = head.value
        number = dict(zip(words, range(len(words)), strict=True)).get
        # One more entry, of zeros, for words that aren't in the head: number -1.
        base_of = np.append([of_count(c) for c in counts_], 0.0)
        log_of, seen = np.append(logs, 0.0), np.append(np.array(counts_) > 0, False)
        names = ["_row", "_id", "_train", "word", "times", "n_tokens", "n_known", "base", "score"]
        none = repeat(-1)
        for batch in batches:
            n = batch.num_rows
            rows = batch.column(0).to_numpy()
            totals, rest_row, rest_word, rest_times = np.zeros((4, n)), [], [], []
            for i, text in enumerate(batch.column(3).cast(pa.binary()).to_pylist()):
                tokens = word_bytes(text)
                at = np.fromiter(map(number, tokens, none), np.int64, len(tokens))
                totals[:, i] = len(tokens) + 1, seen[at].sum() + known_end, base_of[at].sum() + end_base, log_of[at].sum() + end
                if len(rare := np.flatnonzero(at < 0)):
                    found = Counter([tokens[j] for j in rare.tolist()])
                    rest_row += [rows[i]] * len(found)
                    rest_word += found
                    rest_times += found.values()
            m = len(rest_word)
            none_of = lambda t: pa.nulls(m, t)
            zeros = np.zeros(m, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.nulls(n, pa.string()), pa.array(np.zeros(n, np.int64)), pa.array(totals[0].astype(np.int64)), pa.array(totals[1].astype(np.int64)), pa.array(totals[2]), pa.array(totals[3])], names=names)
            if m:
                yield pa.RecordBatch.from_arrays([pa.array(rest_row, pa.int64()), none_of(batch.column(1).type), none_of(pa.bool_()), pa.array(rest_word, pa.binary()).cast(pa.string()), pa.array(rest_times, pa.int64()), pa.array(zeros), pa.array(zeros), pa.array(zeros.astype(float)), pa.array(zeros.astype(float))], names=names)

    numbered = base.withColumn("_row", F.monotonically_increasing_id())
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"_row bigint, _id {kind}, _train boolean, word string, times bigint, n_tokens bigint, n_known bigint, base double, score double"
    looked = materialize(numbered.select("_row", "_id", "_train", "_text").mapInArrow(look, schema), "looked")
    ids = looked.where(F.col("word").isNull()).select("_row", "_id", "_train")
    rest = looked.where(F.col("word").isNotNull()).select("_row", "word", "times").join(table, "word")
    rest = rest.select("_row", F.lit(0).cast("bigint").alias("n_tokens"), F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("n_known"), (F.col("times") * F.log10((F.col("c") + 0.5) / F.lit(low))).alias("base"), (F.col("times") * F.col("lp")).alias("score"))
    parts = looked.where(F.col("word").isNull()).select("_row", "n_tokens", "n_known", "base", "score").unionByName(rest)
    sums = parts.groupBy("_row").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    return ids.join(sums, "_row").select(
        F.col("_id").alias(id_col), (~F.col("_train")).alias("held_out"), "n_tokens", "n_known",
        F.lit(n_all).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_lattice(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    return lattice_scores(read(spark, sf_dir, "documents"), fold() != 1, model_path or default_pieces())
