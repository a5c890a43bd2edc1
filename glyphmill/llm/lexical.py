"""Ranked lexical search: impact-ordered postings, a score at a time, with a proof before stopping."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm.common import materialize, read, text_of

TOP = 50
#: Items, and bytes of their texts, that are searched together, about; more go in several blocks.
BLOCK_ITEMS, BLOCK_BYTES = 2_000, 16 << 20
#: Postings and documents of a segment: what a task holds at once.
SEGMENT, SEGMENT_DOCS = 2_000_000, 40_000
#: Up to so many pairs of a segment's document and an item's term it is noted which terms a document has had.
NOTED = 1 << 26
#: Postings of an item's first round in a segment; each round takes twice as many as the one before.
ROUND = 8_192
#: Candidates, as a multiple of the rows asked for, whose scores are completed rather than accumulated.
SPARE = 8

#: Runs of ASCII letters, digits and all that is not ASCII are terms; only A-Z are lower-cased.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLDED).split()


class Segment:
    """Some documents' postings, by term and grouped by exact impact in descending order, and by document."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        self.ids, self.term, self.impact = ids, term, impact
        self.starts = np.searchsorted(doc, np.arange(len(ids) + 1))  # of each document
        order = np.lexsort([-impact, term])
        self.docs, term, impact = doc[order], term[order], impact[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (impact[1:] != impact[:-1])
        self.at = np.append(np.flatnonzero(new), len(term))  # where each group begins
        self.level = impact[self.at[:-1]]
        self.groups = np.searchsorted(term[self.at[:-1]], np.arange(n_terms + 1))  # of each term

    def whole(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Scores of documents, from their own postings. ``asked`` marks the item's terms."""
        place, which = spans(self.starts[docs], self.starts[docs + 1])
        own = asked[self.term[place]]
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, which[own], self.impact[place[own]])
        return out

    def search(self, terms: np.ndarray, asked: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the first k, and their scores. ``known``: scores of k documents found elsewhere, or fewer.

        The groups of all the item's terms go in descending order of impact, a round of them at a time. What a
        document can still get is at most the sum of each term's next impact, less that of the terms it has
        had. The k-th highest sum so far is a floor of the k-th highest score; a document that can't reach it
        is out. When few others are left, nothing else can be among the first k: theirs are completed.
        """
        place, which = spans(self.groups[terms], self.groups[terms + 1])
        order = np.argsort(-self.level[place], kind="stable")
        place, which = place[order], which[order]
        size = self.at[place + 1] - self.at[place]
        ends = np.cumsum(size)
        acc = np.zeros(len(self.ids), np.int64)
        had = np.zeros((len(self.ids), len(terms)), bool) if len(self.ids) * len(terms) <= NOTED else None
        done, took, quota = np.zeros(len(terms), np.int64), 0, ROUND
        last = np.append(self.level, 0)
        candidates = np.arange(len(self.ids))
        while took < len(place):
            upto = max(took + 1, int(np.searchsorted(ends, (ends[took - 1] if took else 0) + quota)))
            now, term = place[took:upto], which[took:upto]
            rows, group = spans(self.at[now], self.at[now + 1])
            docs = self.docs[rows]
            np.add.at(acc, docs, self.level[now][group])
            if had is not None:
                had[docs, term[group]] = True
            done += np.bincount(term, minlength=len(terms))
            took, quota = upto, quota * 2
            there = self.groups[terms] + done
            rest = np.where(there < self.groups[terms + 1], last[there], 0)
            sums = np.concatenate([acc, known])
            floor = max(1, int(np.partition(sums, len(sums) - k)[len(sums) - k])) if len(sums) >= k else 1
            candidates = candidates[acc[candidates] + rest.sum() >= floor]
            if len(candidates) > SPARE * k and had is not None:
                can = acc[candidates] + rest.sum() - had[candidates] @ rest
                candidates = candidates[can >= floor]
            if len(candidates) <= SPARE * k:
                break
        score = acc[candidates] if took == len(place) else self.whole(candidates, asked)
        return candidates[score > 0], score[score > 0]


def spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of the ranges [lo, hi), one after the other, and the number of the range of each."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[which], which


def best(ids: np.ndarray, null: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k by descending score, then ascending id, null last."""
    return np.lexsort([ids, null, -scores])[:k]


def search_block(docs: DataFrame, items: list[tuple[int | None, set[bytes]]], k: int) -> DataFrame:
    """(item_id, doc_id, score): a task's first k documents of each item, a superset of the first k of all."""
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(s for _, s in items))))}
    asked = [(item, np.array(sorted(vocabulary[t] for t in s), np.int64)) for item, s in items if s]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = terms_of(text)
                if words:
                    found = Counter(vocabulary[w] for w in words if w in vocabulary)
                    out.append((i, len(words), list(found), list(found.values())))
            ids, n, terms, times = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], names=["id", "n", "terms", "times"])

    counted = materialize(docs.mapInArrow(scan, "id bigint, n bigint, terms array<int>, times array<int>"), "terms")
    size, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = np.zeros(len(vocabulary), np.int64)
    for term, w in df.select("term", F.floor(F.lit(1000) * F.log((2 * F.lit(size) + 2).cast("double") / (2 * F.col("df") + 1)))).collect():  # one row a term of the block
        weight[term] = w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))
        found = [empty] * len(asked)
        held, n, rows = [], 0, 0

        def flush() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            lists = t.column("terms").combine_chunks()
            times = np.asarray(t.column("times").combine_chunks().flatten(), np.int64)
            term = np.asarray(lists.flatten(), np.int64)
            words = t.column("n").to_numpy()
            doc = np.repeat(np.arange(len(words)), np.diff(np.asarray(lists.offsets)))
            m = 50 + 50 * words * size // total
            impact = weight[term] * (1_000_000_000 * times // (1000 * times + 20 * m[doc]))
            null = t.column("id").is_null().to_numpy()
            segment = Segment(t.column("id").fill_null(0).to_numpy(), doc, term, impact, len(vocabulary))
            mark = np.zeros(len(vocabulary), bool)
            for i, (_, terms) in enumerate(asked):
                mark[terms] = True
                at, score = segment.search(terms, mark, k, found[i][2])
                mark[terms] = False
                all_of = [np.concatenate(c) for c in zip(found[i], (segment.ids[at], null[at], score), strict=True)]
                keep = best(*all_of, k)
                found[i] = tuple(c[keep] for c in all_of)

        for b in batches:
            for a in range(0, len(b), 256):
                part = b.slice(a, 256)
                held.append(part)
                n, rows = n + len(part.column("terms").flatten()), rows + len(part)
                if n >= SEGMENT or rows >= SEGMENT_DOCS:
                    flush()
                    held, n, rows = [], 0, 0
        if held:
            flush()
        for (item, _), (ids, null, score) in zip(asked, found, strict=True):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), pa.int64()), pa.array(ids, mask=null), pa.array(score)], names=["item_id", "doc_id", "score"])

    return counted.where("size(terms) > 0").mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def lexical_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's ``k`` documents of the highest score above 0, equal scores by ascending id.

    Terms, weights and scores are whole numbers as the contract of ``op12`` has them, over the whole texts. A first
    pass counts the terms that any item asks for and writes them by document; N, L and the documents of
    each term are aggregations of that. The second pass is a score-at-a-time search: a task
    takes its documents in segments of SEGMENT postings, groups each term's postings by exact impact and goes
    through them from the highest (``Segment.search``), with the task's scores so far as a floor. What a task passes on is ``k`` rows an
    item, whatever it read; a ranking of those is the answer, as a document among the first ``k`` of all is
    among the first of its task. Documents are dealt out by rows, so no term, however frequent, lands in one task.

    Items go in blocks of about BLOCK_ITEMS and BLOCK_BYTES by a hash of their id: a block's terms are what tasks get by broadcast.
    Each block is a search of its own over all documents.

    Null texts have no terms. Rows that repeat an item's id are one item with the terms of all; a null item id is one, too. Rows that repeat a
    document's id are ranked each by itself; a null id comes last among equal scores. An item without terms, or of
    which no document has any, has no rows; other columns aren't read; empty tables give an empty result.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("bigint").alias("item"), text_of(item_text_col).alias("text"))
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / BLOCK_ITEMS), math.ceil(size / BLOCK_BYTES))
    found = []
    for i in range(blocks):
        terms: dict[int | None, set[bytes]] = {}
        for item, text in asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).toLocalIterator():
            terms.setdefault(item, set()).update(terms_of(text))
        part = search_block(base, list(terms.items()), k)
        found.append(materialize(part, "found") if blocks > 1 else part)
    place = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def terms_sql(text: str) -> str:
    return rf"unnest(regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"


OP12_SQL = f"""
WITH words AS (SELECT doc_id, {terms_sql("text")} AS term FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), total),
asked AS (SELECT DISTINCT item_id, {terms_sql("text")} AS term FROM benchmark),
impacts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))) AS impact FROM postings JOIN lengths USING (doc_id) JOIN weights USING (term), total),
scores AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= {TOP}
"""
