"""Ranked search against scores of all pairs: small segments and rounds, ties, nulls, repeated rows, blocks of items, and the SQL."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import lexical
from glyphmill.llm.common import ship


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """(item, rank, id, score) from every pair; docs and items are lists of (id, text)."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        scored = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in words if w in c)
            if s > 0:
                scored.append((-s, i is None, i, -s))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, i, -s) for r, (s, _, i, _) in enumerate(scored[:k], 1)]
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def test_terms_of_any_text():
    text = "".join(map(chr, range(0, 0x250))) + " É x🎉y" + "A1_b\x7fc" * 3
    assert [t.decode() for t in lexical.terms_of(text)] == terms(text)


@pytest.fixture(scope="module")
def table():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 30, 200])))) for i in range(400)]
    docs += [(1000 + i, "w1 w150 W150, w7") for i in range(40)]  # ties
    docs += [(None, "w1 w150 w150 w7"), (None, None), (5, "w3 w160"), (5, "w3 w160"), (2000, None), (2001, " ,.; "), (2002, "É é w9"), (2003, "w2 " * 30_000)]
    items = [(i, " ".join(rng.choices(words, k=25))) for i in range(30)]
    items += [(90, "w1 w150"), (90, "w7"), (91, None), (92, "nowhere"), (None, "w3 é"), (93, "w0")]
    return docs, items


@pytest.mark.parametrize("segment, first, k, block", [(300, 8, 5, 2000), (300, 64, 50, 7), (2_000_000, 8192, 50, 2000), (2_000_000, 16, 3, 2000)])
def test_search(spark, table, monkeypatch, segment, first, k, block):
    ship(spark)
    for name, value in (("SEGMENT", segment), ("ROUND", first), ("SPARE", 2), ("BLOCK_ITEMS", block)):
        monkeypatch.setattr(lexical, name, value)
    docs = spark.createDataFrame(table[0], "doc_id bigint, text string").withColumns({"rank": F.lit(1), "score": F.lit("x"), "item_id": F.lit(2)})
    items = spark.createDataFrame(table[1], "item_id bigint, text string").withColumn("doc_id", F.lit(3))
    got = [tuple(r) for r in lexical.lexical_search(docs, items, k=k).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=lambda x: (x[0] is not None, x[0] or 0, x[1])) == plain(*table, k)


def test_empty_tables(spark, table):
    ship(spark)
    docs = spark.createDataFrame(table[0], "doc_id bigint, text string")
    items = spark.createDataFrame(table[1], "item_id bigint, text string")
    assert lexical.lexical_search(docs.where("doc_id < 0"), items).count() == 0
    assert lexical.lexical_search(docs, items.where("item_id < 0")).count() == 0
    assert lexical.lexical_search(docs.withColumn("text", F.lit(None).cast("string")), items).count() == 0


def test_search_stops_before_the_last_posting():
    """One rare term decides: the frequent term's many postings are never added up."""
    rng = np.random.default_rng(1)
    n = 20_000
    doc = np.concatenate([np.repeat(np.arange(n), 1), np.arange(60)])
    term = np.concatenate([np.zeros(n, np.int64), np.ones(60, np.int64)])
    impact = np.concatenate([rng.integers(1, 50, n), np.full(60, 10_000) + np.arange(60)])
    order = np.lexsort([term, doc])
    segment = lexical.Segment(np.arange(n), doc[order], term[order], impact[order], 2)
    seen = []
    inner = segment.whole
    segment.whole = lambda docs, asked: seen.append(len(docs)) or inner(docs, asked)
    at, score = segment.search(np.array([0, 1]), np.array([True, True]), 10, np.empty(0, np.int64))
    assert seen and seen[0] <= lexical.SPARE * 10
    want = np.zeros(n, np.int64)
    np.add.at(want, doc, impact)
    top = lexical.best(np.arange(n), np.zeros(n, bool), want, 10)
    keep = lexical.best(at, np.zeros(len(at), bool), score, 10)
    assert at[keep].tolist() == top.tolist() and score[keep].tolist() == want[top].tolist()


def test_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = lexical.op12_lexical(spark, sf)
    want = con.execute(lexical.OP12_SQL)
    assert df.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
