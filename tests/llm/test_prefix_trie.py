"""The trie of conversations against a plain one: buckets and parts of any size, ties, nulls, copies, and the SQL."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import prefix_trie
from glyphmill.llm.common import ship
from glyphmill.sources import tables

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Nodes of (conv, turn, role, text) rows, from dictionaries of prefixes."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members, kids = {}, {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in below)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if whole[c] == p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(seed, n=140):
    rng = random.Random(seed)
    rows = []
    for c in [*rng.sample(range(-120, 900), n), 100, 200]:
        first = rng.choice(["system prompt é🎉", "hello", None])
        shared = [("user", first)] + [("a", f"same {j}") for j in range(rng.choice([0, 1, 7, 7]))]
        for j, (role, text) in enumerate(shared + [(rng.choice(["u", "a", None]), rng.choice(["x", "y", "", None, "long " * 30])) for _ in range(rng.randrange(5))]):
            rows.append((c, j, role, text))
    copies = [("u", "copied"), ("a", "copied too"), ("u", "and this"), ("a", "b"), ("u", "c"), ("a", "d"), ("u", "e")]
    rows += [(1000 + i, j, *t) for i in range(60) for j, t in enumerate(copies)]  # equal but for the base's turns
    rows += [(2000, j, "u", f"turn {j % 3}") for j in range(90)] + [(2100, j, "u", f"turn {j % 3}") for j in range(90)] + [(2200, j, "u", f"turn {j % 3}" if j < 75 else "other") for j in range(95)] + [(2300, j, "u", f"turn {j % 3}") for j in range(40)]
    rows += [(3001, None, "u", "null turn"), (3001, 0, "u", "z"), (3001, 0, "u", "a"), (3001, 0, "u", "a"), (None, 0, "u", "no conversation"), (3077, 5, "u", "only")]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("bucket, turns, part, ranges", [(20_000, 1_000_000, 100_000, 500_000), (3, 1_000_000, 100_000, 500_000), (1, 10, 20, 16), (5, 40, 30, 500_000)])
def test_prefix_trie(spark, monkeypatch, bucket, turns, part, ranges):
    ship(spark)
    monkeypatch.setattr(prefix_trie, "PART", part)
    monkeypatch.setattr(tables, "RANGE_ROWS", ranges)
    rows = table(bucket)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("x"), "n": F.lit(1), "id": F.lit(2), "codes": F.lit(3)})
    got = prefix_trie.prefix_trie(df, bucket=bucket, bucket_turns=turns)
    assert got.columns == NAMES
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_empty_and_turnless(spark):
    ship(spark)
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(none).count() == 0
    rows = [(c, 0, "u", "t") for c in range(901, 930)]  # no base: those with h > 0 are turnless
    assert sorted(map(tuple, prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == plain(rows)
    nulls = spark.createDataFrame([(None, 1, "u", "t")], SCHEMA)
    assert prefix_trie.prefix_trie(nulls).count() == 0


def test_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    df = prefix_trie.op13_prefix_trie(spark, sf)
    want = con.execute(prefix_trie.OP13_SQL)
    assert df.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want.fetchall(), key=str)
