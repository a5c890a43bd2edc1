"""Texts of over 300 sentences are read for repeated ideas by the queries that have no such end."""

import random
import re

import pytest

from glyphmill.operators import detector
from glyphmill.plans import registry
from tests.test_oracle import norm


def sentences(n, rng):
    some = [f"{a}{b}kata{c}" for a in "bcdfg" for b in "aeiou" for c in "mnprst"]
    return [" ".join(rng.sample(some, rng.randint(5, 9))).capitalize() + "." for _ in range(n)]


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = []
    for i, (n, again) in enumerate([(310, 2), (310, 1), (320, 0), (300, 2), (301, 3), (3, 2)]):
        sents = sentences(n, rng)
        sents += [" ".join(reversed(s.rstrip(".").lower().split())).capitalize() + "." for s in sents[:again]] if n > 300 else sents[:again]
        rows.append((i, " ".join(sents)))
    sf = tmp_path_factory.mktemp("long")
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{sf}/documents.parquet")
    return str(sf)


@pytest.mark.parametrize("name", ["F10_bands", "F13_F14_fusion", "IO16_report", "S29_reasons"])
def test_long_texts_match_sql(spark, long_texts, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{long_texts}/documents.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, long_texts)
    found = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(tuple(norm(r[names.index(c)]) for c in df.columns) for r in found.fetchall())
    got = sorted(tuple(norm(r[c]) for c in df.columns) for r in df.collect())
    assert got == want
    if name == "S29_reasons":
        told = {int(r[0]) for r in got if "ide yang mirip" in r[1]}
        assert {0, 4} <= told and not {1, 2} & told


def test_ideas_of_long_texts_equal_brute_force(spark):
    rng = random.Random(9)
    docs = []
    for i in range(12):
        sents = sentences(rng.choice([4, 30, 301, 350]), rng)
        for _ in range(rng.randint(0, 3)):
            kept = [w for w in rng.choice(sents).split() if rng.random() < 0.8]
            sents.insert(rng.randrange(len(sents)), " ".join(kept + rng.sample(["satuhal", "duahal"], 1)))
        docs.append((i, sents))
    df = spark.createDataFrame(docs, "i int, sents array<string>").selectExpr("*", "size(sents) AS n_sents")
    got = {r["i"]: r["idea_pairs"] for r in detector.repeated_ideas(df, None).collect()}
    ended = {r["i"]: r["idea_pairs"] for r in detector.repeated_ideas(df).collect()}
    for i, sents in docs:
        bags = [set(re.findall(r"[a-z]{4,}", s.lower())) for s in sents]
        found = sum(any(len(a & b) / len(a | b) > 0.55 for b in bags[k + 1 :]) for k, a in enumerate(bags))
        assert got[i] == min(found, 2)
        assert ended[i] == (got[i] if len(sents) <= 300 else 0)
    assert {0, 1, 2} <= set(got.values())
