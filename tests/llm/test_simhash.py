"""SimHash linking against all pairs: trees of any size of unit, dense groups, and the edge cases of a table."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphmill.llm import simhash
from glyphmill.llm.common import ship


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, bits):
    """Smallest id reachable for each (id, fingerprint); rows of one id are one document."""
    least = {}
    for i, k in prints:
        least[i] = i
    while True:
        before = dict(least)
        for i, k in prints:
            for j, q in prints:
                if bin(k ^ q).count("1") <= bits:
                    low = min(least[i], least[j])
                    least[i] = least[j] = low
        if least == before:
            return least


def test_fingerprints_are_of_all_shingles():
    rng = random.Random(1)
    vocab = ["Ab", "c", "dé", "ß", "É", "zz9", "q" * 50]
    for n in (0, 1, 2, 3, 4, 50, 400, 70_000):
        text = "".join(rng.choice(vocab) + rng.choice([" ", "\t", "\n\x0b ", "\x0c"]) for _ in range(n))
        assert simhash.fingerprint(text) == plain(text)
    assert simhash.fingerprint("a b") == plain("a b")  # no other white space cuts


@pytest.mark.parametrize("bits", [1, 2, 3, 5])
def test_tries_join_what_all_pairs_join(bits):
    rng = np.random.default_rng(bits)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    keys = [seeds]
    for _ in range(40):  # chains and dense groups round the seeds
        x = rng.choice(np.concatenate(keys), 30)
        keys.append(x ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)))
    keys = np.unique(np.concatenate(keys))
    forest, plain_one = simhash.Forest(keys, bits), simhash.Forest(keys, bits)
    zero = np.array([0])
    forest.join(0, zero, np.array([len(keys)]), zero, np.array([len(keys)]), zero)
    for i in range(len(keys)):
        j = np.flatnonzero(np.bitwise_count(keys[i + 1 :] ^ keys[i]) <= bits) + i + 1
        plain_one.link(np.full(len(j), i), j)
    assert (forest.label == plain_one.label).all()


@pytest.mark.parametrize("unit", [4, 50, 50_000])
def test_units_of_any_size(spark, unit, monkeypatch):
    """Keys that agree in their first 30 bits: with small units each trie is cut again and again, down to its leaves."""
    ship(spark)
    monkeypatch.setattr(simhash, "WINDOW", 64)
    rng = np.random.default_rng(5)
    tails = np.unique(np.concatenate([rng.integers(0, 1 << 12, 150), rng.integers(0, 1 << 34, 60)])).astype(np.uint64)
    keys = tails | (np.uint64(0xABCDEF01) << np.uint64(34))
    want = simhash.Forest(keys, 3)
    for i in range(len(keys)):
        j = np.flatnonzero(np.bitwise_count(keys[i + 1 :] ^ keys[i]) <= 3) + i + 1
        want.link(np.full(len(j), i), j)
    rows = [(int(k), i) for i, k in enumerate(keys.view(np.int64))]
    links = simhash.trie_links(spark.createDataFrame(rows, "key bigint, rep bigint"), 3, unit).collect()
    got = simhash.Forest(keys, 3)
    got.link(np.array([r["a"] for r in links]), np.array([r["b"] for r in links]))
    assert (got.label == want.label).all()
    assert all(bin(int(keys[r["a"]]) ^ int(keys[r["b"]])).count("1") <= 64 for r in links)


def test_simhash_dedup(spark):
    ship(spark)
    rng = random.Random(3)
    base = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta".split()) for _ in range(300))
    texts = [None, "", " \n", "One", "one", "two words", base, base, base + " end", base.upper(), base[:900], "x" * 50_000, "é " * 40, base + " a b"]
    rows = [(i, t, "f", 7) for i, t in enumerate(texts)] + [(None, base, "f", 7), (3, base, "f", 7), (3, base, "f", 7), (20, "another", None, None), (20, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string, key bigint").withColumn("rep", F.lit("r"))
    got = simhash.simhash_dedup(df).collect()
    assert len(got) == len(rows)
    want = classes([(i, plain(t)) for i, t, _, _ in rows if i is not None], 3)
    prints = {i: set() for i, *_ in rows}
    for i, t, _, _ in rows:
        prints[i].add(f"{plain(t):016x}")
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"]) and r["fingerprint"] in prints[r["doc_id"]]
    assert sorted(r["fingerprint"] for r in got) == sorted(f"{plain(t):016x}" for _, t, _, _ in rows)
    assert want[20] == 0 and want[6] == 3  # empty texts are linked; rows of one id are one document
    assert simhash.simhash_dedup(df.where("doc_id < 0")).count() == 0
    nulls = simhash.simhash_dedup(df.withColumn("doc_id", F.lit(None).cast("bigint"))).collect()
    assert len(nulls) == len(rows) and all(r["component_id"] is None for r in nulls)


def test_query_on_the_given_tables(spark):
    import pandas as pd

    sf = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in simhash.op11_simhash(spark, sf).collect()}
    prints = [(i, plain(t)) for i, t in zip(docs.doc_id.tolist(), docs.text, strict=True)]
    keys = sorted({k for _, k in prints})
    near = classes([(i, k) for i, k in enumerate(keys)], 3)
    component = {k: near[i] for i, k in enumerate(keys)}
    least = {}
    for i, k in prints:
        least[component[k]] = min(i, least.get(component[k], i))
    assert len(got) == len(prints)
    for i, k in prints:
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{k:016x}", least[component[k]])
