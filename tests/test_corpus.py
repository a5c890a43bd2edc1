"""Near dedupe of dense groups: many edits of one page, settled without their pairs."""

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.operators import corpus

WORDS = 120


def edits(i):
    """Words of document i: one of two pages with one word changed, or four in a few of them."""
    at = [(i * 7 + 31 * k) % WORDS for k in range(4 if i % 500 == 250 else 1)]
    return [f"e{i}" if j in at else f"{'ab'[i % 2]}{j}" for j in range(WORDS)]


def test_twenty_thousand_edits_of_two_pages(spark, monkeypatch):
    """The rows that meet grow with the documents, not with their pairs, and the result is the greedy one."""
    n, made = 20_000, {}
    kept = corpus.written

    def watched(df, name, *a):
        out = kept(df, name, *a)
        made[name] = made.get(name, 0) + (out.count() if name in ("stars", "gone") else 0)
        return out

    monkeypatch.setattr(corpus, "written", watched)
    i, j = F.col("id"), F.col("j")
    at = F.when(i % 500 == 250, F.array(*((i * 7 + 31 * k) % WORDS for k in range(4)))).otherwise(F.array(i * 7 % WORDS))
    words = spark.range(n).select("id", at.alias("at"), F.explode(F.sequence(F.lit(0), F.lit(WORDS - 1))).alias("j")).select("id", "j", F.when(F.array_contains("at", j.cast("bigint")), F.concat(F.lit("e"), i.cast("string"))).otherwise(F.concat(F.when(i % 2 == 0, "a").otherwise("b"), j.cast("string"))).alias("w"))
    texts = words.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "w"))), lambda x: x["w"]).alias("words"))
    sets = texts.select("id", X.ngrams(F.col("words"), 5).alias("set"))
    got = {r["id"] for r in corpus.greedy_kept(sets).collect()}
    stay: list[tuple[int, set]] = []
    for d in range(n):
        w = edits(d)
        s = {" ".join(w[k : k + 5]) for k in range(WORDS - 4)}
        if not any(len(s & t) >= 0.8 * len(s | t) for _, t in stay):
            stay.append((d, s))
    assert got == {d for d, _ in stay} and 2 < len(got) < 60
    assert made["stars"] <= 4 * n and made["gone"] <= n


def test_greedy_on_small_sets(spark):
    rows = [(5, ["a", "b", "c", "d", "e"]), (1, ["a", "b", "c", "d"]), (2, ["a", "b", "c", "d"]), (3, []), (4, ["x"]), (6, ["x", "x"]), (7, ["p", "q", "r", "s", "t"]), (8, ["q", "r", "s", "t", "u"])]
    got = sorted(r["id"] for r in corpus.greedy_kept(spark.createDataFrame(rows, "id int, set array<string>")).collect())
    assert got == [1, 3, 4, 7, 8]  # 5 is 0.8 like 1; 7 and 8 are 4 of 6
    assert corpus.greedy_kept(spark.createDataFrame([], "id int, set array<string>")).count() == 0


def test_a_chain_of_sets_that_only_share_elements_takes_no_round_each(spark, monkeypatch):
    """Neighbours share seven of ten elements and are not alike; every eleventh is like the one before."""
    made, keep = [], corpus.written
    monkeypatch.setattr(corpus, "written", lambda df, name, *a: made.append(name) or keep(df, name, *a))
    rows = [(i, [f"e{j}" for j in range(3 * i, 3 * i + 10)]) for i in range(40)] + [(100 + i, [f"e{j}" for j in range(33 * i, 33 * i + 9)]) for i in range(3)]
    got = sorted(r["id"] for r in corpus.greedy_kept(spark.createDataFrame(rows, "id int, set array<string>")).collect())
    assert got == list(range(40))
    assert len(made) <= 8


def test_links_of_random_sets_equal_brute_force(spark):
    """Sets of all sizes that share many elements: none that can have a link drops out by its first elements."""
    rng = random.Random(5)
    sets = []
    for _ in range(60):
        base = rng.sample(range(400), rng.choice([1, 2, 5, 9, 10, 20, 41, 100]))
        sets += [set(base[rng.choice([0, 0, 1, len(base) // 9]) :]) | set(rng.sample(range(400), rng.choice([0, 1, len(base) // 9]))) for _ in range(4)]
    want = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if a and b and len(a & b) >= 0.8 * len(a | b)}
    rows = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in enumerate(sets)], "id int, set array<string>")
    assert {(r["i"], r["j"]) for r in corpus.near_pairs(rows).collect()} == want and len(want) > 100


def test_sequential_ids_past_four_digits_and_without_source_equal_the_sql(spark, tmp_path):
    from glyphmill.plans import corpus_queries as Q

    duckdb = pytest.importorskip("duckdb")
    path = f"{tmp_path}/documents.parquet"
    spark.range(10_020).select(F.col("id").alias("doc_id"), F.when(F.col("id") > 5, "web").alias("source")).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as from '{path}/*.parquet'")
    assert sorted(map(tuple, Q.sequential(spark, str(tmp_path)).collect())) == sorted(con.execute(Q.ORACLE_SQL["C13_sequential_ids"]).fetchall())
