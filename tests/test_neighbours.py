"""The inverted file against all products: clusters, one very common vector, missing ones, blocks of any size, recall."""

import numpy as np
import pytest

from glyphmill.operators import neighbours


def plain(rows, asked, k):
    out = set()
    size = 16
    unit = lambda v: (lambda x: x / n if (n := np.linalg.norm(x)) > 0 else x)(np.array(v if v is not None and len(v) == size and None not in v else [0.0] * size, float))
    there = [(i, unit(v)) for i, v in rows if i is not None]
    for q, x in asked:
        if q is not None:
            u = unit(x)
            found = sorted((-round(float(u @ v), 6) + 0.0, i) for i, v in there if i != q)[:k]
            out |= {(q, i, -s + 0.0, p) for p, (s, i) in enumerate(found, 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    vectors = [centres[i % 12] + 0.15 * rng.normal(size=16) for i in range(700)] + [centres[0]] * 300 + list(rng.normal(size=(80, 16)))
    out = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(vectors)]
    return out + [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0] * 7), (2004, [1.0] + [None] * 15), (None, out[0][1])]


@pytest.mark.parametrize("block, sets, cells", [(50_000, 20_000, None), (60, 15, 9), (50_000, 20_000, 1)])
def test_exact_lists(spark, rows, monkeypatch, block, sets, cells):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    monkeypatch.setattr(neighbours, "BLOCK_ASKED", sets)
    asked = [r for r in rows if r[0] is None or r[0] % 20 == 0 or r[0] > 1990]
    make = lambda r, n: spark.createDataFrame(r, f"{n} bigint, v array<float>")
    got = neighbours.nearest(make(rows, "i"), make(asked, "q"), 5, exact=True, cells=cells).collect()
    want = plain(rows, asked, 5)
    assert {(r["q"], r["id"], round(r["sim"], 6), r["place"]) for r in got} == {(q, i, round(s, 6), p) for q, i, s, p in want} and len(got) == len(want)


def test_probed_lists_recall(spark, rows):
    make = lambda r, n: spark.createDataFrame(r, f"{n} bigint, v array<float>")
    asked = [r for r in rows if r[0] is not None and r[0] % 10 == 0 and r[0] < 1080]
    got = {(r["q"], r["place"]): r["sim"] for r in neighbours.nearest(make(rows, "i"), make(asked, "q"), 10).collect()}
    want = {(q, p): s for q, _, s, p in plain(rows, asked, 10)}
    assert sum(abs(got.get(key, -9) - s) < 2e-6 for key, s in want.items()) >= 0.9 * len(want)


def test_no_rows(spark):
    none = spark.createDataFrame([], "i bigint, v array<float>")
    some = spark.createDataFrame([(1, [1.0, 2.0])], "i bigint, v array<float>")
    for a, b in ((none, none), (none, some), (some, none)):
        assert neighbours.nearest(a, b, exact=True).count() == 0
        assert neighbours.nearest(a, b).count() == 0


def test_cosines_of_all_pairs_as_products_of_blocks(spark, rows, monkeypatch):
    """Every pair in blocks of any size, as one by one: missing vectors, other sizes, nulls, no length, not a number; no expression for each pair."""
    from pyspark.sql import functions as F

    from glyphmill.functions.vectors import cosine
    from glyphmill.operators import neighbours
    from glyphmill.plans import registry

    odd = [(3000, [float("nan")] + [1.0] * 15), (3050, [2.0] * 7), (3100, None), (3150, [0.0] * 16), (3200, [None] + [float("nan")] * 15)]
    every = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>")
    asked = every.where("vec_id % 50 = 0").toDF("q", "x")
    plain_ = every.crossJoin(asked).where("q <> vec_id").select("q", "vec_id", F.round(cosine(F.col("x"), F.col("embedding")), 6))
    key = lambda df: sorted((r[0], r[1], f"{r[2]:.6f}") for r in df.collect())
    want = key(plain_)
    for most in (7, 100, 1_000):
        monkeypatch.setattr(neighbours, "MET_ROWS", most)
        assert key(neighbours.cosines(every, asked)) == want
    plan = registry.QUERIES["R08_cosine"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in plan and "Join" not in plan and "zip_with" not in plan
