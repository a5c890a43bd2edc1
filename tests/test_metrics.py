"""Areas and quantiles over continuous scores, in one range and in many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import metrics
from glyphmill.sources import tables


@pytest.mark.parametrize("ranges", [500_000, 700])
def test_auc_and_quantiles(spark, monkeypatch, ranges):
    monkeypatch.setattr(tables, "RANGE_ROWS", ranges)
    rng = np.random.default_rng(4)
    score = np.round(rng.normal(size=6000), 3) + (rng.random(6000) < 0.5) * rng.normal(size=6000)
    score[:2000] = 0.25
    pos, part = rng.random(6000) < 0.3 + 0.2 * (score > 0), rng.choice(["a", "b", "c"], 6000, p=[0.9, 0.09, 0.01])
    df = spark.createDataFrame([(float(s), bool(p), str(g)) for s, p, g in zip(score, pos, part, strict=True)], "s double, p boolean, g string")

    def plain(s, p):
        order = np.sort(s[~p])
        low, high = np.searchsorted(order, s[p], "left"), np.searchsorted(order, s[p], "right")
        return ((low + high) / 2).sum() / (p.sum() * (~p).sum())

    assert metrics.auc(df, F.col("p"), "s").first()["auc"] == pytest.approx(plain(score, pos), rel=1e-12)
    got = {r["g"]: r["auc"] for r in metrics.auc(df, F.col("p"), "s", ["g"]).collect()}
    assert got == pytest.approx({g: plain(score[part == g], pos[part == g]) for g in "abc"}, rel=1e-12)
    ordered = np.sort(score)
    assert metrics.quantiles(df, "s").first() == pytest.approx((float(np.median(score)), ordered[3000], ordered[5400]))
    assert metrics.auc(df.where("false"), F.col("p"), "s").first()["auc"] is None and metrics.quantiles(df.where("false"), "s").first()["med"] is None


def test_a_million_scores_in_bounded_tasks(spark, monkeypatch):
    """A million distinct doubles: exact, and no range is much over RANGE_ROWS."""
    monkeypatch.setattr(tables, "RANGE_ROWS", 100_000)
    seen = []
    monkeypatch.setattr(tables, "written", lambda df, *a, kept=tables.written: seen.append(kept(df, *a)) or seen[-1])
    df = spark.range(1_000_000).select((F.pmod(F.col("id") * 7919, F.lit(1_000_003)) / F.lit(3.0)).alias("s"), (F.pmod(F.col("id") * 7919, F.lit(1_000_003)) % 2 == 0).alias("p"))
    s = np.sort((np.arange(1_000_000) * 7919) % 1_000_003)
    p = s % 2 == 0
    wins = np.cumsum(~p)[p].sum()
    assert metrics.auc(df, F.col("p"), "s").first()["auc"] == pytest.approx(wins / (p.sum() * (~p).sum()), rel=1e-12)
    assert max(r["count"] for r in seen[0].groupBy("_range").count().collect()) <= 200_000
