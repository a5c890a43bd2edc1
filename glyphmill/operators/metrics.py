"""Evaluation metrics and reviewer agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.sources.tables import numbered, running


def confusion(df: DataFrame, positive: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """Counts and rates; a rate without a denominator is null."""
    n = lambda c: F.count_if(c)
    out = df.groupBy(*(by or [])).agg(n(positive & predicted).alias("tp"), n(~positive & predicted).alias("fp"), n(~positive & ~predicted).alias("tn"), n(positive & ~predicted).alias("fn"))
    d = lambda a, b: F.try_divide(a, b)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = out.withColumns({"accuracy": d(tp + tn, tp + fp + tn + fn), "precision": d(tp, tp + fp), "recall": d(tp, tp + fn), "fpr": d(fp, fp + tn), "fnr": d(fn, tp + fn)})
    return out.withColumn("f1", d(2 * F.col("precision") * F.col("recall"), F.when(F.col("precision") + F.col("recall") > 0, F.col("precision") + F.col("recall"))))


def auc(df: DataFrame, positive: Column, score: str, by: list[str] | None = None) -> DataFrame:
    """Chance that a positive outscores a negative, ties half. Ranks come from counts per distinct score, added up by ranges of scores."""
    by = by or []
    per = df.groupBy(*by, score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    ranked = running(per, score, ["n"], by).withColumn("wins", F.col("p") * (F.col("n_before") + F.col("n") / 2))
    return ranked.groupBy(*by).agg(F.try_divide(F.sum("wins"), F.sum("p").cast("double") * F.sum("n")).alias("auc"))


def quantiles(df: DataFrame, score: str) -> DataFrame:
    """Median, upper median (the value at n // 2) and the value at floor(0.9 n), from counts per distinct score, added up by ranges of scores."""
    per = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("k"))
    run = running(per, score, ["k"]).crossJoin(F.broadcast(df.agg(F.count(score).alias("n"))))  # one row
    at = lambda i: F.max(F.when((F.col("k_before") + F.col("k") > i) & (F.col("k_before") <= i), F.col(score)))
    n = F.col("n")
    return run.agg(((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("med"), at(F.floor(n / 2)).alias("upper_median"), at(F.floor(n * 0.9)).alias("q90"))


def retrieval_quality(ranked: DataFrame, query: str = "q", place: str = "place") -> DataFrame:
    """X10, X11 by query: precision at 3 and 10 by what is there and by 3 and 10, recall, irrelevant ones and hard negatives in the first ten, precision without these.

    Columns: place from 1, relevance (1 and more: relevant), hard (boolean). Without a relevant one recall is 1.
    """
    good, hard = F.col("relevance") >= 1, F.coalesce("hard", F.lit(False))
    top = lambda k: F.col(place) <= k
    n, zero = F.count_if, (lambda x: F.coalesce(x, F.lit(0.0)))
    return ranked.groupBy(query).agg(
        zero(F.try_divide(n(top(3) & good), n(top(3)))).alias("p3"), zero(F.try_divide(n(top(10) & good), n(top(10)))).alias("p10"), F.coalesce(F.try_divide(n(top(10) & good), n(good)), F.lit(1.0)).alias("recall"),
        (n(top(3) & good) / 3).alias("fixed_p3"), F.when(F.count(F.lit(1)) >= 10, n(top(10) & good) / 10).otherwise(zero(F.try_divide(n(good), F.count(F.lit(1))))).alias("fixed_p10"),
        n(top(10) & (F.col("relevance") == 0)).alias("off_domain"), n(top(10) & hard).alias("hard10"), zero(F.try_divide(n(top(10) & good & ~hard), n(top(10) & ~hard))).alias("p10_without_hard"),
    )


def macro(per_query: DataFrame, query: str = "q") -> DataFrame:
    """Means over queries; counts are summed."""
    kinds = dict(per_query.dtypes)
    return per_query.agg(F.count(F.lit(1)).alias("queries"), *((F.avg(c) if kinds[c] == "double" else F.sum(c)).alias(c) for c in per_query.columns if c != query))


def rerank(gate: Column, high: Column, score: str = "sem", order: str = "ord") -> list[Column]:
    """The order of candidates by two thresholds: those from ``high`` by falling score, then from ``gate``, then the rest, as they were."""
    tier = F.when(F.col(score) >= high, 0).when(F.col(score) >= gate, 1).otherwise(2)
    return [tier, F.when(tier == 0, -F.col(score)), F.col(order)]


def sweep(items: DataFrame, gates: range, highs: range, query: str = "q", score: str = "sem", order: str = "ord", best: int = 5) -> DataFrame:
    """Mean precision and recall of the reranked lists for a grid of thresholds in hundredths; the ``best`` pairs by p10, then p3.

    Candidate lists are short (a row each); the grid is a literal of a few hundred rows.
    """
    grid = F.broadcast(items.sparkSession.createDataFrame([(g, h) for g in gates for h in highs], "g int, h int"))
    every = items.crossJoin(grid)
    placed = every.withColumn("place", F.row_number().over(W.partitionBy("g", "h", query).orderBy(*rerank(F.col("g") / 100, F.col("h") / 100, score, order))))
    per = retrieval_quality(placed.withColumn("_k", F.struct("g", "h", query)), "_k", "place")
    means = per.groupBy(F.col("_k.g").alias("g"), F.col("_k.h").alias("h")).agg(F.avg("fixed_p3").alias("p3"), F.avg("fixed_p10").alias("p10"), F.avg("recall").alias("recall"))
    return means.orderBy(F.desc(F.round("p10", 9)), F.desc(F.round("p3", 9)), "g", "h").limit(best)


def agreement(reviews: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """By item the valid verdicts (the last of each reviewer), and a status against the number of reviewers.

    None valid: none; fewer than there are reviewers: partial; else agree or differ. ``items`` (item) adds
    those that nobody filled in. ``verdicts`` maps reviewers to what they said.
    """
    active = F.broadcast(reviews.agg(F.count_distinct("reviewer").alias("_active")))
    valid = reviews.where(F.col("verdict").isin("AI", "Human", "Uncertain"))
    last = valid.groupBy("reviewer", "item").agg(F.max_by("verdict", "seq").alias("verdict"))
    said = F.array_sort(F.collect_list(F.struct(F.col("reviewer").cast("string").alias("reviewer"), "verdict")))
    per = last.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("verdict").alias("kinds"), F.min("verdict").alias("one"), said.alias("said"))
    if items is not None:
        per = items.select("item").distinct().join(per, "item", "left").fillna(0, ["n", "kinds"])
    status = F.when(F.col("n") == 0, "none").when(F.col("n") < F.col("_active"), "partial").when(F.col("kinds") == 1, "agree").otherwise("differ")
    return per.crossJoin(active).withColumns({"status": status, "verdicts": F.map_from_entries(F.coalesce("said", F.array().cast(dict(per.dtypes)["said"])))}).drop("said", "_active")


#: What a labelled list of candidates must be.
MUST_HAVE, HARD_NEGATIVES = 10, 2


def candidate_faults(candidates: Column) -> Column:
    """What is wrong with a labelled list of candidates (source, title, url, relevance, hard_negative), as messages."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""

    def slot(c: Column, i: Column) -> Column:
        at = F.concat(F.lit("slot "), (i + 1).cast("string"), F.lit(": "))
        web = F.regexp_like(F.coalesce(c["url"], F.lit("")), F.lit("(?i)^https?://"))
        faults = (empty(c["source"]), "source kosong."), (empty(c["title"]), "title kosong."), (~web, "url harus diawali http(s)."), (~F.coalesce(c["relevance"].isin(0, 1, 2), F.lit(False)), "relevance harus 0/1/2.")
        return F.array_compact(F.array(*(F.when(bad, F.concat(at, F.lit(text))) for bad, text in faults)))

    n = F.coalesce(F.size(candidates), F.lit(0))
    hard = F.size(F.filter(candidates, lambda c: F.coalesce(c["hard_negative"], F.lit(False)) & (c["relevance"] == 0)))
    hard = F.greatest(F.coalesce(hard, F.lit(0)), F.lit(0))
    head = F.when((n != MUST_HAVE) | candidates.isNull(), F.concat(F.lit(f"harus tepat {MUST_HAVE} kandidat (sekarang "), F.greatest(n, F.lit(0)).cast("string"), F.lit(").")))
    tail = F.when(hard < HARD_NEGATIVES, F.concat(F.lit("hard_negative ber-relevance 0 kurang (ada "), hard.cast("string"), F.lit(f", wajib ≥{HARD_NEGATIVES}).")))
    slots = F.coalesce(F.flatten(F.transform(candidates, slot)), F.array().cast("array<string>"))
    return F.array_compact(F.concat(F.array(head), slots, F.array(tail)))


def is_template(note: Column, text: Column) -> Column:
    """A row that still says "template"."""
    said = lambda c: F.regexp_like(F.coalesce(c, F.lit("")), F.lit("(?i)template"))
    return said(note) | said(text)


def review_queue(rows: DataFrame, done: DataFrame, priority: list[int], id_col: str = "id") -> DataFrame:
    """Ids that are not done, those of the priority list first in its order, then by id; ``place`` from 1."""
    left = rows.join(done, id_col, "left_anti")
    first = F.coalesce(*(F.when(F.col(id_col) == p, F.lit(i - len(priority))) for i, p in enumerate(priority)), F.col(id_col)) if priority else F.col(id_col)
    return numbered(left.withColumn("_o", first.cast("bigint")), "_o").withColumn("place", (F.col("place") + 1).cast("int")).drop("_o")
