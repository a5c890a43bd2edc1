"""Corpus building: gates, quotas, exact and near dedupe, splits, digests, mixtures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.greedy import accept
from glyphmill.sources.tables import kept, numbered, written

#: Licences that are none.
BLOCKED = ["", "unknown", "n/a", "all rights reserved", "proprietary"]
#: Pairs for each rare element of each class that greedy dedupe verifies at once; beyond, it goes by stars.
PAIRS_A_KEY = 8


def seeded(seed: int, *keys: str) -> Column:
    """An order that both engines agree on, in place of a generator's shuffle."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)), 256)


def gate(df: DataFrame, license_col: str, date_col: str, words_col: str, before: str = "2022-01-01", least: int = 50, most: int = 3000) -> DataFrame:
    """``dropped``: the first gate that a row fails, or null."""
    reason = F.when(F.lower(F.trim(F.coalesce(license_col, F.lit("")))).isin(BLOCKED), "license").when(F.coalesce(date_col, F.lit("")) >= before, "date").when(~F.col(words_col).between(least, most), "length")
    return df.withColumn("dropped", reason)


def quota(df: DataFrame, cell: list[str], id_col: str, take: int, seed: int = 42) -> DataFrame:
    """The first ``take`` of each cell in seeded order."""
    return numbered(df.withColumn("_o", seeded(seed, id_col)), "_o", "_r", cell).where(F.col("_r") < take).drop("_r", "_o")


def exact_first(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """The smallest id of each key, by a combined aggregation and a semi-join on the id."""
    first = df.groupBy(key.alias("_k")).agg(F.min(id_col).alias(id_col)).select(id_col)
    return df.join(first, id_col, "left_semi")


def classes_and_keys(sets: DataFrame, id_col: str, set_col: str, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, rep) of every non-empty set, (rep, h) of every class of equal sets that can have a link, and (rep, n, x): the rare elements by which classes can meet.

    Equal sets (of 64-bit element hashes, told apart by size and 128 bits) are one class; its smallest id represents it, so copies never meet as
    pairs. Elements of one class alone can't be shared. A set whose shared elements are too few for the threshold
    has no link; of the others only the rarest shared elements count: in one order of elements two
    such sets share one among the first |s| - ceil(t |s|) + 1 of each. Before that, in the order of the hashes, the first |s| - ceil(t |s|) + k of
    two such sets share k; with k a tenth of a set (for the prefix: of the largest set it can meet) most sets without a link drop out by a third of their elements.
    """
    hashed = kept(sets.select(F.col(id_col).alias("id"), F.col(set_col).alias("_s")), h=F.sort_array(F.array_distinct(F.transform("_s", lambda x: F.xxhash64(x))))).where(F.size("h") > 0)
    hashed = written(hashed.select("id", "h", F.struct(F.size("h").alias("n"), F.xxhash64("h").alias("f"), F.xxhash64(F.reverse("h")).alias("b")).alias("c")), "sets")
    classes = hashed.groupBy("c").agg(F.min("id").alias("rep"))
    members = hashed.select("id", "c").join(classes, "c").select("id", "rep")
    n = F.size("h")
    spare = lambda size: size - F.ceil(size * threshold - 1e-9)
    prefix = F.slice("h", F.lit(1), F.least(n, spare(n) + F.greatest(F.lit(1), F.ceil(n * (0.1 / threshold)))).cast("int"))
    early = hashed.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", n.alias("n"), F.explode(prefix).alias("x"))
    often = early.groupBy("x").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("x")
    able = early.join(often, "x").groupBy("id", "n").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= F.greatest(F.lit(1), F.floor(F.col("n") * 0.1))).select("id")
    reps = written(hashed.join(able, "id", "left_semi").select(F.col("id").alias("rep"), "h"), "able")
    elements = reps.select("rep", F.size("h").alias("n"), F.explode("h").alias("x"))
    shared = elements.groupBy("x").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    per = elements.join(shared, "x").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("s"))
    first = spare(F.col("n")) + 1 - (F.col("n") - F.size("s"))
    keys = per.withColumn("m", first.cast("int")).where("m > 0").select("rep", "n", F.explode(F.slice("s", F.lit(1), F.col("m"))).alias("e")).select("rep", "n", F.col("e.x").alias("x"))
    return members, reps, written(keys, "rare-elements")


def verified(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of those pairs (a, b) whose whole sets are alike."""
    full = pairs.join(reps.select(F.col("rep").alias("a"), F.col("h").alias("p")), "a").join(reps.select(F.col("rep").alias("b"), F.col("h").alias("q")), "b")
    common = F.size(F.array_intersect("p", "q"))
    return full.select("a", "b", (common / (F.size("p") + F.size("q") - common)).alias("jaccard")).where(F.col("jaccard") >= threshold)


def meeting(keys: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: classes that share a rare element and whose sizes can reach the threshold."""
    a, b = keys.alias("a"), keys.alias("b")
    fits = (F.col("a.x") == F.col("b.x")) & (F.col("a.rep") < F.col("b.rep")) & (F.col("a.n") >= threshold * F.col("b.n")) & (F.col("b.n") >= threshold * F.col("a.n"))
    return a.join(b, fits).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()


def near_classes(sets: DataFrame, id_col: str = "id", set_col: str = "set", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Sets that are alike: (id, rep) of every non-empty set, and every link (a, b, jaccard) between representatives, a < b.

    Classes that share a rare element meet if their sizes can reach the threshold, and the whole sets verify. Many different sets that
    are all alike have as many links as pairs; ``greedy_kept`` does without.
    """
    members, reps, keys = classes_and_keys(sets, id_col, set_col, threshold)
    return members, verified(meeting(keys, threshold), reps, threshold)


def near_pairs(sets: DataFrame, id_col: str = "id", set_col: str = "set", threshold: float = 0.8) -> DataFrame:
    """Every pair (i, j, jaccard), i < j, of sets at least so alike: the links of ``near_classes`` with their members.

    As many rows as there are pairs, m (m - 1) / 2 for m copies; where links are enough, use ``near_classes``.
    """
    members, links = near_classes(sets, id_col, set_col, threshold)
    members, links = written(members, "members"), written(links, "links")
    same = members.alias("a").join(members.alias("b"), (F.col("a.rep") == F.col("b.rep")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.lit(1.0).alias("jaccard"))
    apart = links.join(members.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(members.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b")
    return same.unionByName(apart.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "jaccard"))


def conflict_keys(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, key): rows that are alike share a key: that of their class, or one for each link of their classes."""
    classes = members.select("id", F.concat(F.lit("c:"), F.col("rep").cast("string")).alias("key"))
    ends = links.withColumn("key", F.concat_ws(":", F.lit("l"), "a", "b"))
    ends = ends.select(F.col("a").alias("rep"), "key").unionByName(ends.select(F.col("b").alias("rep"), "key"))
    return classes.unionByName(members.join(ends, "rep").select("id", "key"))


def greedy_kept(sets: DataFrame, id_col: str = "id", set_col: str = "set", threshold: float = 0.8) -> DataFrame:
    """Ids that stay when, by ascending id, each id that stays removes the later ones that are like it; removed ones remove none.

    Rounds of stars: a class that is the first of all its rare elements stays, as nothing before it can remove it; it meets the other classes of
    those elements, and those like it go. What meets is a class with the first of an element, so a round makes at most a
    row for each rare element of each class, and a million edits of one page are settled by their first, not pair by pair. As soon as all that is
    left meets in no more than PAIRS_A_KEY pairs for each rare element of each class at the start, these are verified at once and only real links are gone through, so
    no class waits for one that merely shares an element. Copies stay or go with their class, whose smallest id is the one that stays.
    """
    members, reps, left = classes_and_keys(sets, id_col, set_col, threshold)
    empty = sets.select(F.col(id_col).alias("id")).join(members.select("id"), "id", "left_anti")
    gone, most = None, PAIRS_A_KEY * left.count()
    while pairs := left.groupBy("x").agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).alias("p")).agg(F.sum("p")).first()[0]:
        if pairs <= most:
            links = written(verified(meeting(left, threshold), reps, threshold).select(F.col("a").alias("i"), F.col("b").alias("j")), "links")
            out = greedy_removed(links).select(F.col("id").alias("rep"))
            gone = out if gone is None else gone.unionByName(out)
            break
        first = left.groupBy("x").agg(F.min_by("n", "rep").alias("first_n"), F.min("rep").alias("first"))
        met = left.join(first, "x")
        now = written(met.groupBy("rep").agg(F.bool_and(F.col("first") == F.col("rep")).alias("ok")).where("ok").select("rep"), "stay")
        fits = (F.col("rep") > F.col("first")) & (F.col("n") >= threshold * F.col("first_n")) & (F.col("first_n") >= threshold * F.col("n"))
        star = written(met.where(fits).join(now.select(F.col("rep").alias("first")), "first", "left_semi").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
        out = written(verified(star, reps, threshold).select(F.col("b").alias("rep")).distinct(), "gone")
        gone = out if gone is None else gone.unionByName(out)
        left = written(left.join(now.unionByName(out), "rep", "left_anti"), "rare-elements")
    stay = members.where(F.col("id") == F.col("rep")).select("id")
    stay = stay if gone is None else stay.join(gone.select(F.col("rep").alias("id")), "id", "left_anti")
    return stay.unionByName(empty)


def cross_source(members: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """(a, b, jaccard): links of classes, and classes with themselves, with members of different sources (id, source; null is one of its own).

    Which sources a class has is an aggregation: two classes have different ones unless both have one and the same.
    """
    of = members.join(sources, "id").groupBy("rep").agg(F.min(F.struct(F.col("source").isNull().alias("none"), "source")).alias("low"), F.max(F.struct(F.col("source").isNull().alias("none"), "source")).alias("high"))
    of = written(of, "class-sources")
    same = of.where(~F.col("low").eqNullSafe(F.col("high"))).select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("jaccard"))
    side = lambda k: of.select(F.col("rep").alias(k), F.struct("low", "high").alias(f"of_{k}"))
    one = (F.col("of_a.low").eqNullSafe(F.col("of_a.high"))) & F.col("of_a").eqNullSafe(F.col("of_b"))
    return same.unionByName(links.join(side("a"), "a").join(side("b"), "b").where(~one).select("a", "b", "jaccard"))


def greedy_removed(pairs: DataFrame) -> DataFrame:
    """C09 for links (i, j), i < j, that are there: ids that a smaller id, itself not removed, removes."""
    key = F.concat_ws(":", "i", "j")
    ends = pairs.select(F.col("i").alias("id"), key.alias("key")).unionByName(pairs.select(F.col("j").alias("id"), key.alias("key")))
    rows = ends.groupBy("id").agg(F.collect_set("key").alias("keys")).withColumn("all", F.lit(0))
    return rows.select("id").join(accept(rows, "all", "id", "keys").select("id"), "id", "left_anti")


def two_sided(units: DataFrame, sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Units that stay of (unit, id, text) rows: in order, a unit goes with all its sides if one is equal to, or like, a side of a unit that stayed.

    ``sets`` has (id, set) of the sides. Equality is of trimmed texts. The seen sides are of all sources together.
    """
    members, links = near_classes(sets, "id", "set", threshold)
    like = conflict_keys(written(members, "members"), links)
    same = units.select("id", F.concat(F.lit("t:"), F.sha2(F.trim(F.coalesce("text", F.lit(""))), 256)).alias("key"))
    keys = units.select("unit", "id").join(same.unionByName(like), "id").groupBy("unit").agg(F.collect_set("key").alias("keys"))
    return accept(keys.withColumn("all", F.lit(0)), "all", "unit", "keys").select("unit")


def split_units(df: DataFrame, stratum: list[str], unit: str, seed: int = 42) -> DataFrame:
    """60/20/20 by unit within strata, in seeded order; tiny strata lose their held-out parts to the floor."""
    units = df.select(*stratum, unit).distinct()
    count = units.groupBy(*stratum).agg(F.count(F.lit(1)).alias("_n"))
    part = F.greatest(F.lit(1), F.bround(F.col("_n") * 0.2, 0).cast("int"))
    part = F.when(part * 2 >= F.col("_n"), F.floor(F.col("_n") * 20 / 100).cast("int")).otherwise(part)
    placed = numbered(units.withColumn("_o", seeded(seed, unit)), "_o", "_r", stratum).join(count.withColumn("_k", part), stratum)
    named = F.when(F.col("_r") < F.col("_k"), "test").when(F.col("_r") < F.col("_k") * 2, "dev").otherwise("train")
    return df.join(placed.select(*stratum, unit, named.alias("split")), [*stratum, unit])


def stride(df: DataFrame, order: str, k: int) -> DataFrame:
    """C17: k rows evenly spaced in ``order`` (whole numbers): those at round(i (n - 1) / (k - 1)), halves to even."""
    n = df.count()
    wanted = sorted({round(i * (n - 1) / (k - 1)) for i in range(k)}) if n >= k > 1 else list(range(n))
    chosen = df.sparkSession.createDataFrame([(w,) for w in wanted], "_r bigint")
    return numbered(df, order, "_r").join(F.broadcast(chosen), "_r", "left_semi").drop("_r")


def digest(df: DataFrame, id_col: str) -> DataFrame:
    """C14: SHA-256 of the sorted ids, one a line.

    The ids are sorted by range; one task then reads the ranges in turn and feeds the digest, which is
    sequential by nature; it holds one batch. An empty table has the digest of nothing.
    """
    ordered = df.select(F.col(id_col).cast("string").alias("id")).orderBy("id").coalesce(1)

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, first = hashlib.sha256(), True
        for b in batches:
            ids = b.column(0).to_pylist()
            if ids:
                state.update((("" if first else "\n") + "\n".join(ids)).encode())
                first = False
        yield pa.RecordBatch.from_arrays([pa.array([state.hexdigest()])], names=["digest"])

    return ordered.mapInArrow(feed, "digest string")


def mixture_plan(n_human: Column, n_machine: Column, share: Column) -> Column:
    """struct(h, m): the largest total whose machine part, round(share * total) with halves to even, fits both sides, two of each at least; null if none does."""
    total = n_human + n_machine
    m = lambda t: F.bround(share * t, 0).cast("int")
    fits = lambda t: (m(t) <= n_machine) & (t - m(t) <= n_human) & (m(t) >= 2) & (t - m(t) >= 2)
    best = F.when(total >= 4, F.array_max(F.filter(F.sequence(F.lit(4), F.greatest(total, F.lit(4))), fits)))
    return F.when(best.isNotNull(), F.struct((best - m(best)).alias("h"), m(best).alias("m")))


def mixture(human: Column, machine: Column, plan: Column) -> Column:
    """The planned sentences as one text, those of the machine first; null without a plan."""
    return F.when(plan.isNotNull(), F.array_join(F.concat(F.slice(machine, F.lit(1), F.coalesce(plan["m"], F.lit(0))), F.slice(human, F.lit(1), F.coalesce(plan["h"], F.lit(0)))), " "))


def first_license(*candidates: Column) -> Column:
    """C20: the first that is neither null nor empty, trimmed; else an empty text."""
    return F.trim(F.coalesce(*(F.when(c != "", c) for c in candidates), F.lit("")))
