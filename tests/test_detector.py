from pyspark.sql import functions as F

from glyphmill.operators import corpus, detector, greedy, summary
from glyphmill.plans.fixtures import BASE, texts


def test_fixture_counts(spark):
    rows = {r["doc_id"] - BASE: r for r in detector.detect(texts(spark)).collect()}
    assert [rows[i]["total_w"] for i in range(3)] == [20, 32, 24]
    assert (rows[0]["fw_id"], rows[1]["fw_en"]) == (6, 17)
    assert rows[2]["language"] == "mixed" and rows[0]["hits"] == 2 and rows[1]["enum_sents"] == 2
    assert rows[6]["score"] is not None and rows[6]["n_sents"] == 0
    assert rows[7]["s1_fire"] and rows[10]["acad_level"] == "HIGH"
    assert all(2 <= r["score"] <= 98 for r in rows.values())


def test_null_text_counts_as_empty(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    a, b = detector.detect(df).orderBy("doc_id").select("score", "total_w", "confidence").collect()
    assert a == b and a["total_w"] == 0


def test_greedy_near_dedupe(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (5, 6)], "i bigint, j bigint")
    removed = {r["id"] for r in corpus.greedy_removed(pairs).collect()}
    assert removed == {2, 4, 5}


def test_near_pairs_of_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, set array<string>")
    assert corpus.near_pairs(df).count() == 0


def test_split_keeps_units_together(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("s"), (F.col("id") % 20).alias("u"))
    out = corpus.split_units(df, ["s"], "u")
    assert out.groupBy("s", "u").agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0


def test_greedy_operators(spark):
    rows = [(1, 0, "a", ["x", "y"], 3.0, 2), (1, 1, "b", ["x", "y"], 2.0, 2), (1, 2, "c", ["z"], 1.0, 2), (1, 3, "d", ["u"], 0.5, 2)]  # up to three stay whole
    rows = spark.createDataFrame([(*r, [4], 0.0, 0.0) for r in rows], "doc_id bigint, pos int, sent string, tokens array<string>, total double, keep int, counts array<int>, orphan double, generic double")
    part = F.array_sort(F.collect_list(F.struct("pos", "sent", "tokens", "total", "orphan", "generic")))
    rows = rows.groupBy("doc_id").agg(part.alias("parts"), F.first("counts").alias("counts"), F.first("keep").alias("keep")).withColumn("n", F.size("parts"))
    assert [r["sent"] for r in summary.pick(rows).orderBy("pos").collect()] == ["a", "c"]
    c = spark.createDataFrame([(1, 1, "h", "t"), (1, 2, "h", "u"), (1, 3, "g", "u"), (1, 4, None, "")], "q int, i int, host string, title string")
    assert [r["i"] for r in greedy.dedupe_candidates(c, "q", "i", ["host", "title"]).orderBy("i").collect()] == [1, 3, 4]
    got = spark.createDataFrame([(["aa", "bb", "cccc"],), ([],)], "s array<string>").select(greedy.pack(F.col("s"), 5).alias("c")).collect()
    assert got[0]["c"] == ["aa bb", "cccc"] and got[1]["c"] == []
