"""Operators that do the whole of what their name says."""

import os

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.operators import greedy, summary
from glyphmill.plans import registry
from tests.test_oracle import SF, duck, norm  # noqa: F401


def test_summary_entities(spark):
    row = spark.createDataFrame([("Pada 2021 Kota Bandung punya 40 persen siswa, kata Kampus dan 7 orang dari Universitas Airlangga Surabaya.", ["kampus"])], "s string, low array<string>")
    got = row.select(X.summary_entities(F.col("s"), F.col("low")).alias("e")).first()["e"]
    assert got == ["2021 ", "40 persen", "7 orang", "pada", "kota bandung", "universitas airlangga surabaya"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["K18_summary_entities", "T08_title_key", "T06_clean_wikitext", "T12_fnv1a32"])
def test_whole_query_matches_sql(spark, duck, name):  # noqa: F811
    df = registry.QUERIES[name](spark, SF)
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(tuple(norm(r[names.index(c)]) for c in df.columns) for r in found.fetchall())
    assert sorted(tuple(norm(r[c]) for c in df.columns) for r in df.collect()) == want


def test_summary_takes_one_sentence_a_paragraph_and_swaps_orphans(spark):
    rows = [(1, i, f"s{i}", [f"w{i}"], float(10 - i), 3, [3, 3, 2], 0.5 if i == 3 else 0.0, 0.6) for i in range(8)]
    rows += [(2, i, f"s{i}", ["same" if i < 3 else f"w{i}"], float(10 - i), 4, [8], 0.5, 0.0) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id bigint, pos int, sent string, tokens array<string>, total double, keep int, counts array<int>, orphan double, generic double")
    def whole(rows):
        part = F.array_sort(F.collect_list(F.struct("pos", "sent", "tokens", "total", "orphan", "generic")))
        return rows.groupBy("doc_id").agg(part.alias("parts"), F.first("counts").alias("counts"), F.first("keep").alias("keep")).withColumn("n", F.size("parts"))

    found = summary.pick(whole(df)).collect()
    assert {(r["doc_id"], r["pos"]) for r in found} == {(1, 0), (1, 4), (1, 6), (2, 0), (2, 3), (2, 4), (2, 5)}
    assert {(r["doc_id"], r["of"], r["generic_left"], r["orphan_left"]) for r in found} == {(1, 8, 3, 0), (2, 8, 0, 4)}
    few = df.where("doc_id = 2 AND pos < 3").withColumn("counts", F.array(F.lit(3)))
    assert summary.pick(whole(few)).count() == 3
    places = spark.createDataFrame([([2, 1], 3), ([2, 2], 3), ([3], 3), ([1, 0, 2], 3), ([], 0)], "c array<int>, n int").select(summary.paragraph_of(F.col("c"), F.col("n")).alias("p"))
    assert [r["p"] for r in places.collect()] == [[0, 0, 1], [0, 0, 0], [0, 0, 0], [0, 2, 2], []]
    plan = summary.summarize(spark.createDataFrame([(1, "a b c d.")], "doc_id bigint, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan


def fnv(text):
    h = 0x811C9DC5
    b = text.encode("utf-16-le")
    for i in range(0, len(b), 2):
        h = (h ^ int.from_bytes(b[i : i + 2], "little")) * 0x01000193 % 2**32
    return f"{h:08x}"


def test_hash_and_key_of_whole_texts(spark, tmp_path):
    texts = ["a" * 200 + "x", "a" * 200 + "y", "", "é🎉", "hello", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r["out"] for r in registry.QUERIES["T12_fnv1a32"](spark, str(tmp_path)).collect()}
    assert [rows[i] for i in range(6)] == [fnv(t or "") for t in texts] and rows[0] != rows[1] and rows[4] == "4f9f2cab"
    keys = {r["doc_id"]: r["out"] for r in registry.QUERIES["T08_title_key"](spark, str(tmp_path)).collect()}
    assert keys[0] == texts[0] and keys[1] == texts[1]
