"""Terms of pairs that share their first document: by id, as the SQL groups them."""

import pytest


def test_pairs_with_one_first_document_share_their_terms_as_in_the_sql(spark, tmp_path):
    from glyphmill.plans import registry

    duckdb = pytest.importorskip("duckdb")
    text = " ".join(f"kata{i} isi{i} lagi{i}." for i in range(60)) + " kami melihat Bandung dan juga Malang di sana. lalu Budi Santoso pulang bersama teman."
    near = [text, text.replace("Bandung", "bandung"), text, text.replace("Malang di", "Malang Raya di"), text + " Tuban."]
    rows = [(i, t, "id", "web", len(t or "")) for i, t in enumerate([*near, "lain sekali", None])]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as from '{path}/*.parquet'")
    seen = {}
    for name in ("K17_terms", "V12_check_subset", "V01_V11_validate", "P05_selected_text"):
        df = registry.QUERIES[name](spark, str(tmp_path))
        found = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLE_SQL[name]})")
        got = sorted(map(repr, map(tuple, df.collect())))
        assert got == sorted(map(repr, found.fetchall())), name
        seen[name] = got
    assert any("'budi', 'budi santoso', 'malang', 'santoso'" in r for r in seen["K17_terms"])  # tokens of four pairs stand side by side


def test_copies_are_told_once_and_the_source_is_read_once(spark, tmp_path, monkeypatch):
    """Fifteen pairs of six copies are one row for what is told of two texts; sentences are looked for in a source that is flattened once."""
    from pyspark.sql import functions as F

    from glyphmill.operators import validate as V
    from glyphmill.plans import corpus_queries as Q

    text = " ".join(f"kata{i} isi{i} lagi{i} itu{i}." for i in range(40))
    rows = [(i, text, "id", "web", len(text)) for i in range(6)] + [(6, None, "id", "web", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    made, kept = {}, Q.written
    monkeypatch.setattr(Q, "written", lambda df, name: made.setdefault(name, kept(df, name)))
    got = Q.QUERIES["V13_verbatim"](spark, str(tmp_path)).where("id < 100").collect()
    assert sorted(map(tuple, got)) == sorted((i, 40, True) for i in range(6) for _ in range(i + 1, 6))
    assert made["told"].count() == 1
    whole, _ = V.supported(F.col("s"), F.col("o"))
    df = spark.range(1).select(F.array(F.lit("a b"), F.lit("c")).alias("s"), F.lit("x  a b y").alias("o"))
    out = df.select(whole.alias("w"), V.verbatim(F.col("s"), F.col("o")).alias("v"))
    assert out.first()["w"] == ["a b"] and out.first()["v"] is False
