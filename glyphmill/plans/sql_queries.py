"""Queries in Spark's SQL, over the registered functions."""

from __future__ import annotations

from glyphmill.functions import registered
from glyphmill.plans import detector_queries, text_queries
from glyphmill.plans.fixtures import documents

QUERIES, ORACLE_SQL = {}, {}


def query(name, sql):
    def keep(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return keep


def texts(spark, sf_dir):
    registered.register(spark)
    documents(spark, sf_dir).createOrReplaceTempView("gm_documents")


@query("SQL_K03_sentences", text_queries.ORACLE_SQL["K03_split_sentences"])
def sentences(spark, sf_dir):
    texts(spark, sf_dir)
    return spark.sql("""
        WITH found AS (SELECT doc_id, array_sort(collect_list(struct(pos, sentence))) AS rows FROM gm_documents, LATERAL gm_sentences(text) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(transform(rows, s -> s.sentence), array()) AS sents FROM gm_documents d LEFT JOIN found f ON f.doc_id = d.doc_id
    """)


@query("SQL_L02_language", f"SELECT doc_id, fw_id, fw_en, language FROM ({detector_queries.ORACLE_SQL['L02_detect_language']})")
def language(spark, sf_dir):
    texts(spark, sf_dir)
    return spark.sql("SELECT doc_id, k.id AS fw_id, k.en AS fw_en, gm_decide(k) AS language FROM (SELECT doc_id, gm_counts(text) AS k FROM gm_documents)")
