"""Acquired texts: revisions as of a time, a seeded sample of titles, works gated and told apart by doi."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import history as H
from glyphmill.plans.detector_sql import q
from glyphmill.sources import providers as V
from glyphmill.sources.tables import read

QUERIES, ORACLE_SQL = {}, {}
BS = chr(92)


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


@query("IO12_as_of_revision", """SELECT a.event_id, a.user_id, b.event_id AS revision, round(b.value, 4) AS value, b.event_type AS kind FROM events a ASOF LEFT JOIN (SELECT user_id, ts, event_id, event_type, value FROM events WHERE event_type IN ('view', 'click')) b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def as_of(spark, sf_dir):
    """For every event the last page view or click of its user up to then."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    seen = e.where("event_type IN ('view', 'click')").select("user_id", "ts", "event_id", "event_type", F.round("value", 4).alias("value"))
    found = H.as_of(e.select("event_id", "user_id", "ts"), seen, "user_id", "ts", ties=["event_id"])
    return found.select("event_id", "user_id", F.col("revision.event_id").alias("revision"), F.col("revision.value").alias("value"), F.col("revision.event_type").alias("kind"))


#: Pages are titles; documents are their revisions, up to four a page, at days by rule; the sample takes 40.
KEEP = 40
TITLES = "SELECT page_id AS page, CASE page_id % 11 WHEN 0 THEN 'Daftar ' ELSE '' END || regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages"
CLEAN = f"trim(regexp_replace(coalesce(text, ''), '{BS}s+', ' ', 'g'))"
SEEN = f"""WITH t AS (SELECT *, sha256('42|' || title || '|' || page) AS o FROM ({TITLES}) WHERE trim(title) <> ''), t1 AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY o) AS r FROM t),
rv AS (SELECT doc_id // 4 AS page, DATE '2021-12-31' + CAST(doc_id * 7 % 41 - 25 AS INT) AS rd, doc_id, {CLEAN} AS text FROM documents WHERE doc_id % 7 <> 2),
ro AS (SELECT page, arg_max(doc_id, rd) AS doc_id, arg_max(text, rd) AS text FROM rv WHERE rd <= DATE '2021-12-31' GROUP BY page),
st AS (SELECT t1.*, ro.doc_id, length(text) AS chars, CASE WHEN r > 1 THEN 'dup_title' WHEN {' OR '.join(f'starts_with(title, {q(p)})' for p in H.SKIPPED_TITLES)} THEN 'list_title' WHEN page NOT IN (SELECT page FROM rv) THEN 'missing' WHEN ro.page IS NULL THEN 'no_oldrev' WHEN length(text) < {H.MIN_CHARS} THEN 'short' ELSE 'ok' END AS status FROM t1 LEFT JOIN ro USING (page)),
kp AS (SELECT * FROM st WHERE status = 'ok' ORDER BY o LIMIT {KEEP})"""


def sampled(spark, sf_dir):
    i = F.col("page_id")
    titles = read(spark, sf_dir, "pages").select(i.alias("page"), F.concat(F.when(i % 11 == 0, "Daftar ").otherwise(""), F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))
    d = F.col("doc_id")
    revisions = read(spark, sf_dir, "documents").where(d % 7 != 2).select(F.floor(d / 4).alias("page"), F.date_add(F.lit("2021-12-31").cast("date"), (d * 7 % 41 - 25).cast("int")).alias("at"), "doc_id", "text")
    clean = F.trim(F.regexp_replace(F.coalesce("revision.text", F.lit("")), r"\s+", " "))
    return H.sample_as_of(titles, revisions, F.lit("2021-12-31").cast("date"), clean, KEEP)


@query("IO12_sampled_titles", f"{SEEN} SELECT page, title, doc_id, chars FROM kp")
def sampled_titles(spark, sf_dir):
    return sampled(spark, sf_dir)[0].select("page", "title", F.col("revision.doc_id").alias("doc_id"), F.length("text").cast("bigint").alias("chars"))


@query("IO12_sample_counters", f"{SEEN} SELECT status, count(*) AS n FROM st WHERE (SELECT count(*) FROM kp) < {KEEP} OR o <= (SELECT max(o) FROM kp) GROUP BY status")
def sample_counters(spark, sf_dir):
    return sampled(spark, sf_dir)[1]


#: Works by rule from documents, in pages of 50.
DOI = "CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN ' ' ELSE '10.1/' || (doc_id * 13 % 397) END"
WORKS = f"SELECT doc_id, doc_id // 50 AS page, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE text END AS abstract, {DOI} AS doi, CASE doc_id % 5 WHEN 0 THEN 'cc-by' WHEN 1 THEN ' cc0 ' WHEN 2 THEN '' ELSE 'oa' END AS license, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE (2012 + doc_id % 12) || '-06-01' END AS day FROM documents"


@query("IO11_gated_works", f"""WITH w AS ({WORKS}), x AS (SELECT doc_id, page, trim(license) AS license, nullif(trim(coalesce(doi, '')), '') AS k, CASE WHEN trim(coalesce(abstract, '')) = '' THEN 'no_abstract' WHEN trim(license) = '' THEN 'bad_license_empty' WHEN coalesce(day, '') = '' OR day >= '2022-01-01' THEN 'bad_date' END AS why FROM w),
f AS (SELECT k, min(doc_id) AS first FROM x WHERE why IS NULL AND k IS NOT NULL GROUP BY k) SELECT doc_id, license, CASE WHEN why = 'no_abstract' THEN why WHEN first < doc_id THEN 'dup_doi' ELSE why END AS dropped FROM x LEFT JOIN f USING (k)""")
def gated_works(spark, sf_dir):
    i = F.col("doc_id")
    doi = F.when(i % 6 == 0, None).when(i % 6 == 1, " ").otherwise(F.concat(F.lit("10.1/"), (i * 13 % 397).cast("string")))
    places = F.when(i % 5 == 0, F.array(F.lit("cc-by"), F.lit("oa"))).when(i % 5 == 1, F.array(F.lit(None), F.lit(" cc0 "))).when(i % 5 == 2, F.array(F.lit(""), F.lit(None))).otherwise(F.array(F.lit(""), F.lit("oa")))
    works = read(spark, sf_dir, "documents").select("doc_id", F.floor(i / 50).alias("page"), F.when(i % 17 > 0, F.col("text")).alias("abstract"), doi.alias("doi"), places.alias("licenses"), F.when(i % 19 > 0, F.concat((2012 + i % 12).cast("string"), F.lit("-06-01"))).alias("pub_date"))
    return V.gated_works(works, ["page", "doc_id"]).select("doc_id", "license", "dropped")
