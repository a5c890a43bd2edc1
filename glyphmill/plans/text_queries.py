"""Text and token operators over all documents and the fixtures; pages for mark-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import lexicon as L
from glyphmill.functions import text as X
from glyphmill.plans import detector_sql as S
from glyphmill.plans.detector_sql import q
from glyphmill.plans.fixtures import DOCUMENTS_SQL, documents, quoted
from glyphmill.sources.tables import kept, read

SQL_W = S.words("coalesce(text, '')")
T0 = "coalesce(text, '')"
BS = chr(92)
LEX = ["the", "and", "selain itu", "kualitas", "ation"]


def C():
    return F.col("text")


def N():
    return F.coalesce("text", F.lit(""))


def LOW():
    return F.lower(N())


def W():
    return X.words(N())


def SHINGLES():
    return X.ngrams(F.col("sw"), 5)


def content(tokens):
    return F.filter(tokens, lambda t: (F.length(t) >= 4) & ~t.isin(L.ID_FW + L.EN_FW))


SQL_CONTENT = f"[t FOR t IN {SQL_W} IF length(t) >= 4 AND NOT list_contains({S.array(L.ID_FW + L.EN_FW)}, t)]"
SQL_SPACE = f"[x FOR x IN regexp_split_to_array({T0}, '{BS}s+') IF x <> '']"


def sql_ngrams(tokens: str, n: int) -> str:
    return f"(CASE WHEN len({tokens}) >= {n} THEN [array_to_string(list_slice({tokens}, i, i + {n - 1}), ' ') FOR i IN range(1, len({tokens}) - {n - 2})] ELSE []::VARCHAR[] END)"


def references_sql() -> str:
    heads = S.array(L.REF_HEADS)
    low = f"[lower({S.trimmed('x')}) FOR x IN string_split({T0}, chr(10))]"
    return f"""WITH {DOCUMENTS_SQL}, a AS (SELECT doc_id, {T0} AS t, string_split({T0}, chr(10)) AS ls, {low} AS low FROM d),
b AS (SELECT *, list_max(list_concat([0], [i FOR i IN range(1, len(ls) + 1) IF i > len(ls) - 80 AND low[i] <> '' AND (len([h FOR h IN {heads} IF low[i] = h OR starts_with(low[i], h || ' ') OR starts_with(low[i], h || ':')]) > 0
      OR (contains(low[i], 'daftar pustaka') AND length(low[i]) < 40))])) AS late, list_max(list_concat([0], [i FOR i IN range(1, len(ls) + 1) IF list_contains({heads}, low[i])])) AS ex FROM a),
c AS (SELECT *, CASE WHEN late > 0 THEN late ELSE ex END AS pos FROM b),
e AS (SELECT *, array_to_string(list_slice(ls, 1, greatest(pos - 1, 0)), chr(10)) AS m, array_to_string(list_slice(ls, greatest(pos, 1), len(ls)), chr(10)) AS r FROM c)
SELECT doc_id, CASE WHEN pos < 1 OR {S.count_words('m')} < 50 THEN t ELSE m END AS main, CASE WHEN pos < 1 OR {S.count_words('m')} < 50 THEN '' ELSE r END AS refs,
  CAST(CASE WHEN pos < 1 OR {S.count_words('m')} < 50 THEN 0 ELSE {S.count_words('r')} END AS INT) AS cut FROM e"""


#: UTF-16 units: a character outside the basic plane is two.
UNITS = f"flatten([CASE WHEN unicode(x) > 65535 THEN [55296 + ((unicode(x) - 65536) >> 10), 56320 + ((unicode(x) - 65536) & 1023)] ELSE [unicode(x)] END FOR x IN string_split({T0}, '') IF x <> ''])"
FNV_SQL = f"lpad(lower(to_hex(list_reduce(list_prepend(2166136261::BIGINT, [y::BIGINT FOR y IN {UNITS}]), lambda h, x: (xor(h, x) * 16777619) & 4294967295))), 8, '0')"

#: Query: ({column: Spark expression}, {column: SQL}). Each runs over documents and fixtures.
TABLE = {
    "T01_strip_markdown": (lambda: {"out": X.strip_markdown(N())}, {"out": S.replaced(T0, X.MARKDOWN)}),
    "T02_clean_academic": (lambda: {"out": X.clean_academic(N())}, {"out": S.clean(T0)}),
    "T04_norm_text": (lambda: {"out": X.norm_text(N())}, {"out": f"trim(regexp_replace(lower({T0}), '{BS}s+', ' ', 'g'))"}),
    "T05_clean_collapse": (lambda: {"out": F.trim(F.regexp_replace(X.clean_academic(N()), r"\s+", " "))}, {"out": f"trim(regexp_replace({S.clean(T0)}, '{BS}s+', ' ', 'g'))"}),
    "T07_clean_str": (lambda: {"out": X.clean_str(C(), 40)}, {"out": f"left(trim(regexp_replace({T0}, '{BS}s+', ' ', 'g')), 40)"}),
    "T08_title_key": (lambda: {"out": X.title_key(N())}, {"out": f"trim(regexp_replace(lower({T0}), '[^a-z0-9à-ÿ]+', ' ', 'g'))"}),
    "T09_escape_html": (lambda: {"out": X.escape_html(N())}, {"out": f"replace(replace(replace(replace(replace({T0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"}),
    "T10_format_bytes": (lambda: {"out": X.format_bytes(F.length(N()) * 700)}, {"out": f"CASE WHEN length({T0}) * 700 > 1048576 THEN printf('%.1f MB', length({T0}) * 700 / 1048576) ELSE printf('%d KB', greatest(1, CAST(floor(length({T0}) * 700 / 1024 + 0.5) AS BIGINT))) END"}),
    "T11_text_hash": (lambda: {"raw": F.sha2(N(), 256), "norm": F.sha2(X.norm_text(N()), 256), "stripped": F.sha2(F.trim(N()), 256)}, {"raw": f"sha256({T0})", "norm": f"sha256(trim(regexp_replace(lower({T0}), '{BS}s+', ' ', 'g')))", "stripped": f"sha256(trim({T0}))"}),
    "T12_fnv1a32": (lambda: {"out": X.fnv1a32(N())}, {"out": FNV_SQL}),
    "T13_snippet": (lambda: {"out": F.when(F.length(N()) > 800, F.concat(F.left(N(), F.lit(800)), F.lit("…"))).otherwise(N()), "n": F.size(X.space_words(N()))}, {"out": f"CASE WHEN length({T0}) > 800 THEN left({T0}, 800) || '…' ELSE {T0} END", "n": f"CAST(len({SQL_SPACE}) AS INT)"}),
    "T14_first_text": (lambda: {"out": F.get(F.filter(F.split(N(), "\n"), lambda x: F.trim(x) != ""), F.lit(0))}, {"out": f"[x FOR x IN string_split({T0}, chr(10)) IF trim(x) <> ''][1]"}),
    "K01_K02_words": (lambda: {"n": F.size(W()), "counted": X.count_words(N()), "by_space": F.size(X.space_words(N())), "joined": F.sha2(F.array_join(W(), " "), 256)}, {"n": f"CAST(len({SQL_W}) AS INT)", "counted": f"CAST({S.count_words(T0)} AS INT)", "by_space": f"CAST(len({SQL_SPACE}) AS INT)", "joined": f"sha256(array_to_string({SQL_W}, ' '))"}),
    "K03_split_sentences": (lambda: {"sents": X.sentences(N())}, {"sents": S.sentences(T0)}),
    "K04_sentence_variants": (lambda: {"by_space": X.sentences(N(), 4, True), "all_sents": X.sentences(N(), 0)}, {"by_space": S.sentences(T0, 4, True), "all_sents": S.sentences(T0, 0)}),
    "K04_after_marks": (lambda: {"sents": X.sentences_after_marks(N())}, {"sents": f"[x FOR x IN [{S.trimmed('y')} FOR y IN string_split(regexp_replace({S.trimmed(T0)}, '([.!?]){BS}s+', '{BS}1' || chr(1), 'g'), chr(1))] IF x <> '']"}),
    "K05_paragraphs": (lambda: {"paras": X.paragraphs(N())}, {"paras": S.paragraphs(T0)}),
    "K06_content_tokens": (lambda: {"n": F.size(content(W())), "distinct_n": F.size(F.array_distinct(content(W())))}, {"n": f"CAST(len({SQL_CONTENT}) AS INT)", "distinct_n": f"CAST(len(list_distinct({SQL_CONTENT})) AS INT)"}),
    "K07_ngram_diversity": (lambda: {"bi": F.round(X.diversity(F.col("w"), 2), 6), "tri": F.round(X.diversity(F.col("w"), 3), 6)}, {"bi": f"round(CAST(len(list_distinct({sql_ngrams('w', 2)})) AS DOUBLE) / nullif(len({sql_ngrams('w', 2)}), 0), 6)", "tri": f"round(CAST(len(list_distinct({sql_ngrams('w', 3)})) AS DOUBLE) / nullif(len({sql_ngrams('w', 3)}), 0), 6)"}),
    "K08_shingles": (lambda: {"n": F.size(F.array_distinct(SHINGLES()))}, {"n": f"CAST(len(list_distinct({sql_ngrams('sw', 5)})) AS INT)"}),
    "K10_count_hits": (lambda: {"n": X.substring_hits(LOW(), LEX)}, {"n": "CAST(" + " + ".join(f"(length(lower({T0})) - length(replace(lower({T0}), {q(t)}, ''))) // {len(t)}" for t in LEX) + " AS INT)"}),
    "K11_distinct_hits": (lambda: {"n": X.distinct_hits(LOW(), LEX)}, {"n": f"CAST({S.distinct_hits(f'lower({T0})', LEX)} AS INT)"}),
    "K12_alternation_count": (lambda: {"n": X.count_terms(LOW(), LEX)}, {"n": f"CAST({S.terms(f'lower({T0})', LEX)} AS INT)"}),
    "K13_enum_starts": (lambda: {"n": F.size(F.filter(X.sentences(N()), lambda s: F.regexp_like(s, F.lit(S.ENUM))))}, {"n": f"CAST(len([x FOR x IN {S.sentences(T0)} IF regexp_matches(x, {q(S.ENUM)})]) AS INT)"}),
    "K14_numbers": (lambda: {"numbers": X.extract(N(), X.NUMBER)}, {"numbers": f"regexp_extract_all({T0}, {q(S.NUMBER)})"}),
    "K15_citations": (lambda: {"cites": X.extract(N(), X.ascii_bounds(X.CITE)), "links": X.extract(N(), "(?i)https?://\\S+|" + X.B0 + "DOI:\\S+"), "quotes": X.extract(N(), '"[^"]+"|“[^”]+”|\'[^\']{4,}\'')}, {"cites": f"regexp_extract_all({T0}, {q(S.CITE)})", "links": f"regexp_extract_all({T0}, '(?i)https?://{BS}S+|{BS}bDOI:{BS}S+')", "quotes": f"regexp_extract_all({T0}, '\"[^\"]+\"|“[^”]+”|''[^'']{{4,}}''')"}),
    "K16_proper_nouns": (lambda: {"n": F.size(F.array_distinct(X.extract(N(), X.PROPER)))}, {"n": f"CAST(len(list_distinct(regexp_extract_all({T0}, '{BS}s[A-ZÀ-Þ][a-zà-ÿ]+'))) AS INT)"}),
    "K20_openers": (lambda: {"openers": F.transform(X.sentences(N()), X.opener)}, {"openers": f"[{S.opener('x')} FOR x IN {S.sentences(T0)}]"}),
    "K21_sections": (lambda: {"sections": X.once(LOW(), lambda low: F.array_compact(F.array(*(F.when(F.contains(low, F.lit(s)) & F.regexp_like(low, F.lit(X.B0 + s + X.B1)), F.lit(s)) for s in L.SECTIONS))))}, {"sections": f"[x FOR x IN {S.array(L.SECTIONS)} IF regexp_matches(lower({T0}), '{BS}b' || x || '{BS}b')]"}),
    "L01_language_exclusions": (lambda: {"n": F.size(F.array_distinct(X.language_exclusions(N())))}, {"n": f"CAST(len(list_distinct(list_concat(flatten([[x FOR x IN regexp_split_to_array(lower(m), '[^a-zà-ÿ]+') IF x <> ''] FOR m IN regexp_extract_all({T0}, '{BS}b[A-ZÀ-Þ][a-zà-ÿ]+(?:{BS}s+[A-ZÀ-Þ][a-zà-ÿ]+)+')]), [lower(x) FOR x IN regexp_extract_all({T0}, '{BS}b[A-ZÀ-Þ]{{2,}}{BS}b')]))) AS INT)"}),
}


def _spark(name, columns):
    # What a query does not use is not computed: the planner leaves nothing out of what is kept.
    tokens = {"K07_ngram_diversity": {"w": W}, "K08_shingles": {"sw": lambda: X.space_words(N())}}.get(name, {})

    def run(spark, sf_dir):
        df = documents(spark, sf_dir)
        return (kept(df, **{k: f() for k, f in tokens.items()}) if tokens else df).select("doc_id", *(c.alias(k) for k, c in columns().items()))

    return run


def _sql(columns) -> str:
    with_tokens = f"{DOCUMENTS_SQL}, e AS (SELECT *, {SQL_W} AS w, {SQL_SPACE} AS sw FROM d)"
    out = ", ".join(f"{e} AS {k}" for k, e in columns.items())
    return f"WITH {with_tokens} SELECT doc_id, {out} FROM e"


QUERIES = {k: _spark(k, a) for k, (a, _) in TABLE.items()}
ORACLE_SQL = {k: _sql(b) for k, (_, b) in TABLE.items()}
ORACLE_SQL["K07_ngram_diversity"] = ORACLE_SQL["K07_ngram_diversity"].replace("SELECT doc_id, round", "SELECT doc_id, coalesce(round").replace(", 6) AS bi, round", ", 6), 1) AS bi, coalesce(round").replace(", 6) AS tri", ", 6), 1) AS tri")

QUERIES["T03_split_references"] = lambda spark, sf_dir: documents(spark, sf_dir).select("doc_id", X.split_references(N()).alias("s")).select("doc_id", "s.*")
ORACLE_SQL["T03_split_references"] = references_sql()



def summary_entities(spark, sf_dir):
    """K18 as the summary has it: by sentence, numbers with units and names that the text never has in lower case."""
    docs = kept(documents(spark, sf_dir).select("doc_id", X.sentences(N()).alias("ss")).where(F.size("ss") > 0), low=F.array_distinct(F.flatten(F.transform("ss", lambda s: X.extract(s, "[a-zà-ÿ]{4,}")))))
    return docs.select("doc_id", F.transform("ss", lambda s: X.summary_entities(s, F.col("low"))).alias("entities"))


QUERIES["K18_summary_entities"] = summary_entities
ORACLE_SQL["K18_summary_entities"] = f"""WITH {DOCUMENTS_SQL}, a AS (SELECT doc_id, {S.sentences(T0)} AS ss FROM d), b AS (SELECT *, list_distinct(flatten([regexp_extract_all(s, '[a-zà-ÿ]{{4,}}') FOR s IN ss])) AS low FROM a)
SELECT doc_id, [list_concat([lower(m) FOR m IN regexp_extract_all(s, {q(X.NUMBER_UNIT)}) IF length(m) > 1], [lower(m) FOR m IN regexp_extract_all(s, {q(X.NAMES)}) IF NOT list_contains(low, lower(m))]) FOR s IN ss] AS entities FROM b WHERE len(ss) > 0"""

QUERIES["IO14_strip_tags"] = lambda spark, sf_dir: read(spark, sf_dir, "pages").select("page_id", X.strip_tags(F.coalesce("html", F.lit(""))).alias("out"))
ORACLE_SQL["IO14_strip_tags"] = f"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '{BS}s+', ' ', 'g')) AS out FROM pages"

_WIKI = "'''Kota''' <!-- x -->adalah [[ibu kota|ibukota]] [[Jawa]].<ref name=a>b</ref> {{Info|{{x}}}}\n* daftar\n== Judul ==\n{| class=x\n| a\n|}\n[[Berkas:a.jpg]] Isi [https://x.org teks] akhir https://y.org."
_WIKI_ROW = (8_999_999_999, _WIKI)
_WIKI_LINES = f"[trim(x) FOR x IN string_split({S.replaced(T0, X.WIKI)}, chr(10))]"
_WIKI_KEPT = f"[trim({S.replaced('x', X.WIKI_LINE)}) FOR x IN {_WIKI_LINES} IF x <> '' AND NOT regexp_matches(x, '^[*#;:|!}}]')]"
QUERIES["T06_clean_wikitext"] = lambda spark, sf_dir: documents(spark, sf_dir).unionByName(spark.createDataFrame([_WIKI_ROW], "doc_id bigint, text string").coalesce(1)).select("doc_id", X.clean_wikitext(N()).alias("out"))
ORACLE_SQL["T06_clean_wikitext"] = f"WITH {DOCUMENTS_SQL}, e AS (FROM d UNION ALL SELECT {_WIKI_ROW[0]}, {quoted(_WIKI)}) SELECT doc_id, array_to_string([y FOR y IN {_WIKI_KEPT} IF y <> ''], chr(10)) AS out FROM e"
QUERIES["T05_canonical_text"] = lambda spark, sf_dir: kept(documents(spark, sf_dir), t=X.nfkc(N())).select("doc_id", X.canonical_text(F.col("t")).alias("out"))
