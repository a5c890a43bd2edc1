"""Files, lines of JSON, registries, providers' answers and sinks, over documents as files and lines, and own ones that break the rules."""

from __future__ import annotations

import io
import json
import zipfile
import zlib

from pyspark.sql import functions as F

from glyphmill.functions import lexicon as L
from glyphmill.functions import text as X
from glyphmill.operators import metrics as M
from glyphmill.plans import corpus_queries as C
from glyphmill.plans import detector_sql as S
from glyphmill.plans.detector_sql import q
from glyphmill.plans.fixtures import BASE, DOCUMENTS_SQL, documents, quoted
from glyphmill.sources import files as R
from glyphmill.sources import providers as V
from glyphmill.sources import sinks as K
from glyphmill.sources.tables import read

QUERIES, ORACLE_SQL = {}, {}
BS = chr(92)
T0 = "coalesce(text, '')"


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def docx(paragraphs: list[str]) -> bytes:
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def pdf(pages: list[list[str]], font: str = "") -> bytes:
    """A small file: one deflated content a page, a text item a string.

    ``font``: "mapped" sets the text in two-byte codes of a font with a map to Unicode (small letters as a range, the rest as pairs), found through the
    parent's resources; "glyphs" does without the map.
    """
    n = 3 + 2 * len(pages)
    codes = {c: 300 + ord(c) if "a" <= c <= "z" else 900 + i for i, c in enumerate(sorted({c for p in pages for x in p for c in x}))}
    held = b" /Resources << /ProcSet [/PDF] /Font << /F1 %d 0 R >> >>" % n if font else b""
    parts = [b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", b"2 0 obj << /Type /Pages /Count %d /Kids [%s]%s >> endobj" % (len(pages), b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(pages))), held)]
    latin = lambda x: b"(" + x.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj"
    coded = lambda x: b"<" + "".join(f"{codes[c]:04x}" for c in x).encode() + b"> Tj"
    for i, items in enumerate(pages):
        shown = zlib.compress(b"BT " + (b"/F1 11 Tf " if font else b"") + b" ".join(map(coded if font else latin, items)) + b" ET")
        parts += [b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R >> endobj" % (3 + 2 * i, 4 + 2 * i), b"%d 0 obj << /Length %d /Filter /FlateDecode >> stream\n" % (4 + 2 * i, len(shown)) + shown + b"\nendstream endobj"]
    if font:
        pairs = "\n".join(f"<{k:04X}> <{c.encode('utf-16-be').hex()}>" for c, k in codes.items() if not "a" <= c <= "z")
        table = zlib.compress(f"1 begincodespacerange <0000> <FFFF> endcodespacerange\n1 beginbfrange <{300 + ord('a'):04X}> <{300 + ord('z'):04X}> <0061> endbfrange\n9 beginbfchar\n{pairs}\nendbfchar".encode())
        parts += [b"%d 0 obj << /Type /Font /Subtype /Type0 /Encoding /Identity-H%s >> endobj" % (n, b" /ToUnicode %d 0 R" % (n + 1) if font == "mapped" else b"")]
        parts += [b"%d 0 obj << /Length %d /Filter /FlateDecode >> stream\n" % (n + 1, len(table)) + table + b"\nendstream endobj"]
    return b"%PDF-1.4\n" + b"\n".join(parts)


#: Own files: name, length (null: as it is), content, code, text.
FILES = [
    ("a.docx", None, docx(["Satu dua tiga", "empat lima enam tujuh"]), None, "Satu dua tiga\n\nempat lima enam tujuh"), ("b.PDF", None, pdf([["Satu dua", "(tiga)"], ["empat lima enam"]]), None, "Satu dua (tiga)\nempat lima enam"),
    ("c.pdf", None, pdf([["dua", "kata"]]), "unreadable", None), ("d.docx", None, b"no archive", "unreadable", None), ("e.doc", None, b"x", "old_word", None), ("f.png", None, b"x", "unsupported", None), ("noext", None, b"x", "unsupported", None),
    ("j.pdf", None, pdf([["Naïve café — λόγος", "ditulis dengan"], ["huruf sendiri 🎉"]], "mapped"), None, "Naïve café — λόγος ditulis dengan\nhuruf sendiri 🎉"), ("k.pdf", None, pdf([["lima kata yang tidak terbaca sama sekali"]], "glyphs"), "unreadable", None),
    ("g.txt", (8 << 20) + 1, b"x", "too_large", None), ("h.md", None, "  satu dua tiga empat lima \n".encode(), None, "satu dua tiga empat lima"), ("i.pdf", None, pdf([[f"halaman {i} berisi kata"] for i in range(33)]), None, "\n".join(f"halaman {i} berisi kata" for i in range(30))),
]
TRIM = f"left({S.trimmed(T0)}, {L.MAX_CHARS})"


@query("IO01_IO04_files", f"""WITH {DOCUMENTS_SQL}, t AS (SELECT CAST(doc_id AS VARCHAR) || '.txt' AS name, {TRIM} AS x FROM d), o AS (SELECT name, CASE WHEN {S.count_words('x')} < 5 THEN 'unreadable' END AS code, CASE WHEN {S.count_words('x')} >= 5 THEN x END AS text FROM t
 UNION ALL SELECT * FROM (VALUES {', '.join(f"({quoted(n)}, {'NULL' if c is None else quoted(c)}, {'NULL' if t is None else quoted(t)})" for n, _, _, c, t in FILES)}) v(name, code, text)) SELECT *, CAST({S.count_words("coalesce(text, '')")} AS INT) AS words FROM o""")
def files(spark, sf_dir):
    own = spark.createDataFrame([(n, size or len(c), bytearray(c)) for n, size, c, _, _ in FILES], "name string, length bigint, content binary").coalesce(1)
    texts = documents(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return R.file_texts(texts.select("name", F.octet_length("content").cast("bigint").alias("length"), "content").unionByName(own))


SCHEMA = "doc_id long, text string, lang string"
LINE = "to_json({'doc_id': doc_id, 'text': text, 'lang': lang})"


@query("IO05_strict_lines", "SELECT doc_id, text, lang FROM documents")
def strict_lines(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id", "text", "lang")).alias("value"))
    blank = spark.createDataFrame([("  ",), ("",)], "value string").coalesce(1)
    return R.strict(lines.unionByName(blank), SCHEMA).select("row.*")


BROKEN = "CASE doc_id % 10 WHEN 3 THEN left(line, length(line) - 1) WHEN 6 THEN 'null' ELSE line END"


@query("IO06_tolerant_lines", f"WITH r AS (SELECT *, doc_id % 10 NOT IN (3, 6) AND regexp_matches({T0}, '{BS}S') AS ok FROM documents) SELECT 'row' AS kind, doc_id, {S.trimmed('text')} AS text, NULL AS n FROM r WHERE ok UNION ALL SELECT 'good', NULL, NULL, count(*) FILTER (ok) FROM r UNION ALL SELECT 'bad', NULL, NULL, count(*) FILTER (NOT ok) FROM r")
def tolerant_lines(spark, sf_dir):
    line, i = F.to_json(F.struct("doc_id", "text", "lang")), F.col("doc_id")
    lines = read(spark, sf_dir, "documents").select(F.when(i % 10 == 3, F.left(line, F.length(line) - 1)).when(i % 10 == 6, "null").otherwise(line).alias("value"))
    rows, counts = R.tolerant(lines, SCHEMA, ["text"])
    none = lambda t: F.lit(None).cast(t)
    told = counts.select(F.explode(F.array(F.struct(F.lit("good").alias("kind"), F.col("good").alias("n")), F.struct(F.lit("bad").alias("kind"), F.col("bad").alias("n")))).alias("x")).select("x.kind", none("bigint").alias("doc_id"), none("string").alias("text"), "x.n")
    return rows.select(F.lit("row").alias("kind"), "row.doc_id", "row.text", none("bigint").alias("n")).unionByName(told)


@query("IO07_resume_append", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id")
    return K.unseen(d, read(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("IO08_keyed_replace", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.quality = 1 THEN 'good' END ELSE d.source END AS source, d.lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def replace(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    new = d.join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select("doc_id", F.when(F.col("quality") == 1, "good").alias("source"), "lang")
    return K.replaced(d, new, "doc_id")


@query("IO09_registry", f"WITH {DOCUMENTS_SQL} SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'ai' ELSE 'human' END AS label, 'set/' || doc_id || '.txt' AS file, {T0} AS text FROM d")
def registry(spark, sf_dir):
    d, i = documents(spark, sf_dir), F.col("doc_id")
    path = F.concat(F.lit("set/"), i.cast("string"), F.lit(".txt"))
    entries = d.select(i.alias("id"), F.when(i % 3 == 0, "ai").otherwise("human").alias("label"), path.alias("file"))
    return R.registered(entries, d.select(path.alias("file"), F.coalesce("text", F.lit("")).alias("text")))


#: Words of each document by position; every third position is claimed by a word of its own as well.
WORDS = f"[x FOR x IN regexp_split_to_array({T0}, '{BS}s+') IF x <> '']"


@query("IO13_inverted_index", f"WITH {DOCUMENTS_SQL} SELECT doc_id, array_to_string({WORDS}, ' ') AS out FROM d WHERE len({WORDS}) > 0")
def inverted(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.posexplode(X.space_words(F.coalesce("text", F.lit("")))).alias("pos", "word"))
    index = docs.groupBy("doc_id", "word").agg(F.collect_list("pos").alias("at")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))
    return index.select("doc_id", V.text_of_index(F.col("index")).alias("out"))


@query("IO13_first_word_a_slot", f"WITH {DOCUMENTS_SQL}, w AS (SELECT doc_id, {WORDS} AS ws FROM d) SELECT doc_id, array_to_string([CASE WHEN i % 3 = 1 THEN '#first' ELSE ws[i] END FOR i IN range(1, len(ws) + 1)], ' ') AS out FROM w WHERE len(ws) > 0")
def slots(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.posexplode(X.space_words(F.coalesce("text", F.lit("")))).alias("pos", "word"))
    claims = docs.groupBy("doc_id", "word").agg(F.collect_list("pos").alias("at")).unionByName(docs.where("pos % 3 = 0").groupBy("doc_id").agg(F.collect_list("pos").alias("at")).withColumn("word", F.lit("#first")))
    ordered = claims.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((F.col("word") != "#first").alias("later"), "word", "at"))).alias("e"))
    index = F.map_from_entries(F.transform("e", lambda x: F.struct(x["word"].alias("k"), x["at"].alias("v"))))
    return ordered.select("doc_id", V.text_of_slots(index).alias("out"))


ATOM = "<feed><title>f</title><entry><id> http://a.example/1 </id><title>Satu &amp;\n dua</title><published>2019-05-01T00:00:00Z</published></entry><entry><title>&lt;b&gt;</title><published>kapan</published></entry></feed>"


@query("IO15_atom_entries", f"""WITH f AS (SELECT page_id AS id, '<feed><entry><id>' || url || '</id><title> ' || page_id || ' &amp;amp; x </title><published>' || (1990 + page_id % 40) || '-01-02</published></entry></feed>' AS x FROM pages UNION ALL SELECT {BASE}, {quoted(ATOM)}), e AS (SELECT id, unnest(string_split(x, '<entry>')[2:]) AS e, generate_subscripts(string_split(x, '<entry>')[2:], 1) AS i FROM f),
p AS (SELECT id, i, regexp_extract(e, '(?s)<title>{BS}s*(.*?){BS}s*</title>', 1) AS t, regexp_extract(e, '(?s)<id>{BS}s*(.*?){BS}s*</id>', 1) AS u, regexp_extract(e, '(?s)<published>{BS}s*(.*?){BS}s*</published>', 1) AS y FROM e)
SELECT id, CAST(i AS INT) AS place, {{t}} AS title, {{u}} AS url, TRY_CAST(left(y, 4) AS INT) AS year FROM p""".format(**{k: f"replace(replace(replace(replace(replace(left(trim(regexp_replace({k}, '{BS}s+', ' ', 'g')), 300), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '\"'), '&#39;', '''')" for k in "tu"}))
def atom(spark, sf_dir):
    i = F.col("page_id")
    made = F.concat(F.lit("<feed><entry><id>"), "url", F.lit("</id><title> "), i.cast("string"), F.lit(" &amp;amp; x </title><published>"), (1990 + i % 40).cast("string"), F.lit("-01-02</published></entry></feed>"))
    rows = read(spark, sf_dir, "pages").select(i.alias("id"), made.alias("x")).unionByName(spark.createDataFrame([(BASE, ATOM)], "id bigint, x string").coalesce(1))
    found = rows.select("id", F.posexplode(V.atom(F.col("x"))).alias("i", "c"))
    return found.select("id", (F.col("i") + 1).alias("place"), "c.title", "c.url", "c.year")


#: One answer of each provider, with the candidates it gives: title, abstract, authors, year, venue, doi, url, citations, tier, source, pageid.
ANSWERS = [
    ("works", {"results": [{"id": "https://o.example/W1", "title": " A  b ", "doi": "https://doi.org/10.1/x", "publication_year": 2018, "cited_by_count": 4, "abstract_inverted_index": {"dua": [1], "satu": [0, 2]}}, {"id": "https://o.example/W2", "title": None}]},
     [("A b", "satu dua satu", [], 2018, "OpenAlex", "https://doi.org/10.1/x", "https://doi.org/10.1/x", 4, V.PAPER, "OpenAlex", None), ("", "", [], None, "OpenAlex", "", "https://o.example/W2", None, V.PAPER, "OpenAlex", None)]),
    ("registrations", {"message": {"items": [{"DOI": "10.2/y", "title": ["T", "u"], "publisher": "P", "published": {"date-parts": [[2020, 1]]}, "is-referenced-by-count": 2, "abstract": "<p>Isi <b>x</b></p>"}, {"title": []}]}},
     [("T", "Isi x", [], 2020, "P", "10.2/y", "https://doi.org/10.2/y", 2, V.PAPER, "Crossref", None), ("", "", [], None, "", "", "", None, V.PAPER, "Crossref", None)]),
    ("papers", {"data": [{"title": "S", "year": 2011, "venue": "V", "citationCount": 9, "url": "", "externalIds": {"DOI": "10.3/z"}, "authors": [{"name": n} for n in ("a", " ", "b", "c", "d", "e", "f")]}]},
     [("S", "", ["a", "b", "c", "d", "e"], 2011, "V", "10.3/z", "https://doi.org/10.3/z", 9, V.PAPER, "Semantic Scholar", None)]),
    ("medical", {"result": {"uids": ["7"], "7": {"title": "M", "source": "J", "pubdate": "2009 Jan", "authors": [{"name": "q"}]}}}, [("M", "", ["q"], 2009, "J", "", "https://pubmed.ncbi.nlm.nih.gov/7/", None, V.PAPER, "PubMed", None)]),
    ("encyclopedia", {"query": {"search": [{"title": "Padi ladang", "pageid": 12}]}}, [("Padi ladang", "", [], None, "Wikipedia (id)", "", "https://id.wikipedia.org/wiki/Padi_ladang", None, V.WIKI, "Wikipedia-id", "12")]),
    ("items", {"search": [{"id": "Q1", "label": "", "title": "t", "description": "d"}]}, [("t", "", [], None, "d", "", "https://www.wikidata.org/wiki/Q1", None, V.WIKI, "Wikidata", "Q1")]),
    ("works", {"error": "x"}, []),
]


def literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else ("[" + ", ".join(map(q, x)) + "]::VARCHAR[]") if isinstance(x, list) else q(x)


FIELDS = "title, abstract, authors, year, venue, doi, url, citations, tier, source, pageid"


#: An answer for each document, of three providers in turn, beside the own ones.
TITLE = f"left(trim(regexp_replace(coalesce(text, ''), '{BS}s+', ' ', 'g')), 300)"
BY_DOCUMENT = f"""SELECT doc_id AS answer, 0 AS place, {TITLE} AS title, '' AS abstract, CASE WHEN doc_id % 3 = 1 THEN [x FOR x IN [source, lang] IF x <> ''] ELSE []::VARCHAR[] END AS authors, CAST(2000 + doc_id % 20 AS INT) AS year,
 CASE doc_id % 3 WHEN 0 THEN 'OpenAlex' ELSE coalesce(source, '') END AS venue, CASE WHEN doc_id % 2 = 0 THEN '10.1/' || doc_id ELSE '' END AS doi,
 CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN '10.1/' || doc_id ELSE 'https://o.example/' || doc_id END WHEN 1 THEN 'https://s.example/' || doc_id ELSE CASE WHEN doc_id % 2 = 0 THEN 'https://doi.org/10.1/' || doc_id ELSE '' END END AS url,
 CAST(doc_id % 50 AS INT) AS citations, {q(V.PAPER)} AS tier, CASE doc_id % 3 WHEN 0 THEN 'OpenAlex' WHEN 1 THEN 'Semantic Scholar' ELSE 'Crossref' END AS source, NULL::VARCHAR AS pageid FROM documents"""


@query("IO10_provider_rows", f"SELECT * FROM (VALUES {', '.join(f'({-1 - i}, {k}, ' + ', '.join(map(literal, row)) + ')' for i, (_, _, rows) in enumerate(ANSWERS) for k, row in enumerate(rows))}) v(answer, place, {FIELDS}) UNION ALL {BY_DOCUMENT}")
def providers(spark, sf_dir):
    own = spark.createDataFrame([(-1 - i, kind, json.dumps(body)) for i, (kind, body, _) in enumerate(ANSWERS)], "answer bigint, kind string, body string").coalesce(1)
    i, year = F.col("doc_id"), 2000 + F.col("doc_id") % 20
    doi = F.when(i % 2 == 0, F.concat(F.lit("10.1/"), i.cast("string")))
    at = lambda host: F.concat(F.lit(f"https://{host}.example/"), i.cast("string"))
    name = lambda *cs: F.array(*(F.struct(F.col(c).alias("name")) for c in cs))
    works = F.to_json(F.struct(F.array(F.struct(at("o").alias("id"), F.col("text").alias("title"), doi.alias("doi"), year.alias("publication_year"), (i % 50).alias("cited_by_count"))).alias("results")))
    papers = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("title"), year.alias("year"), F.col("source").alias("venue"), (i % 50).alias("citationCount"), at("s").alias("url"), F.struct(doi.alias("DOI")).alias("externalIds"), name("source", "lang").alias("authors"))).alias("data")))
    listed = F.to_json(F.struct(F.struct(F.array(F.struct(doi.alias("DOI"), F.array("text").alias("title"), F.col("source").alias("publisher"), F.struct(F.array(F.array(year)).alias("date-parts")).alias("published"), (i % 50).alias("is-referenced-by-count"))).alias("items")).alias("message")))
    kind = F.when(i % 3 == 0, "works").when(i % 3 == 1, "papers").otherwise("registrations")
    made = read(spark, sf_dir, "documents").select(i.alias("answer"), kind.alias("kind"), F.when(i % 3 == 0, works).when(i % 3 == 1, papers).otherwise(listed).alias("body"))
    b, rows = F.col("body"), own.unionByName(made)
    found = F.when(F.col("kind") == "works", V.works(b)).when(F.col("kind") == "registrations", V.registrations(b)).when(F.col("kind") == "papers", V.papers(b)).when(F.col("kind") == "medical", V.medical(F.array(F.lit("7")), b)).when(F.col("kind") == "encyclopedia", V.encyclopedia(b, "id")).otherwise(V.items(b))
    return rows.select("answer", F.posexplode(found).alias("place", "c")).select("answer", "place", "c.*")


METRICS = ", ".join(f"'{k}': {k}" for k in ("n", "n_human", "n_machine", "tp", "fp", "tn", "fn", "accuracy", "precision", "recall_tpr", "f1", "fpr_human", "fnr", "accuracy_majority_baseline", "auc"))


@query("IO17_summary_payload", f"""WITH x AS ({C.SCORED}), r AS (SELECT pos, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM x), au AS (SELECT round((sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 6) AS auc FROM r),
c AS (SELECT {C.RATES}, round(1 - avg(CAST(pos AS INT)), 6) AS accuracy_majority_baseline FROM (SELECT *, score >= 50 AS hit FROM x)), m AS (SELECT *, tp + fp + tn + fn AS n, fp + tn AS n_human, tp + fn AS n_machine, round(tp / nullif(tp + fn, 0), 6) AS recall_tpr, round(fp / nullif(fp + tn, 0), 6) AS fpr_human, {C.DERIVED} FROM c)
SELECT to_json({{{METRICS}}})::VARCHAR AS payload FROM m, au""")
def summary(spark, sf_dir):
    rows = C.scored(spark, sf_dir)
    share = rows.agg(F.round(1 - F.avg(F.col("pos").cast("int")), 6).alias("accuracy_majority_baseline"))
    m = C.rounded(M.confusion(rows, F.col("pos"), F.col("score") >= 50)).crossJoin(share).crossJoin(C.rounded(M.auc(rows, F.col("pos"), "score")))
    c = F.col
    return m.select(K.payload(
        n=c("tp") + c("fp") + c("tn") + c("fn"), n_human=c("fp") + c("tn"), n_machine=c("tp") + c("fn"), tp=c("tp"), fp=c("fp"), tn=c("tn"), fn=c("fn"), accuracy=c("accuracy"), precision=c("precision"), recall_tpr=c("recall"), f1=c("f1"),
        fpr_human=c("fpr"), fnr=c("fnr"), accuracy_majority_baseline=c("accuracy_majority_baseline"), auc=c("auc"),
    ).alias("payload"))
