"""Candidates from outside: pages of an HTTP interface as a data source and as a stream, and providers' answers as candidate rows.

The answers' shapes are those of the providers' public interfaces.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from glyphmill.functions import text as X

CANDIDATE = "struct<title:string,abstract:string,authors:array<string>,year:int,venue:string,doi:string,url:string,citations:int,tier:string,source:string,pageid:string>"
PAPER, WIKI = "Jurnal/paper", "Wikipedia/Wikidata"


class HttpPages(DataSource):
    """IO10-IO12: the pages behind addresses, as (url, page, status, body, reason) rows.

    Options: urls (a JSON list), workers (partitions, 4), max_pages (1), cursor (the path of the next cursor in an
    answer, dots between; it takes the place of ``{cursor}`` in the address), retries (1; for 429, 5xx and lost
    connections), backoff and delay (seconds), timeout, agent. A page that fails gives a row with its
    status (0: none) and reason, and ends its address; other addresses go on.
    """

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return "url string, page int, status int, body string, reason string"

    def reader(self, schema) -> DataSourceReader:
        return HttpPagesReader(dict(self.options))


class UrlShare(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class HttpPagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[UrlShare]:
        urls = json.loads(self.options["urls"])
        n = max(1, min(len(urls), int(self.options.get("workers", "4"))))
        return [UrlShare(urls[i::n]) for i in range(n)]

    def get(self, url: str) -> tuple[int, str, str]:
        o = self.options
        status, why = 0, ""
        for attempt in range(int(o.get("retries", "1")) + 1):
            if attempt:
                time.sleep(float(o.get("backoff", "1")) * 2 ** (attempt - 1))
            try:
                ask = urllib.request.Request(url, headers={"User-Agent": o.get("agent", "glyphmill")})
                with urllib.request.urlopen(ask, timeout=float(o.get("timeout", "8"))) as answer:
                    return answer.status, answer.read().decode("utf-8", "replace"), ""
            except urllib.error.HTTPError as e:
                status, why = e.code, f"HTTP {e.code}"
                if e.code != 429 and e.code < 500:
                    break
            except OSError as e:
                status, why = 0, str(e)[:120]
        return status, "", why

    def read(self, partition: UrlShare) -> Iterator[tuple]:
        o = self.options
        for url in partition.urls:
            cursor = "*"
            for page in range(int(o.get("max_pages", "1"))):
                status, body, why = self.get(url.replace("{cursor}", cursor))
                yield url, page, status, body or None, why or None
                if why or not o.get("cursor"):
                    break
                found = json.loads(body)
                for part in o["cursor"].split("."):
                    found = (found or {}).get(part)
                if not found:
                    break
                cursor = str(found)
                time.sleep(float(o.get("delay", "0")))


class CursorPages(DataSource):
    """IO11: the pages behind cursors as a stream of (url, page, cursor, status, body, reason); its offsets are cursors.

    Options as for HttpPages, and batch (pages of an address that a batch takes at most, 8). A page names the next one's cursor
    at ``cursor`` (a path); the first is ``*``. An address ends with a page that names none, or after max_pages (0: no bound). The driver follows the cursors
    and keeps nothing else of a page; tasks read the pages, one a partition. Spark writes a batch's offsets before it
    runs, so after a failure the same pages are read again, and a page that can't be read fails the batch rather than being lost.
    """

    @classmethod
    def name(cls) -> str:
        return "cursor_pages"

    def schema(self) -> str:
        return "url string, page int, cursor string, status int, body string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CursorPagesReader(dict(self.options))


class CursorPage(InputPartition):
    def __init__(self, url: str, page: int, cursor: str):
        self.url, self.page, self.cursor = url, page, cursor


class CursorPagesReader(DataSourceStreamReader):
    """An offset has, for each address, the number and cursor of the next page; a cursor of "" says that there is none."""

    def __init__(self, options: dict):
        self.pages, self.options = HttpPagesReader(options), options
        self.front = self.initialOffset()
        self.walked: dict[tuple[str, int], str] = {}

    def initialOffset(self) -> dict:
        return {url: {"page": 0, "cursor": "*"} for url in json.loads(self.options["urls"])}

    def page(self, url: str, cursor: str) -> tuple[int, str]:
        status, body, why = self.pages.get(url.replace("{cursor}", urllib.parse.quote(cursor, safe="*")))
        if why:
            raise OSError(f"{url}: {why}")
        return status, body

    def after(self, url: str, page: int, cursor: str) -> dict:
        """The place behind a page."""
        if (url, page + 1) not in self.walked:
            found = json.loads(self.page(url, cursor)[1])
            for part in self.options["cursor"].split("."):
                found = (found or {}).get(part)
            self.walked[url, page + 1] = str(found or "")
            time.sleep(float(self.options.get("delay", "0")))
        return {"page": page + 1, "cursor": self.walked[url, page + 1]}

    def steps(self, url: str, start: dict, end_page: int) -> Iterator[tuple[dict, dict]]:
        """Places from ``start`` on with the places behind them, up to page ``end_page``."""
        while start["cursor"] and start["page"] < end_page:
            behind = self.after(url, **start)
            yield start, behind
            start = behind

    def latestOffset(self) -> dict:
        most, batch, out = int(self.options.get("max_pages", "0")), int(self.options.get("batch", "8")), {}
        for url, place in self.front.items():
            bound = min(place["page"] + batch, most or place["page"] + batch)
            try:
                for _, behind in self.steps(url, place, bound):
                    place = behind
            except OSError:
                pass  # what was followed so far is a batch; the next one asks again
            out[url] = place
        self.front = out
        return out

    def partitions(self, start: dict, end: dict) -> list[CursorPage]:
        for url, place in end.items():  # after a restart Spark tells where the stream is
            if place["page"] > self.front.get(url, {"page": -1})["page"]:
                self.front[url] = place
        return [CursorPage(url, at["page"], at["cursor"]) for url, place in start.items() for at, _ in self.steps(url, place, end[url]["page"])]

    def read(self, partition: CursorPage) -> Iterator[tuple]:
        status, body = self.page(partition.url, partition.cursor)
        yield partition.url, partition.page, partition.cursor, status, body

    def commit(self, end: dict) -> None:
        self.walked = {(url, page): c for (url, page), c in self.walked.items() if page >= end.get(url, {"page": 0})["page"]}


def gated_works(works: DataFrame, order: list[str], before: str = "2022-01-01") -> DataFrame:
    """IO11: ``works`` (abstract, doi, licenses in order of preference, pub_date) with ``license`` and ``dropped``: why a work isn't kept, or null.

    In ``order``: no abstract; a doi that a work kept before has; no license; no date, or one not before ``before``. A doi is
    taken by the first work that passes everything else, which is an aggregation by doi; works without a doi are never doubles.
    """
    doi, text = F.trim(F.coalesce("doi", F.lit(""))), F.trim(F.coalesce("abstract", F.lit("")))
    named = F.filter(F.coalesce("licenses", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    license_, date = F.trim(F.coalesce(F.get(named, F.lit(0)), F.lit(""))), F.trim(F.coalesce("pub_date", F.lit("")))
    rows = works.withColumns({"license": license_, "_doi": F.when(doi != "", doi), "_place": F.struct(*order)})
    rows = rows.withColumn("_why", F.when(text == "", "no_abstract").when(F.col("license") == "", "bad_license_empty").when((date == "") | (date >= before), "bad_date"))
    first = rows.where("_why IS NULL AND _doi IS NOT NULL").groupBy("_doi").agg(F.min("_place").alias("_first"))
    rows = rows.join(first, "_doi", "left")
    seen = F.coalesce(F.col("_first") < F.col("_place"), F.lit(False))
    dropped = F.when(F.col("_why") == "no_abstract", F.col("_why")).when(seen, "dup_doi").otherwise(F.col("_why"))
    return rows.select(*works.columns, "license", dropped.alias("dropped"))


def _candidates(items: Column, one) -> Column:
    return F.coalesce(F.transform(items, one), F.array()).cast(f"array<{CANDIDATE}>")


def _row(title, url, source, tier=PAPER, abstract=None, authors=None, year=None, venue=None, doi=None, citations=None, pageid=None) -> Column:
    none = F.lit(None).cast("string")
    text = lambda c, n: X.clean_str(none if c is None else c, n)
    return F.struct(
        text(title, 300).alias("title"), text(abstract, 1200).alias("abstract"), (F.array().cast("array<string>") if authors is None else authors).alias("authors"), (F.lit(None) if year is None else year).cast("int").alias("year"),
        text(venue, 200).alias("venue"), text(doi, 200).alias("doi"), text(url, 300).alias("url"), (F.lit(None) if citations is None else citations).cast("int").alias("citations"), F.lit(tier).alias("tier"), F.lit(source).alias("source"), (none if pageid is None else pageid.cast("string")).alias("pageid"),
    )


def text_of_index(index: Column) -> Column:
    """IO13: the words of an inverted index (word to positions) in the order of their positions; words at one position in the index's order."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def text_of_slots(index: Column) -> Column:
    """IO13: the same with one word a position, the first in the index's order; empty positions are left out."""
    pairs = F.array_sort(F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w"))))))
    first = lambda ps: F.filter(ps, lambda x, k: (x["p"] >= 0) & (x["w"] != "") & ((k == 0) | (F.get(ps, k - 1)["p"] != x["p"])))
    return F.get(F.transform(F.array(pairs), lambda ps: F.array_join(F.transform(first(ps), lambda x: x["w"]), " ")), F.lit(0))


def works(body: Column) -> Column:
    """Works with an inverted index for an abstract."""
    b = F.from_json(body, "results array<struct<id:string,title:string,doi:string,publication_year:int,cited_by_count:int,abstract_inverted_index:map<string,array<int>>>>")
    return _candidates(b["results"], lambda w: _row(w["title"], F.coalesce(F.when(w["doi"] != "", w["doi"]), w["id"]), "OpenAlex", abstract=text_of_index(w["abstract_inverted_index"]), year=w["publication_year"], venue=F.lit("OpenAlex"), doi=w["doi"], citations=w["cited_by_count"]))


def registrations(body: Column) -> Column:
    """Registered works; the abstract's mark-up goes."""
    date = "struct<`date-parts`:array<array<int>>>"
    b = F.from_json(body, f"message struct<items:array<struct<DOI:string,title:array<string>,publisher:string,published:{date},`published-print`:{date},`published-online`:{date},`is-referenced-by-count`:int,abstract:string>>>")
    year = lambda w: F.get(F.get(F.coalesce(w["published"], w["published-print"], w["published-online"])["date-parts"], F.lit(0)), F.lit(0))
    return _candidates(b["message"]["items"], lambda w: _row(F.get(w["title"], F.lit(0)), F.when(w["DOI"] != "", F.concat(F.lit("https://doi.org/"), w["DOI"])), "Crossref", abstract=F.regexp_replace(w["abstract"], "<[^>]+>", " "), year=year(w), venue=w["publisher"], doi=w["DOI"], citations=w["is-referenced-by-count"]))


def papers(body: Column) -> Column:
    b = F.from_json(body, "data array<struct<title:string,year:int,venue:string,citationCount:int,url:string,externalIds:struct<DOI:string>,authors:array<struct<name:string>>>>")
    names = lambda p: F.slice(F.filter(F.transform(F.coalesce(p["authors"], F.array().cast("array<struct<name:string>>")), lambda a: X.clean_str(a["name"], 120)), lambda a: a != ""), 1, 5)
    link = lambda p: F.coalesce(F.when(p["url"] != "", p["url"]), F.when(p["externalIds"]["DOI"] != "", F.concat(F.lit("https://doi.org/"), p["externalIds"]["DOI"])))
    return _candidates(b["data"], lambda p: _row(p["title"], link(p), "Semantic Scholar", authors=names(p), year=p["year"], venue=p["venue"], doi=p["externalIds"]["DOI"], citations=p["citationCount"]))


def medical(ids: Column, body: Column) -> Column:
    """Summaries by id, in the order of the ids."""
    b = F.from_json(F.get_json_object(body, "$.result"), "map<string,string>")

    def one(i: Column) -> Column:
        d = F.from_json(F.element_at(b, i), "title string, source string, pubdate string, authors array<struct<name:string>>")
        names = F.slice(F.filter(F.transform(F.coalesce(d["authors"], F.array().cast("array<struct<name:string>>")), lambda a: X.clean_str(a["name"], 120)), lambda a: a != ""), 1, 5)
        return _row(d["title"], F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), i, F.lit("/")), "PubMed", authors=names, year=F.left(d["pubdate"], F.lit(4)).try_cast("int"), venue=d["source"])

    return _candidates(ids, one)


def unescaped(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def atom(body: Column) -> Column:
    """IO15: the entries of an Atom feed: id, title and the year it was published."""
    entries = F.slice(F.split(body, "<entry>"), 2, 1 << 30)
    pick = lambda e, tag: unescaped(X.clean_str(F.regexp_extract(e, rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>", 1), 300))
    return _candidates(entries, lambda e: _row(pick(e, "title"), pick(e, "id"), "arXiv", year=F.left(pick(e, "published"), F.lit(4)).try_cast("int"), venue=F.lit("arXiv")))


def encyclopedia(body: Column, language: str) -> Column:
    b = F.from_json(body, "query struct<search:array<struct<title:string,pageid:long>>>")
    link = lambda h: F.concat(F.lit(f"https://{language}.wikipedia.org/wiki/"), F.replace(F.url_encode(F.replace(h["title"], F.lit(" "), F.lit("_"))), F.lit("+"), F.lit("%20")))
    return _candidates(b["query"]["search"], lambda h: _row(h["title"], link(h), f"Wikipedia-{language}", tier=WIKI, venue=F.lit(f"Wikipedia ({language})"), pageid=h["pageid"]))


def items(body: Column) -> Column:
    b = F.from_json(body, "search array<struct<id:string,label:string,title:string,description:string>>")
    return _candidates(b["search"], lambda h: _row(F.coalesce(F.when(h["label"] != "", h["label"]), h["title"]), F.when(h["id"] != "", F.concat(F.lit("https://www.wikidata.org/wiki/"), h["id"])), "Wikidata", tier=WIKI, venue=h["description"], pageid=h["id"]))
