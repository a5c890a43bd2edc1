"""Files as rows: gates, text, Word and PDF texts; lines of JSON, strict and tolerant; a registry of text files."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import lexicon as L
from glyphmill.functions import text as X
from glyphmill.sources.tables import ship

MOST_BYTES, MOST_PAGES, LEAST_WORDS = 8 << 20, 30, 5
PLAIN, READ = ("txt", "md"), ("txt", "md", "pdf", "docx")
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def file_gate(name: Column, length: Column) -> Column:
    """IO4: null, or why a file is refused: too large, the old Word format, or no known format."""
    return F.when(length > MOST_BYTES, "too_large").when(extension(name) == "doc", "old_word").when(~extension(name).isin(*READ), "unsupported")


def text_gate(text: Column) -> Column:
    """IO1: null, or unreadable for fewer than five words."""
    return F.when(X.count_words(F.coalesce(text, F.lit(""))) < LEAST_WORDS, "unreadable")


def trimmed(text: Column) -> Column:
    """IO1: without white space at the ends, at most 30,000 characters."""
    return F.left(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), F.lit(L.MAX_CHARS))


def docx_text(data: bytes) -> str:
    """IO3: the paragraphs of a Word file, an empty line between; tabs and breaks stay."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    said = {f"{WORD}t": lambda e: e.text or "", f"{WORD}tab": lambda e: "\t", f"{WORD}br": lambda e: "\n"}
    return "\n\n".join("".join(said[e.tag](e) for e in p.iter() if e.tag in said) for p in root.iter(f"{WORD}p"))


def _stream(body: bytes) -> bytes:
    m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
    if not m:
        return b""
    return zlib.decompressobj().decompress(m.group(1)) if b"FlateDecode" in body[: m.start()] else m.group(1)


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(m.group(1)): m.group(2) for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)endobj", data, re.S)}
    for body in [b for b in found.values() if b"/ObjStm" in b]:
        inside = _stream(body)
        first = int(re.search(rb"/First\s+(\d+)", body).group(1))
        head = list(map(int, inside[:first].split()))
        at = [*head[1::2], len(inside) - first]
        for i, number in enumerate(head[::2]):
            found.setdefault(number, inside[first + at[i] : first + at[i + 1]])
    return found


def _entry(body: bytes, key: bytes) -> bytes:
    """What stands behind a key of a dictionary: a dictionary, or else the line's next words."""
    m = re.search(rb"/" + key + rb"(?![A-Za-z0-9])\s*", body)
    if not m:
        return b""
    if body[m.end() : m.end() + 2] != b"<<":
        return body[m.end() : m.end() + 40]
    depth = 0
    for x in re.finditer(rb"<<|>>", body[m.end() :]):
        depth += 1 if x.group() == b"<<" else -1
        if not depth:
            return body[m.end() : m.end() + x.end()]
    return b""


class Font:
    """How a font's codes read: by its map to Unicode; without one as Latin text or UTF-16, or not at all if its codes are glyph numbers."""

    def __init__(self, body: bytes, objects: dict[int, bytes]):
        self.codes: dict[bytes, str] = {}
        self.lengths: list[int] = []
        found = re.match(rb"(\d+)\s+\d+\s+R", _entry(body, b"ToUnicode"))
        table = _stream(objects.get(int(found.group(1)), b"")) if found else b""
        self.glyphs = not table and bool(re.search(rb"/Subtype\s*/Type0\b", body))
        code = rb"<([0-9A-Fa-f\s]*)>"
        raw = lambda h: bytes.fromhex(re.sub(rb"\s", b"", h).decode())
        said = lambda b: b.decode("utf-16-be", "replace")
        for part in re.findall(rb"begincodespacerange(.*?)endcodespacerange", table, re.S):
            self.lengths += [len(raw(low)) for low, _ in re.findall(code + rb"\s*" + code, part)]
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.S):
            self.codes |= {raw(k): said(raw(v)) for k, v in re.findall(code + rb"\s*" + code, part)}
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.S):
            for low, high, one, several in re.findall(code + rb"\s*" + code + rb"\s*(?:" + code + rb"|\[(.*?)\])", part, re.S):
                start, n = int.from_bytes(raw(low)), len(raw(low))
                goals = [raw(x) for x in re.findall(code, several)]
                for i in range(min(int.from_bytes(raw(high)) - start + 1, 1 << 16)):
                    goal = goals[i] if i < len(goals) else raw(one)[:-2] + (int.from_bytes(raw(one)[-2:]) + i & 0xFFFF).to_bytes(2) if one else b""
                    self.codes[(start + i).to_bytes(n)] = said(goal)
        self.lengths = sorted(set(self.lengths) | {len(k) for k in self.codes})

    def read(self, data: bytes) -> str:
        if self.glyphs:
            raise ValueError("a font without a map to Unicode")
        if not self.codes:
            return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")
        out, i = [], 0
        while i < len(data):
            n = next((n for n in self.lengths if data[i : i + n] in self.codes), self.lengths[-1])
            out.append(self.codes.get(data[i : i + n], "\ufffd"))
            i += n
        return "".join(out)


def _bytes(raw: bytes) -> bytes:
    """What a string in round brackets, or in hexadecimal ones, stands for."""
    if raw[:1] == b"<":
        return bytes.fromhex((h := re.sub(rb"[^0-9A-Fa-f]", b"", raw).decode()) + "0" * (len(h) & 1))
    plain = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b""}
    return re.sub(rb"\\([0-7]{1,3}|.|\n)", lambda m: bytes([int(m.group(1), 8) & 255]) if m.group(1)[:1].isdigit() else plain.get(m.group(1), m.group(1)), raw[1:-1], flags=re.S)


def pdf_text(data: bytes, most: int = MOST_PAGES) -> str:
    """IO2: the text items of the first pages, a blank between, a line a page.

    Pages are followed from the catalogue; contents may be deflated and objects packed. Strings are read by the map to Unicode of the font that is
    set, else as Latin text or UTF-16. A file that sets text in glyph numbers without such a map can't be read, which is an error; scans give no text.
    """
    objects = _objects(data)
    numbers = lambda raw: [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", raw)]
    refs = lambda key, body: numbers(m.group(1)) if (m := re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)) else []
    whole = lambda raw: raw if raw[:2] == b"<<" else objects.get(n[0], b"") if (n := numbers(raw)) else b""

    def pages(number: int, seen: frozenset[int], resources: bytes) -> Iterator[tuple[bytes, bytes]]:
        body = objects.get(number, b"")
        if number in seen:
            return
        resources = whole(_entry(body, b"Resources")) or resources  # those of the parent hold where a page has none
        if kids := refs(b"Kids", body):
            for k in kids:
                yield from pages(k, seen | {number}, resources)
        elif b"/Page" in body:
            yield body, resources

    roots = [n for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b) for n in refs(b"Pages", b)]
    found = [p for n in roots for p in pages(n, frozenset(), b"")] or [(b, whole(_entry(b, b"Resources"))) for _, b in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b", b)]
    lines, latin = [], Font(b"", objects)
    for page, resources in found[:most]:
        fonts = {name: Font(objects.get(int(n), b""), objects) for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", whole(_entry(resources, b"Font")))}
        content = b"\n".join(_stream(objects.get(n, b"")) for n in refs(b"Contents", page))
        items, font = [], latin
        for m in re.finditer(rb"/([^\s/<>\[\]()]+)\s+-?[\d.]+\s+Tf\b|(\[(?:\\.|\((?:\\.|[^\\()])*\)|[^\]\\(])*\]|\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)\s*(?:TJ|Tj|'|\")", content, re.S):
            if m.group(1):
                font = fonts.get(m.group(1), latin)
            elif m.group(2)[:1] == b"[":
                parts = re.findall(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|-?\d+(?:\.\d+)?", m.group(2), re.S)
                items.append("".join(font.read(_bytes(p)) if p[:1] in b"(<" else " " if float(p) < -200 else "" for p in parts))
            else:
                items.append(font.read(_bytes(m.group(2))))
        lines.append(" ".join(items))
    return "\n".join(lines)


def extracted(files: DataFrame) -> DataFrame:
    """``files`` (name, content, ...) with ``text`` of Word and PDF files, null for others and for files that can't be read."""
    ship(files.sparkSession)
    names = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, data in zip(b.column(names.index("name")).to_pylist(), b.column(names.index("content")).to_pylist(), strict=True):
                read = {"docx": docx_text, "pdf": pdf_text}.get(name.rsplit(".", 1)[-1].lower())
                try:
                    out.append(read(data) if read else None)
                except (KeyError, ValueError, zipfile.BadZipFile, zlib.error, ElementTree.ParseError, AttributeError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*names, "text"])

    fields = ", ".join(f"`{c}` {t}" for c, t in files.dtypes)
    return files.mapInArrow(run, f"{fields}, text string")


def file_texts(files: DataFrame) -> DataFrame:
    """IO1-IO4 for (name, length, content): name, code (null: accepted), text (null if refused), words.

    Plain files are decoded as UTF-8 without Python; only Word and PDF files go through it. A file gate comes before a text gate.
    """
    gated = files.withColumn("code", file_gate(F.col("name"), F.col("length")))
    refused = gated.where("code IS NOT NULL").select("name", "code", F.lit(None).cast("string").alias("text"))
    good = gated.where("code IS NULL")
    plain = good.where(extension(F.col("name")).isin(*PLAIN)).select("name", F.decode("content", "UTF-8").alias("text"))
    packed = extracted(good.where(~extension(F.col("name")).isin(*PLAIN)).select("name", "content")).select("name", "text")
    read = plain.unionByName(packed).select("name", trimmed(F.col("text")).alias("text")).withColumn("code", text_gate(F.col("text")))
    read = read.withColumn("text", F.when(F.col("code").isNull(), F.col("text")))
    return read.unionByName(refused).withColumn("words", X.count_words(F.coalesce("text", F.lit(""))))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``file_texts`` of a folder; the content of files over the size limit is never read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("name")
    small = raw.where(F.col("length") <= MOST_BYTES).select(name, "length", "content")
    large = raw.where(F.col("length") > MOST_BYTES).select(name, "length", F.lit(None).cast("binary").alias("content"))
    return file_texts(small.unionByName(large))


def parsed_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Lines that aren't blank, with ``row`` (a struct of ``schema``) and ``bad`` (true where a line is no JSON object)."""
    some = lines.where(F.regexp_like(column, F.lit(r"\S")))
    row = F.from_json(column, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return some.withColumn("row", row).withColumn("bad", F.col("row").isNull() | F.col("row._bad").isNotNull() | ~F.regexp_like(column, F.lit(r"^\s*\{"))).withColumn("row", F.col("row").dropFields("_bad"))


def strict(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """IO5: the rows of all lines; the first bad line stops the job and is told."""
    rows = parsed_lines(lines, schema, column)
    told = F.raise_error(F.concat(F.lit("bad line: "), F.left(F.col(column), F.lit(200))))
    return rows.withColumn("row", F.when(F.col("bad"), told.cast(rows.schema["row"].dataType)).otherwise(F.col("row"))).drop("bad", column)


def tolerant(lines: DataFrame, schema: str, required: list[str], column: str = "value") -> tuple[DataFrame, DataFrame]:
    """IO6: rows whose required texts are there, trimmed; and one row of counts: good, bad (no JSON, or a required text is missing or blank)."""
    rows = parsed_lines(lines, schema, column)
    filled = ~F.col("bad")
    for c in required:
        filled = filled & F.coalesce(F.regexp_like(F.col(f"row.{c}"), F.lit(r"\S")), F.lit(False))
    good = rows.withColumn("_ok", filled)
    trim = F.col("row")
    for c in required:
        trim = trim.withField(c, F.regexp_replace(F.col(f"row.{c}"), r"^\s+|\s+$", ""))
    counts = good.agg(F.count_if("_ok").alias("good"), F.count_if(~F.col("_ok")).alias("bad"))
    return good.where("_ok").withColumn("row", trim).drop("_ok", "bad", column), counts


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return strict(spark.read.text(path), schema).select("row.*")


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    rows, counts = tolerant(spark.read.text(path), schema, required)
    return rows.select("row.*"), counts


def registered(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """IO9: registry entries (file, ...) with the text of their file; an entry without a file stops the job."""
    joined = entries.join(texts.select(F.col("file"), F.col("text").alias("_t")), "file", "left")
    missing = F.raise_error(F.concat(F.lit("no such file: "), F.col("file"))).cast("string")
    return joined.withColumn("text", F.coalesce("_t", missing)).drop("_t")


def read_registry(spark: SparkSession, root: str, entries: DataFrame) -> DataFrame:
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    base = root.rstrip("/").rsplit("/", 1)[-1]
    return registered(entries, files.select(F.regexp_extract("path", rf".*/{re.escape(base)}/(.*)$", 1).alias("file"), "text"))
