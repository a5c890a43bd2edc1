"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier decides."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.common import materialize, read, text_of

KINDS = ("email", "ip", "card", "phone")
EM_ROUNDS = 50
KEEP = 0.8
WINDOW = 32

# Base patterns, written so that they take time in proportion to the text: a run of digits is
# only tried at its start, and an address is found from its @ sign.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
# Wider candidates.
OPEN, SHUT = r"\x20?[\[(<{]\x20?", r"\x20?[\])>}]\x20?"
SPELT_AT = rf"(?:\x20(?:at|AT)\x20|{OPEN}(?:at|AT|@){SHUT})"
SPELT_DOT = rf"(?:\.|\x20(?:dot|DOT)\x20|{OPEN}(?:\.|dot|DOT){SHUT})"  # a plain dot with a blank behind it ends a sentence
SPELT = re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}{SPELT_AT}[A-Za-z0-9-]{{1,63}}(?:{SPELT_DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}(?![A-Za-z0-9])")
SPELT_HINT = re.compile(r"[\[(<{]\x20?(?:at|AT|@)\x20?[\])>}]|\x20(?:dot|DOT)\x20|[\[(<{]\x20?(?:dot|DOT)")
GROUPS = re.compile(r"(?<![0-9A-Za-z.])\(?[0-9]{2,5}\)?(?:[\x20.-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9A-Za-z])")

# Gazetteers.
ENDINGS = frozenset("com org net edu gov int info biz io de fr es uk us eu it nl ch at be pt pl se no dk fi cz ru cn jp in br mx ca au".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "380", "420", "421")
ISSUERS = ("34", "37", "36", "38", "4", "51", "52", "53", "54", "55", "2221", "2720", "6011", "62", "64", "65")
# Context words, en/de/fr/es.
NEAR = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|reply|correo|courriel|adresse|kontakt)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|client|login|adresse|servidor|serveur)\b"),
    "card": re.compile(r"(?i)\b(?:card|credit|debit|visa|mastercard|amex|payment|karte|kreditkarte|carte|tarjeta|pago)\b"),
    "phone": re.compile(r"(?i)\b(?:tel|phone|mobile|call|fax|cell|telefon|anruf|appel|telefono|llamar|whatsapp)\b"),
}
# How each kind is usually written.
FORM = {
    "email": re.compile(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*\s?[\[(<{]?\s?(?:@|at|AT).*(?:\.|dot|DOT)[\s\])>}]{0,3}[A-Za-z]{2,24}$"),
    "ip": re.compile(r"^(?:(?:[1-9]?[0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"),
    "card": re.compile(r"^(?:[0-9]{13}|[0-9]{15,16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})$"),
    "phone": re.compile(r"^(?:\+[1-9]|\(?0[1-9]|\([2-9][0-9]{2}\)|[2-9][0-9]{2}([ .-])[0-9]{3}\1[0-9]{4}$)"),
}
AGAINST = re.compile(r"(?i)\b(?:version|license|licence|isbn|issn|doi|order|invoice|page|section|token|sha|uuid|release)\b")


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(DIGIT.findall(s))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of what the base patterns accept, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind's number, end, is it a base span): the base spans and wider ones that overlap none of them and no other."""
    base = base_spans(text)
    out = [(a, k, b, True) for a, k, b in base]
    wide = [(m.start(), 0, m.end()) for m in SPELT.finditer(text)] if SPELT_HINT.search(text) else []
    if DIGIT.search(text):
        wide += [(m.start(), 1, m.end()) for m in IP.finditer(text)]
        for m in CARD.finditer(text):
            if 13 <= m.end() - m.start() <= 40 and 13 <= len(digits_of(m.group())) <= 19:
                wide.append((m.start(), 2, m.end()))
        for m in GROUPS.finditer(text):
            if 7 <= len(digits_of(m.group())) <= 15:
                wide.append((m.start(), 3, m.end()))
        if "+" in text:
            wide += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 7 <= len(digits_of(m.group())) <= 15]
    taken = sorted((a, b) for a, _, b in base)
    ends, i = 0, 0
    for a, k, b in sorted(wide, key=lambda x: (x[0], -x[2], x[1])):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a < ends or any(x < b and a < y for x, y in taken[i : i + 8] if x < b):
            continue
        out.append((a, k, b, False))
        ends = b
    return sorted(out)


def votes(text: str, a: int, k: int, b: int) -> tuple[str, str]:
    """The labelers' votes (+ - 0) and the span's feature key, each of a bounded number of values.

    None of them asks what the base patterns ask: how the kind is usually written (FORM), a gazetteer of endings, issuers and
    calling codes, the checksum (cards), words before that speak for it, words before that speak against it, and whether it stands apart.
    """
    kind, span = KINDS[k], text[a:b]
    digits = digits_of(span)
    before = text[max(0, a - WINDOW) : a]
    form = bool(FORM[kind].search(span))
    if k == 0:
        known = span.rsplit(".", 1)[-1].rsplit(" ", 1)[-1].lower() in ENDINGS
    elif k == 1:
        known = not any(o[0] == "0" for o in span.split(".")[:1])
    elif k == 2:
        known = digits.startswith(ISSUERS)
    elif "+" in span:
        known = digits.startswith(CALLING)
    else:
        known = 9 <= len(digits) <= 11 if digits[0] == "0" else len(digits) == 10 and digits[0] != "1"
    check = luhn(digits) if k == 2 else None  # checksum: cards only
    near, against = bool(NEAR[kind].search(before)), bool(AGAINST.search(before))
    outside = (text[a - 1 : a] if a else "") + text[b : b + 1]
    apart = not any(c.isalnum() or c in "_=\"'" for c in outside)
    v = "".join("0" if x is None else "+" if x else "-" for x in (form, known, check, near or None, False if against else None, apart))
    shape = "s" if re.search(r"[\x20().-]", span) else "r"
    size = min(len(digits), 20)
    return v, f"{k}{shape}{size:02d}{'n' if near else 'o'}{'a' if against else 'o'}{'i' if apart else 'j'}{'w' if form else 'x'}{'k' if known else 'u'}{'c' if check else 'f'}"


def em(patterns: dict[str, float], rounds: int = EM_ROUNDS) -> dict[str, float]:
    """Posterior of "personal data" for each pattern of votes, from how often each occurs.

    Two classes, labelers independent given the class, three outcomes each (0 says nothing). The
    start is the share of + among the votes cast, so the classes keep their meaning; counts are
    smoothed by one vote for what a labeler is there to say.
    """
    keys = sorted(patterns)
    if not keys:
        return {}
    n = np.array([patterns[k] for k in keys], float)
    x = np.array([["+-0".index(c) for c in k] for k in keys])
    one = np.eye(3)[x]  # pattern, labeler, outcome
    plus, minus = one[..., 0].sum(1), one[..., 1].sum(1)
    q = (plus + 0.5) / (plus + minus + 1)
    for _ in range(rounds):
        new = []
        for w, prior in ((q, (2.0, 1.0, 1.0)), (1 - q, (1.0, 2.0, 1.0))):
            c = np.einsum("p,plo->lo", n * w, one) + np.array(prior)
            new.append((np.log((n * w).sum() + 1), np.log(c / c.sum(1, keepdims=True))))
        score = [p + np.einsum("plo,lo->p", one[:, :, :2], t[:, :2]) + np.einsum("pl,l->p", one[:, :, 2], t[:, 2]) for p, t in new]
        q = 1 / (1 + np.exp(np.clip(score[1] - score[0], -50, 50)))
    return dict(zip(keys, q.tolist(), strict=True))


def feature_vector(key: str) -> np.ndarray:
    out = np.zeros(4 * 29 + 1)
    k, at = int(key[0]), 29 * int(key[0])
    del k
    out[at + int(key[2:4])] = 1
    out[at + 21 : at + 29] = [key[1] == "s", key[4] == "n", key[5] == "a", key[6] == "i", key[7] == "w", key[8] == "k", key[9] == "c", 1]
    out[-1] = 1
    return out


def fit_spans(rows: list[tuple[str, str, int]], rounds: int = 200) -> dict[str, float]:
    """Probability for each feature key: logistic regression on the posteriors that EM gives each kind's vote patterns."""
    soft: dict[str, list[float]] = {}
    for k in range(len(KINDS)):
        counts: dict[str, float] = {}
        for v, f, n in rows:
            if int(f[0]) == k:
                counts[v] = counts.get(v, 0) + n
        q = em(counts)
        for v, f, n in rows:
            if int(f[0]) == k:
                s = soft.setdefault(f, [0.0, 0.0])
                s[0] += n * q[v]
                s[1] += n
    if not soft:
        return {}
    keys = sorted(soft)
    x = np.array([feature_vector(k) for k in keys])
    y, n = np.array([soft[k][0] / soft[k][1] for k in keys]), np.array([soft[k][1] for k in keys])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (n * (y - p)) - w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(keys, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()), T.StructField("score", T.DoubleType())])


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """One row per row of ``df``: the id and ``spans``, an array of (kind, start, end, base, score) by start and kind.

    Base spans are what the four strict patterns accept; they always stay. Wider candidates (spelt
    addresses, numbers in groups, other digit runs) that overlap no base span stay where the
    classifier gives ``keep`` or more. Offsets count code points, the end is exclusive.

    One pass finds candidates, their votes and features over all texts and writes them as a table;
    how often each of the bounded number of (votes, features) occurs goes to the driver, where EM
    estimates the labelers' reliabilities by kind and the span classifier is fitted.

    Null texts: no spans. Repeated rows are rows of their own. Empty tables give empty results.
    Other columns aren't read. Whole texts are searched, in time in proportion to their length.
    """
    kind = df.schema[id_col].dataType
    found = T.ArrayType(T.StringType())
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("found", found)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                rows.append([f"{k}:{a}:{b}:{'b' if base else 'w'}:{':'.join(votes(text, a, k, b))}" for a, k, b, base in candidates(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string()))], names=schema.names)

    rows = materialize(df.select(id_col, text_of(text_col).alias("_text")).mapInArrow(scan, schema), "pii")
    counted = rows.select(F.explode("found").alias("s")).select(F.split("s", ":").alias("p")).groupBy(F.col("p")[4].alias("v"), F.col("p")[5].alias("f")).count().collect()  # as many rows as votes and features have values
    score = fit_spans([(r["v"], r["f"], r["count"]) for r in counted])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column(1).to_pylist():
                kept = []
                for s in spans or ():
                    k, a, b, base, _, f = s.split(":")
                    if base == "b" or score[f] >= keep:
                        kept.append({"kind": KINDS[int(k)], "start": int(a), "end": int(b), "base": base == "b", "score": score[f]})
                out.append(kept)
            inner = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(inner))], names=[id_col, "spans"])

    return rows.mapInArrow(decide, T.StructType([T.StructField(id_col, kind), T.StructField("spans", T.ArrayType(SPAN))]))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four counts are of base spans, like base_sha256; spans has the added ones too."""
    found = personal_data(read(spark, sf_dir, "documents"))
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    count = [(F.size("kinds") - F.size(F.array_remove("kinds", k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.withColumn("kinds", kinds).select("doc_id", *count, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
