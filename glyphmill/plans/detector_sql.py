"""SQL of the detector for the checking engine, one layer for each stage."""

from __future__ import annotations

from glyphmill.functions import lexicon as L
from glyphmill.functions.text import CITED, CODE, MARKDOWN
from glyphmill.plans.fixtures import DOCUMENTS_SQL

WORD = r"[\p{L}\p{N}'']+"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def array(terms: list[str]) -> str:
    return "[" + ", ".join(map(q, terms)) + "]"


def replaced(c: str, steps) -> str:
    for p, to in steps:
        c = f"regexp_replace({c}, {q(p)}, {q(to.replace('$', chr(92)))}, 'g')"
    return c


def words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '{WORD}')"


def count_words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{WORD}'))"


def trimmed(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def sentences(c: str, least: int = 4, by_space: bool = False) -> str:
    norm = f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    found = f"regexp_extract_all({norm}, '[^.!?]+[.!?]+[\"”'']?|\\S.+$')"
    found = f"(CASE WHEN {norm} = '' THEN []::VARCHAR[] WHEN len({found}) = 0 THEN [{norm}] ELSE {found} END)"
    count = "len([y FOR y IN string_split(trim(s), ' ') IF y <> ''])" if by_space else count_words("s")
    return f"[trim(s) FOR s IN {found} IF {count} >= {least}]"


def paragraphs(c: str) -> str:
    return f"[x FOR x IN [{trimmed('p')} FOR p IN regexp_split_to_array({c}, '\\n\\s*\\n')] IF x <> '']"


def clean(c: str) -> str:
    return replaced(c, [*CODE, *MARKDOWN, *CODE, *CITED])


def terms(c: str, ts: list[str]) -> str:
    return f"len(regexp_extract_all({c}, {q(chr(92) + 'b(?:' + '|'.join(ts) + ')' + chr(92) + 'b')}))"


def distinct_hits(c: str, ts: list[str]) -> str:
    return f"len([p FOR p IN {array(ts)} IF contains({c}, p)])"


def any_of(c: str, ts: list[str]) -> str:
    return f"({distinct_hits(c, ts)} > 0)"


def mean(a: str) -> str:
    return f"coalesce(list_avg({a}), 0)"


def cv(a: str) -> str:
    return f"(CASE WHEN len({a}) > 0 AND list_avg({a}) > 0 THEN sqrt(list_avg([(x - list_avg({a})) * (x - list_avg({a})) FOR x IN {a}])) / list_avg({a}) ELSE 0 END)"


CITE = r"(?i)\[\d+(?:\s*[-–,]\s*\d+)*\]|\([^()]{0,50}?\b(?:19|20)\d{2}[a-z]?\)|et al\.|\bdoi\b|https?://"
NUMBER = r"\b\d+(?:[.,]\d+)?\b"
ENUM = "(?i)^(?:" + "|".join(L.ENUM_ID + L.ENUM_EN) + r")[,\s]"
UNION = sorted(dict.fromkeys(L.AI_ID + L.ACAD_NEUTRAL + L.SCAFFOLD), key=lambda s: -len(s))
PHRASE, START = r"(?i)\b(?:" + "|".join(UNION) + r")\b", r"(?i)^(?:pertama|kedua|ketiga)\b"


def opener(c: str) -> str:
    return f"array_to_string(list_slice(regexp_split_to_array(lower({c}), '\\s+'), 1, 3), ' ')"


def div(n: int) -> str:
    grams = f"[array_to_string(list_slice(w, i, i + {n - 1}), ' ') FOR i IN range(1, greatest(len(w) - {n - 2}, 1))]"
    return f"(CASE WHEN len(w) >= {n} THEN len(list_distinct({grams})) / len({grams}) ELSE 1 END)"


LAYERS = f"""
WITH {DOCUMENTS_SQL},
a AS (SELECT doc_id, coalesce(text, '') AS text, {clean("coalesce(text, '')")} AS clean FROM d),
b AS (SELECT *, lower(clean) AS low, {words('clean')} AS w, {sentences('clean')} AS sents, {paragraphs('clean')} AS paras FROM a),
l0 AS (SELECT *, list_concat(flatten([[x FOR x IN regexp_split_to_array(lower(m), '[^a-zà-ÿ]+') IF x <> ''] FOR m IN regexp_extract_all(clean, '\\b[A-ZÀ-Þ][a-zà-ÿ]+(?:\\s+[A-ZÀ-Þ][a-zà-ÿ]+)+')]),
    [lower(x) FOR x IN regexp_extract_all(clean, '\\b[A-ZÀ-Þ]{{2,}}\\b')]) AS excl FROM b),
l1 AS (SELECT *, len([t FOR t IN w IF NOT list_contains(excl, t) AND list_contains({array(L.ID_FW)}, t)]) AS fw_id,
    len([t FOR t IN w IF NOT list_contains(excl, t) AND list_contains({array(L.EN_FW)}, t)]) AS fw_en FROM l0),
l2 AS (SELECT *, fw_id + fw_en AS fw_total, CASE WHEN len(w) > 0 THEN greatest(fw_id, fw_en) / len(w) ELSE 0 END AS fw_rate,
    CASE WHEN fw_id + fw_en > 0 THEN fw_id / (fw_id + fw_en) ELSE 0 END AS id_prop, CASE WHEN fw_id + fw_en > 0 THEN fw_en / (fw_id + fw_en) ELSE 0 END AS en_prop,
    CASE WHEN fw_en > fw_id THEN 'en' ELSE 'id' END AS majority FROM l1),
l3 AS (SELECT *, CASE WHEN fw_total < 4 OR fw_rate < 0.02 THEN 'unknown' WHEN least(id_prop, en_prop) >= 0.30 THEN 'mixed' ELSE majority END AS language FROM l2),
l AS (SELECT *, language = 'mixed' AS mixed, least(floor(least(1.0, fw_rate / 0.2) * 100 + 0.5) / 100, CASE language WHEN 'unknown' THEN 0.3 WHEN 'mixed' THEN 0.6 ELSE 1 END) AS language_confidence FROM l3),
s0 AS (SELECT *, [{count_words('s')} FOR s IN sents] AS lens, [{count_words('p')} FOR p IN paras] AS pl, [length(x) FOR x IN w] AS wl, len(w) AS total_w, len(sents) AS n_sents, len(paras) AS para_count FROM l),
s AS (SELECT *, {cv('lens')} AS burst, CASE WHEN para_count > 1 THEN {cv('pl')} ELSE 0 END AS para_cv, {cv('wl')} AS wl_cv,
    CASE WHEN total_w > 0 THEN len(list_distinct(w)) / total_w ELSE 0 END AS ttr, {div(2)} AS bigram_diversity, {div(3)} AS trigram_diversity FROM s0),
g0 AS (SELECT *, {distinct_hits('low', L.AI_PHRASES)} AS hits, {distinct_hits('low', L.ACAD_NEUTRAL)} AS neutral_hits, {terms('low', L.CONNECTORS)} AS connectors,
    len([x FOR x IN sents IF {any_of('lower(x)', L.BENEFIT)}]) AS benefit_sents, len([x FOR x IN sents IF regexp_matches(x, {q(ENUM)})]) AS enum_sents,
    len(regexp_extract_all(text, {q(CITE)})) AS aca_cite, {terms('low', L.METHOD)} AS aca_meth, len(regexp_extract_all(clean, {q(NUMBER)})) AS numbers,
    len(list_distinct([lower(trim(regexp_replace(x, '\\s', ' ', 'g'))) FOR x IN regexp_extract_all(clean, '\\s[A-ZÀ-Þ][a-zà-ÿ]+')])) AS proper_nouns,
    len(regexp_extract_all(clean, {q('(?i)' + chr(92) + 'b(?:' + '|'.join(L.PERSONAL) + ')' + chr(92) + 'b')})) AS personal_hits,
    len(regexp_extract_all(clean, '[?!…]|"[^"]+"|“[^”]+”')) AS lively, {terms('low', L.FLUFFY)} + {distinct_hits('low', L.FLUFF_EXTRA)} AS fluffy,
    len(regexp_extract_all(clean, {q('(?i)' + chr(92) + 'b(?:' + '|'.join(L.VOICE_LIVE) + ')' + chr(92) + 'b')})) + {distinct_hits('low', L.VOICE_EXTRA)} AS voice,
    {terms('low', L.SECTIONS)} AS sec_hits, len([x FOR x IN lens IF x BETWEEN 12 AND 28]) AS ideal, [{opener('x')} FOR x IN sents] AS openers FROM s),
g1 AS (SELECT *, numbers + proper_nouns AS concrete, aca_cite + least(aca_meth, 4) + CASE WHEN numbers + proper_nouns >= 4 THEN 2 ELSE 0 END AS aca_markers,
    CASE WHEN n_sents > 0 THEN connectors / n_sents ELSE 0 END AS conn_rate, CASE WHEN n_sents > 0 THEN personal_hits / n_sents ELSE 0 END AS personal_rate,
    CASE WHEN n_sents > 0 THEN fluffy / n_sents ELSE 0 END AS fluffy_rate, CASE WHEN n_sents > 0 THEN len(list_distinct(openers)) / n_sents ELSE 1 END AS open_ratio FROM g0),
g2 AS (SELECT *, aca_markers >= 5 AND concrete >= 4 AS strong_acad,
    CASE WHEN (aca_markers >= 5 AND concrete >= 4) OR (aca_cite >= 2 AND aca_meth >= 2) OR (sec_hits >= 3 AND concrete >= 4) THEN 'HIGH'
         WHEN aca_markers >= 3 OR sec_hits >= 2 OR (aca_cite >= 1 AND aca_meth >= 1) THEN 'MEDIUM' ELSE 'LOW' END AS acad_level,
    hits > 0 OR benefit_sents >= 2 OR enum_sents >= 2 OR (neutral_hits >= 2 AND aca_markers < 3) AS template_evidence, n_sents >= 5 AND ideal > 0.8 * n_sents AS tidy,
    [list_distinct(regexp_extract_all(lower(x), '\\p{{L}}{{4,}}')) FOR x IN sents] AS bags FROM g1),
g3 AS (SELECT *, CASE WHEN n_sents BETWEEN 4 AND 300 THEN least(2, len([i FOR i IN range(1, n_sents + 1) IF len([j FOR j IN range(i + 1, n_sents + 1)
        IF len(bags[i]) > 0 AND len(bags[j]) > 0 AND len(list_intersect(bags[i], bags[j])) > 0.55 * (len(bags[i]) + len(bags[j]) - len(list_intersect(bags[i], bags[j])))]) > 0])) ELSE 0 END AS idea_pairs,
    [list_concat([lower(y) FOR y IN regexp_extract_all(x, {q(PHRASE)})], [lower(y) FOR y IN regexp_extract_all(x, {q(START)})]) FOR x IN sents] AS s1 FROM g2),
g4 AS (SELECT *, [len(x) > 0 FOR x IN s1] AS s1_hit, len(flatten(s1)) AS s1_hits, len(list_distinct(flatten(s1))) AS dist,
    greatest(len([x FOR x IN s1 IF len(x) > 0]), len([p FOR p IN paras IF regexp_matches(p, {q(PHRASE)}) OR len([y FOR y IN {sentences('p')} IF regexp_matches(y, {q(START)})]) > 0])) AS s1_dispersion,
    CASE WHEN total_w > 0 THEN len(flatten(s1)) * 100 / total_w ELSE 0 END AS s1_density,
    [regexp_matches(x, {q(NUMBER)}) OR regexp_matches(x, {q(CITE)}) OR regexp_matches(x, {q('(?i)' + chr(92) + 'b(?:' + '|'.join(L.METHOD) + ')' + chr(92) + 'b')}) FOR x IN sents] AS ev FROM g3),
g5 AS (SELECT *, total_w >= {L.S1_MIN_W} AND s1_density >= {L.S1_DENSITY} AND s1_dispersion >= {L.S1_DISPERSION} AND dist >= {L.S1_DISTINCT} AND NOT strong_acad
    AND len([i FOR i IN range(1, n_sents + 1) IF s1_hit[i] AND (ev[i] OR (i > 1 AND ev[i - 1]) OR (i < n_sents AND ev[i + 1]))]) = 0 AS s1_fire,
    CASE WHEN total_w >= {L.S1_MIN_W} THEN dist ELSE 0 END AS s1_distinct, CASE WHEN total_w >= {L.S1_MIN_W} THEN s1_hit ELSE [false FOR x IN s1_hit] END AS s1_sent_hit,
    total_w > {L.MED_MIN_W} AND (bigram_diversity < 0.45 OR trigram_diversity < 0.55) AS repeated_words FROM g4),
g AS (SELECT *, CAST(n_sents >= 5 AND burst < 0.45 AS INT) + CAST(total_w > 50 AND ttr > 0.25 AND ttr < 0.55 AND hits > 0 AS INT) + CAST(total_w > 50 AND ttr < 0.2 AS INT) + CAST(hits > 0 AS INT)
    + CAST(conn_rate > 0.4 AS INT) + CAST(tidy AS INT) + CAST(n_sents >= 3 AND personal_hits = 0 AND total_w >= 50 AS INT) + CAST(repeated_words AS INT) + CAST(n_sents >= 6 AND open_ratio < 0.6 AS INT)
    + CAST(fluffy_rate > 0.3 AND total_w > 60 AS INT) + CAST(benefit_sents >= 1 AND total_w >= 40 AS INT) + CAST(enum_sents >= 2 OR (neutral_hits >= 2 AND aca_markers < 3) AS INT) + CAST(s1_fire AS INT) AS pos_sig FROM g5),
p0 AS (SELECT *, total_w >= 80 AND pos_sig <= 1 AS single_signal,
    CASE WHEN n_sents >= 5 AND burst < 0.3 THEN 14 WHEN n_sents >= 5 AND burst < 0.45 THEN 7 WHEN n_sents BETWEEN 3 AND 4 AND burst < 0.2 THEN 8 ELSE 0 END + CASE WHEN tidy THEN 8 ELSE 0 END AS r,
    CASE WHEN conn_rate > 0.4 THEN 12 ELSE 0 END AS c,
    CASE WHEN total_w > 50 AND ttr > 0.25 AND ttr < 0.55 AND hits > 0 THEN 12 ELSE 0 END + CASE WHEN total_w > 50 AND ttr < 0.2 THEN 8 ELSE 0 END + CASE WHEN repeated_words THEN 8 ELSE 0 END + CASE WHEN conn_rate > 0.4 THEN 12 ELSE 0 END
      + CASE WHEN n_sents >= 3 AND personal_hits = 0 AND total_w >= 50 AND NOT (aca_markers >= 3 AND NOT template_evidence) THEN 8 ELSE 0 END AS lx,
    CASE WHEN n_sents >= 4 AND NOT (para_count >= 2 AND para_cv >= 0.35) AND para_count = 1 AND total_w > 120 THEN 5 ELSE 0 END + CASE WHEN n_sents >= 6 AND open_ratio < 0.6 THEN 10 ELSE 0 END
      + CASE WHEN idea_pairs >= 2 THEN 8 ELSE 0 END + CASE WHEN enum_sents >= 2 THEN 10 ELSE 0 END AS st,
    CASE WHEN n_sents >= 5 AND burst < 0.3 AND (wl_cv >= 0.55 OR (para_count >= 2 AND para_cv >= 0.4)) THEN 6 WHEN n_sents >= 5 AND burst >= 0.45 THEN 8 ELSE 0 END + CASE WHEN total_w > 50 AND ttr >= 0.65 THEN 10 ELSE 0 END
      + CASE WHEN total_w > 60 AND NOT repeated_words AND trigram_diversity > 0.75 AND ttr >= 0.55 THEN 6 ELSE 0 END + CASE WHEN n_sents >= 3 AND personal_rate >= 0.2 THEN 12 ELSE 0 END + CASE WHEN lively >= 2 THEN 8 ELSE 0 END
      + CASE WHEN concrete >= 4 THEN 6 ELSE 0 END + CASE WHEN n_sents >= 4 AND para_count >= 2 AND para_cv >= 0.35 THEN 4 ELSE 0 END + CASE WHEN n_sents >= 6 AND open_ratio > 0.85 THEN 6 ELSE 0 END
      + CASE WHEN voice >= 3 THEN 8 ELSE 0 END + CASE WHEN total_w >= 80 AND strong_acad THEN 4 ELSE 0 END AS hu,
    least(30, hits * 12) + CASE WHEN fluffy_rate > 0.3 AND total_w > 60 THEN 8 ELSE 0 END + CASE WHEN benefit_sents >= 1 AND total_w >= 40 THEN least(18, benefit_sents * 6) ELSE 0 END
      + CASE WHEN neutral_hits >= 2 AND aca_markers < 3 THEN least(18, (neutral_hits - 1) * 9) ELSE 0 END + CASE WHEN s1_fire THEN 8 ELSE 0 END AS te,
    CASE acad_level WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 6 ELSE 2 END AS cap FROM g),
p1 AS (SELECT *, total_w >= 80 AND acad_level <> 'LOW' AS academic, total_w >= 80 AND acad_level <> 'LOW' AND NOT template_evidence AND r > 0 AS halved FROM p0),
p2 AS (SELECT *, CASE WHEN halved THEN r - CAST(floor(r * 0.5 + 0.5) AS INT) ELSE r END AS r2 FROM p1),
p3 AS (SELECT *, least(cap, CASE WHEN halved THEN 0 ELSE r2 END + least(c, 12)) AS damp0 FROM p2),
p4 AS (SELECT *, CASE WHEN academic THEN CASE WHEN hits = 0 AND conn_rate <= 0.4 AND acad_level = 'HIGH' THEN least(cap, damp0 + 4) ELSE damp0 END ELSE 0 END AS acad_damp,
    least(te, 36) AS g_template, greatest(0, least(r2, 20)) AS g_rhythm, least(st, 18) AS g_structure, least(lx, 20) AS g_lexical, least(hu, 14) AS g_human FROM p3),
p5 AS (SELECT *, greatest(15, least(98, 22 + g_template + g_rhythm + g_structure + g_lexical - g_human - acad_damp)) AS pts FROM p4),
p AS (SELECT *, least(pts, CASE WHEN (total_w < 50 OR n_sents < 3) AND total_w > 0 THEN 45 ELSE 98 END, CASE WHEN single_signal THEN 60 ELSE 98 END) AS raw_score FROM p5),
f0 AS (SELECT *, [greatest(2, least(98, 30 + 30 * {distinct_hits('lower(sents[i])', L.AI_PHRASES)} + CASE WHEN lens[i] BETWEEN 12 AND 28 THEN 6 ELSE 0 END - CASE WHEN lens[i] < 6 OR lens[i] > 42 THEN 10 ELSE 0 END
      - CASE WHEN regexp_matches(sents[i], {q('(?i)(?:' + '|'.join(L.SENT_PERSONAL) + '|[?]|!)')}) THEN 28 ELSE 0 END + CASE WHEN regexp_matches(sents[i], {q('(?i)(?:' + '|'.join(L.SENT_TEMPLATE) + ')')}) THEN 14 ELSE 0 END
      + CASE WHEN {any_of('lower(sents[i])', L.BENEFIT)} THEN 14 ELSE 0 END + CASE WHEN aca_markers < 3 AND s1_sent_hit[i] THEN 14 ELSE 0 END + CASE WHEN regexp_matches(sents[i], {q(ENUM)}) THEN 10 ELSE 0 END
      - CASE WHEN regexp_matches(sents[i], {q(NUMBER)}) AND regexp_matches(sents[i], {q('(?i)(?:19|20)[0-9]{2}|' + '|'.join(L.SENT_DATA) + '|%|' + chr(92) + 'bsampel' + chr(92) + 'b')}) THEN 8 ELSE 0 END
      + CASE WHEN len([o FOR o IN openers IF o = openers[i]]) > 1 THEN 12 ELSE 0 END)) FOR i IN range(1, n_sents + 1)] AS raw_sents FROM p),
f1 AS (SELECT *, [CAST(greatest(2, least(98, floor(raw_sents[i] * 0.88 + raw_sents[greatest(i - 1, 1)] * 0.06 + raw_sents[least(i + 1, n_sents)] * 0.06 + 0.5))) AS INT) FOR i IN range(1, n_sents + 1)] AS sent_scores FROM f0),
f2 AS (SELECT *, CASE WHEN n_sents > 0 THEN list_sort(sent_scores)[n_sents // 2 + 1] ELSE 30 END AS sent_median,
    CASE WHEN n_sents > 1 THEN sqrt(list_avg([(x - list_avg(sent_scores)) * (x - list_avg(sent_scores)) FOR x IN sent_scores])) ELSE 0 END AS sent_spread,
    CASE WHEN n_sents > 0 THEN len([x FOR x IN sent_scores IF x >= 50]) / n_sents ELSE 0 END AS ai_like_prop FROM f1),
f3 AS (SELECT *, CASE WHEN n_sents > 0 THEN greatest(0, least(0.6, (sent_spread - 8) / 24)) ELSE 0 END AS bw, sent_median * 0.35 + ai_like_prop * 100 * 0.65 AS part FROM f2),
f4 AS (SELECT *, CAST(greatest(2, least(98, floor(raw_score * (1 - bw) + part * bw + 0.5))) AS INT) AS score FROM f3),
f5 AS (SELECT *, CASE WHEN total_w < 50 THEN 0.5 WHEN total_w < 80 THEN 0.7 ELSE 1 END * CASE WHEN n_sents < 3 THEN 0.55 WHEN n_sents < 5 THEN 0.8 ELSE 1 END
    * CASE WHEN sent_spread > 18 THEN 0.75 ELSE 1 END * CASE WHEN score BETWEEN 38 AND 62 THEN 0.7 ELSE 1 END AS cf FROM f4),
f AS (SELECT *, ['rendah', 'sedang', 'tinggi'][1 + CASE WHEN single_signal THEN 0 ELSE greatest(0, CASE WHEN cf >= 0.75 THEN 2 WHEN cf >= 0.45 THEN 1 ELSE 0 END - CASE WHEN mixed THEN 1 ELSE 0 END) END] AS confidence,
    CASE WHEN score >= 75 THEN 'terindikasi' WHEN score >= 50 THEN 'perlu ditinjau' ELSE 'cenderung natural' END AS classification FROM f5)
"""

#: The layers without an end at which texts are too long for repeated ideas.
WHOLE_LAYERS = LAYERS.replace("n_sents BETWEEN 4 AND 300 THEN", "n_sents >= 4 THEN")
