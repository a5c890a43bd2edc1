"""The functions under names for SQL: a table function of sentences, and functions of words, cleaned texts and language."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from glyphmill.functions import lexicon as L
from glyphmill.functions import text as X
from glyphmill.sources.tables import ship


class Sentences:
    """Table function: the sentences of at least four words with their number, from 0, and their words."""

    def __init__(self) -> None:
        import regex

        self.sentence, self.word = regex.compile(X.SENTENCE), regex.compile(X.WORD)
        self.blank = regex.compile(r"[ \t\n\x0b\f\r]+")

    def eval(self, text: str) -> Iterator[tuple[int, str, int]]:
        if text is None:
            return
        whole = self.blank.sub(" ", text).strip(" ")
        place = 0
        for s in [m.strip(" ") for m in self.sentence.findall(whole)] or [whole]:
            n = len(self.word.findall(s))
            if n >= 4:
                yield place, s, n
                place += 1


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def replaced(c: str, steps: Sequence[tuple[str, str]]) -> str:
    for pattern, to in steps:
        step = lambda x, p=pattern, to=to: f"regexp_replace({x}, {quoted(p)}, {quoted(to)})"
        c = once(c, "q", f"CASE WHEN regexp_like(q, {quoted(X.NEEDED[pattern])}) THEN {step('q')} ELSE q END") if pattern in X.NEEDED else step(c)
    return c


def guarded(c: str, guard: str, steps: Sequence[tuple[str, str]]) -> str:
    return once(c, "m", f"CASE WHEN regexp_like(m, {quoted(guard)}) THEN {replaced('m', steps)} ELSE m END")


def among(x: str, terms: Sequence[str]) -> str:
    return f"{x} IN ({', '.join(map(quoted, terms))})"


def once(x: str, name: str, body: str) -> str:
    """``body`` of a value that is computed once: SQL functions put an argument wherever they name it."""
    return f"element_at(transform(array({x}), {name} -> {body}), 1)"


def words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), {quoted(X.WORD)}, 0)"


def names(c: str) -> str:
    return f"array_union(flatten(transform(regexp_extract_all({c}, {quoted(X.CAPITALISED)}, 0), m -> filter(split(lower(m), '[^a-zà-ÿ]+'), x -> x <> ''))), transform(regexp_extract_all({c}, {quoted(X.CAPITALS)}, 0), x -> lower(x)))"


CLEAN = guarded(guarded("coalesce(t, '')", X.MARKED, [*X.CODE, *X.MARKDOWN, *X.CODE]), X.CITING, [(X.ascii_bounds(p), to) for p, to in X.CITED])
COUNTS = "STRUCT<id: INT, en: INT, n: INT>"
TALLY = f"named_struct('id', size(filter(f, x -> {among('x', L.ID_FW)})), 'en', size(filter(f, x -> {among('x', L.EN_FW)})), 'n', size(w))"
FREE = f"filter(w, x -> {among('x', L.ID_FW + L.EN_FW)} AND NOT array_contains(e, x))"
COUNTED = once("c", "y", once(words("y"), "w", once(names("y"), "e", once(FREE, "f", TALLY))))
DECIDED = "CASE WHEN z.id + z.en < 4 OR greatest(z.id, z.en) / z.n < 0.02 THEN 'unknown' WHEN least(z.id, z.en) / (z.id + z.en) >= 0.30 THEN 'mixed' WHEN z.en > z.id THEN 'en' ELSE 'id' END"
#: Name and arguments, type, body.
FUNCTIONS = [
    ("gm_words(t STRING)", "ARRAY<STRING>", words("t")),
    ("gm_clean(t STRING)", "STRING", CLEAN),
    ("gm_names(t STRING)", "ARRAY<STRING>", names("t")),
    ("gm_counts_of(c STRING)", COUNTS, COUNTED),
    ("gm_counts(t STRING)", COUNTS, "gm_counts_of(gm_clean(t))"),
    ("gm_decide(k STRUCT<id: INT, en: INT, n: INT>)", "STRING", once("k", "z", DECIDED)),
    ("gm_language(t STRING)", "STRING", "gm_decide(gm_counts(t))"),
]


def register(spark: SparkSession) -> None:
    """Make the functions known to ``spark.sql`` in this session: ``gm_sentences`` (a table function in Python), and SQL functions that stay in the plan."""
    ship(spark)
    spark.udtf.register("gm_sentences", udtf(Sentences, returnType="pos int, sentence string, words int"))
    for head, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
