"""Each stage of the pipeline on small tables, against plain versions of what it says."""

import itertools
import random
from collections import Counter

import pytest

import corpus_pipeline as P
from glyphmill.llm import mixing, quality
from tests.llm.test_small import edited, words

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RNG = random.Random(17)
LONG = " ".join("".join(RNG.choices("abcdefgh", k=5)) for _ in range(30_000))


@pytest.fixture(scope="module")
def docs(spark):
    base = " ".join("".join(RNG.choices("abcdefghijkl", k=4)) for _ in range(80))
    texts = [None, "", " \n\t ", base, base, edited(base, 1), edited(base, 30), LONG, "one  two\nthree\r\nfour five", "ünï 🎉 a\x1fb"]
    texts += [" ".join("".join(RNG.choices("mnopqrst", k=4)) for _ in range(40)) for _ in range(30)]
    rows = [(i, t, "en", (None, "a", "a", "a", "b")[i % 5], 0) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, "a null id", "en", "b", 0)]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def labels(tmp_path_factory, spark, docs):
    where = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def rows(df):
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("stage", [s for _, s in P.STAGES[:4]])
def test_stages_keep_their_columns_and_take_empty_tables(spark, docs, labels, stage):
    from pyspark.sql import functions as F

    more = docs.withColumns({c: F.lit(1.5) for c in ("_score", "size", "_part", "_whole", "target", "keys", "rep", "n")})
    some = stage(spark, more, labels)
    assert some.columns == list(P.COLUMNS)
    assert all(r["n_chars"] == len(r["text"] or "") for r in some.collect())
    assert rows(some) == rows(stage(spark, docs, labels))
    assert stage(spark, docs.where("false"), labels).count() == 0


def test_quality_stage_keeps_what_the_classifier_gives_the_threshold(spark, docs, labels):
    model = quality.learn(docs, spark.read.parquet(f"{labels}/labels.parquet"))
    of = quality.Featurizer()
    want = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect() if model.score(of(r["text"] or "")) >= quality.THRESHOLD]
    assert rows(P.keep_quality(spark, docs, labels)) == sorted(want, key=str)


def test_near_stage_keeps_the_first_of_each_group(spark, docs, labels):
    every = docs.collect()
    sets = {}
    for r in every:
        if r["doc_id"] is not None:
            w = words(r["text"])
            sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = [(r["doc_id"], r["text"], r["source"]) for r in every if r["doc_id"] is None or find(r["doc_id"]) == r["doc_id"]]
    assert rows(P.drop_near(spark, docs, labels)) == sorted(want, key=str) and len(want) < len(every)


def test_mix_stage_gives_whole_texts_and_first_words(spark, docs, labels):
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"], r["text"], r["source"]] += r["taken"]
    got = Counter()
    parts = 0
    for r in P.mix_sources(spark, docs, labels).collect():
        origin = next(k for k in taken if k[0] == r["doc_id"] and k[2] == r["source"])
        n = len(words(r["text"]))
        got[origin] += n
        if r["text"] != origin[1]:
            parts += 1
            assert origin[1].startswith(r["text"]) and words(r["text"]) == words(origin[1])[:n]
    assert got == Counter({k: n for k, n in taken.items() if n}) and parts


def test_encode_stage_gives_the_libraries_ids(spark, docs, labels):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(P.default_tokenizer())
    for r, text in zip(sorted(P.encode(spark, docs, labels).collect(), key=lambda r: str(r["doc_id"]) + str(len(r["ids"]))), [x["text"] for x in sorted(docs.collect(), key=lambda r: str(r["doc_id"]) + str(len(t.encode(r["text"] or "", add_special_tokens=False).ids)))]):
        assert r["ids"] == t.encode(text or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) and r["exact"]
    assert P.encode(spark, docs.where("false"), labels).count() == 0


def test_run_is_its_stages_one_after_the_other(spark, docs, labels):
    docs.write.mode("overwrite").parquet(f"{labels}/documents.parquet")
    step = spark.read.parquet(f"{labels}/documents.parquet")
    for i, (_, stage) in enumerate(P.STAGES):
        step.write.mode("overwrite").parquet(f"{labels}/step{i}")
        step = stage(spark, spark.read.parquet(f"{labels}/step{i}"), labels)
    want = Counter((r["doc_id"], tuple(r["ids"])) for r in step.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in P.run(spark, labels).collect()) == want


@pytest.mark.parametrize("ratio", [P.LINE_RATIO, 0.3])
def test_pipeline_drops_planted_lines_and_keeps_others(spark, ratio):
    """The line stage at its ratio and another, against brute force."""
    rows = []
    for source, n, planted in (("a", 200, 65), ("b", 200, 12), ("c", 20, 9), (None, 150, 150), ("d", 160, 12)):
        for i in range(n):
            lines = [f"only {source} {i}", "often but rarely enough" if i % 16 == 0 else "", "  planted line \t" if i < planted else f"other {i}"]
            rows.append((len(rows), "\n".join(lines), "en", source, 0))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"]: r for r in P.drop_lines(spark, df, "", ratio).collect()}
    docs, held = Counter(r[3] for r in rows), Counter()
    for _, t, _, s, _ in rows:
        held.update((s, x) for x in {y.strip(" \t\r") for y in t.split("\n")} - {""})
    gone = {k for k, n in held.items() if n >= P.LINE_DOCS and n > ratio * docs[k[0]]}
    assert gone == {("a", "planted line"), (None, "planted line")} | ({("d", "planted line")} if ratio < 0.075 else set())
    for i, t, _, s, _ in rows:
        want = "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\r")) not in gone)
        assert (got[i]["text"], got[i]["n_chars"]) == (want, len(want))


def test_line_stage_on_the_given_tables(spark):
    """On sf0.1 one line goes, the one planted in every source (9 to 13% of each), wherever it stands alone; every other line stays."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in P.drop_lines(spark, docs, "").select("doc_id", "text").collect()}
    dropped, touched = Counter(), 0
    for r in docs.select("doc_id", "text").collect():
        before, after = (r["text"] or "").split("\n"), got[r["doc_id"]].split("\n")
        if before != after:
            touched += 1
            dropped.update(x.strip(" \t\r") for x in (Counter(before) - Counter(after)).elements())
    assert len(dropped) == 1 and touched >= 1000 and next(iter(dropped)).startswith("The and attion to thanedble")
