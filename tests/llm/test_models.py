"""Learned parts against plain solvers and enumeration, and held-out accuracy."""

import collections
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import lattice, pii, quality, substring_dedup
from glyphmill.llm.common import fold, ship
from glyphmill.llm.exact_dedup import exact_dedup
from glyphmill.llm.line_dedup import line_dedup
from glyphmill.llm.near_dedup import near_dedup

SF = "/root/testdata/sf0.01"


def test_dual_descent_reaches_what_a_plain_solver_reaches():
    rng = np.random.default_rng(4)
    for trial in range(4):
        n, d = 40, 6
        x = rng.normal(size=(n, d))
        y = np.where(x[:, 0] + 0.7 * rng.normal(size=n) > 0, 1, -1)
        cost = np.where(y > 0, 0.8, 0.3)
        rows, values = [np.arange(d)] * n, [x[i] for i in range(n)]
        w = quality.dual_descent(rows, values, y, d, cost, rounds=3000)
        wide = np.hstack([x, np.ones((n, 1))])
        alpha = np.zeros(n)  # projected gradient on the dual, small steps
        k = (wide * y[:, None]) @ (wide * y[:, None]).T
        step = 1 / np.linalg.eigvalsh(k)[-1]
        for _ in range(200_000):
            alpha = np.clip(alpha + step * (1 - k @ alpha), 0, cost)
        plain = (alpha * y) @ wide
        value = lambda u: u @ u / 2 + (cost * np.maximum(0, 1 - y * (wide @ u))).sum()
        assert value(w) <= value(plain) * 1.001 + 1e-6 and np.abs(w - plain).max() < 0.02


def test_log_ratios_by_counting():
    rows = [np.array([0, 2]), np.array([2]), np.array([1, 2, 4]), np.array([4])]
    y = np.array([1, 1, -1, -1])
    r = quality.log_ratios(rows, y, 6)
    p, q = np.array([1, 0, 2, 0, 0, 0]) + 1.0, np.array([0, 1, 1, 0, 2, 0]) + 1.0
    want = np.log(p / p.sum() / (q / q.sum()))
    want[[3, 5]] = 0
    assert np.allclose(r, want)


def auc(score, label):
    order = sorted(zip(score, label))
    i = 0
    total = 0.0
    while i < len(order):
        j = i
        while j < len(order) and order[j][0] == order[i][0]:
            j += 1
        total += sum((i + 1 + j) / 2 for _, y in order[i:j] if y)
        i = j
    n1 = sum(label)
    return (total - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_quality_of_held_out_documents(spark):
    ship(spark)
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    found = quality.score(docs.where(fold() == 0), quality.learn(docs.where(fold() != 0), labels)).join(labels.where("quality IS NOT NULL"), "doc_id").collect()
    assert auc([r["score"] for r in found], [r["quality"] == 1 for r in found]) > 0.95


def segmentations(word, ids):
    if not word:
        yield []
        return
    for j in range(1, len(word) + 1):
        if word[:j] in ids:
            for rest in segmentations(word[j:], ids):
                yield [ids[word[:j]], *rest]


@pytest.mark.parametrize("word", ["aab", "abab", "b", "aabbaab", "ab" * 14])
def test_expected_uses_by_enumeration(word):
    rng = np.random.default_rng(len(word))
    pieces = [lattice.MARK, "a", "b", "ab", "aab", lattice.MARK + "a", "ba", "bab"]
    p = rng.dirichlet(np.ones(len(pieces)))
    table, ids = lattice.Lattice(pieces), {s: i for i, s in enumerate(pieces)}
    if len(word) > 20:  # too many to enumerate: the two ways to compute must agree
        codes = next(lattice.grouped([word]))[1]
        arcs = table.arcs(codes)
        spelt = table.unknown(codes, arcs, np.log(p))
        assert np.allclose(table.expected(codes, np.array([3.0]), np.log(p)), table.expected_short(codes, np.array([3.0]), np.log(p), arcs, spelt), rtol=1e-9)
        return
    total, uses = 0.0, np.zeros(len(pieces))
    for seg in segmentations(lattice.MARK + word, ids):
        w = np.prod(p[seg])
        total += w
        np.add.at(uses, seg, w)
    codes = next(lattice.grouped([word]))[1]
    assert np.allclose(table.expected(codes, np.array([3.0]), np.log(p)), 3 * uses / total)
    assert np.allclose(table.log_prob(codes, np.log(p)), np.log(total))


def test_short_words_of_unknown_characters_do_not_vanish():
    pieces, w = lattice.pieces_of(lattice.default_pieces())
    table = lattice.Lattice(pieces)
    codes = next(lattice.grouped(["\U0001f9ff" * 20, "a" * 10 + "\U0001f9ff" * 10, "perhaps" + "x" * 13]))[1]
    times = np.array([2.0, 1.0, 3.0])
    arcs = table.arcs(codes)
    spelt = table.unknown(codes, arcs, w)
    assert np.allclose(table.expected(codes, times, w), table.expected_long(codes, times, w, arcs, spelt), rtol=1e-9)
    assert np.allclose(table.log_prob(codes, w), table.forward(codes, arcs, w, spelt)[:, -1], rtol=1e-12)


def test_pieces_are_found_behind_the_filter():
    pieces, _ = lattice.pieces_of(lattice.default_pieces())
    table, ids = lattice.Lattice(pieces), {p: i for i, p in enumerate(pieces)}
    for word in ["perhaps", "xqzvvk", "Überraschung", "a", "\U0001f9ff"]:
        text = lattice.MARK + word
        for k, found in enumerate(table.arcs(next(lattice.grouped([word]))[1]), 1):
            assert found[0].tolist() == [ids.get(text[i : i + k], -1) for i in range(len(text) - k + 1)]


def test_em_finds_the_labelers_reliabilities():
    rng = random.Random(9)
    right = [0.95, 0.8, 0.9, 0.6, 0.75]
    seen, truth = collections.Counter(), collections.defaultdict(collections.Counter)
    for _ in range(20_000):
        real = rng.random() < 0.4
        v = "".join("0" if rng.random() < 0.2 else "+" if (rng.random() < r) == real else "-" for r in right)
        seen[v] += 1
        truth[v][real] += 1
    q = pii.em(dict(seen))
    big = [v for v in seen if seen[v] >= 200]
    assert len(big) > 20 and all(abs(q[v] - truth[v][True] / seen[v]) < 0.08 for v in big)


def test_wider_spans():
    text = "mail: jane [at] doe [dot] example [dot] com now; tel. 0721 555 01 23; card 4111-1111-1111-1112; order 12 345 6789; a.b@c.example"
    found = pii.candidates(text)
    assert [(text[a:b], base) for a, _, b, base in found if base] == [("a.b@c.example", True)]
    wide = {text[a:b] for a, _, b, base in found if not base}
    assert {"0721 555 01 23", "4111-1111-1111-1112"} <= wide and any("[at]" in x for x in wide)
    ends = [(a, b) for a, _, b, _ in found]
    assert all(b <= c for (_, b), (c, _) in zip(ends, ends[1:]))
    by = {text[a:b]: pii.votes(text, a, k, b)[0] for a, k, b, _ in found}
    assert by["a.b@c.example"][0] == "+" and by["4111-1111-1111-1112"][2] == "-"


def test_spans_are_what_the_votes_and_the_classifier_say(spark):
    ship(spark)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["call +1 415 555 2671", "tel 0721 555 01 23", "card 4111 1111 1111 1111", "order 12 345 6789", "x@y.example", "host 10.0.0.1", "plain words"]) for _ in range(6)) for _ in range(60)]
    df = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[4])], "doc_id bigint, text string")
    counted = collections.Counter(pii.votes(t, a, k, b) for t in [r["text"] for r in df.collect()] for a, k, b, _ in pii.candidates(t))
    score = pii.fit_spans([(v, f, n) for (v, f), n in counted.items()])
    for r in pii.personal_data(df).join(df, "doc_id", "left").collect():
        if r["text"] is not None:
            want = [(pii.KINDS[k], a, b) for a, k, b, base in pii.candidates(r["text"]) if base or score[pii.votes(r["text"], a, k, b)[1]] >= pii.KEEP]
            assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == want


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows and ids, null ids, and a text of over a million characters."""
    ship(spark)
    rng = random.Random(1)
    long = " ".join("".join(rng.choices("abcdefg", k=6)) for _ in range(150_000))
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other text of one id here"), (None, "a b c d e f g"), (2, long), (3, long), (3, long), (4, long[:600_000] + " x"), (5, None), (5, "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), rows


def test_repeated_rows_and_long_texts(spark, odd):
    df, rows = odd
    found = collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(df).collect())
    assert found == {(1, 1, 3, True): 2, (None, 1, 3, False): 1, (1, 1, 1, True): 1, (2, 2, 3, True): 1, (3, 2, 3, False): 2, (4, 4, 1, True): 1, (5, 5, 2, True): 2}
    near = collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup(df).collect())
    assert near[3, 2, False] == 2 and near[2, 2, True] == 1 and near[4, 4, True] == 1 and sum(near.values()) == len(rows)
    cut = {(r["doc_id"], r["n_bytes"], len(r["kept"])) for r in substring_dedup.substring_dedup(df).collect()}
    n = len(rows[4][1])
    assert {(2, n, n), (3, n, 0)} <= cut and any(i == 4 and k < 60 for i, _, k in cut)
    lines = line_dedup(df.withColumn("host", F.lit(None).cast("string")), "doc_id", min_pages=2, max_ratio=0.15)
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in lines.collect()) == sorted((i or 0, int(t == "a b c d e f g" or t is not None and t == rows[4][1])) for i, t in rows)
