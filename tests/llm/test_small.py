"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import bpe, lattice, mixing, near_dedup, pii, quality, substring_dedup, suffix_array, webp
from glyphmill.llm.common import ship
from glyphmill.llm.exact_dedup import exact_dedup
from glyphmill.llm.line_dedup import line_dedup

RNG = random.Random(7)
VOCAB = ["ba", "do", "ki", "lu", "me", "no", "pa", "ri", "so", "tu", "va", "ze", "é", "ß"]
BASE = " ".join("".join(RNG.choices(VOCAB, k=RNG.randrange(1, 4))) for _ in range(60))


def edited(text, n):
    w = text.split(" ")
    for _ in range(n):
        w[RNG.randrange(len(w))] = "".join(RNG.choices(VOCAB, k=3))
    return " ".join(w)


TEXTS = [None, "", " \t ", "a", "one two", BASE, BASE, edited(BASE, 1), edited(BASE, 2), edited(BASE, 8), BASE + " end", "x" * 3000, "mail me: a.b@c.example or +1 (643) 555-5742 now", "card 4111 1111 1111 1111, ip 10.0.0.255 not 300.1.1.1",
         "line one\nshared line here\nlast", "shared line here\nother", "shared line here", "🎉 ünï  x", BASE[:120], " ".join(edited(BASE, 3) for _ in range(5))]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 5, 1.0, "k") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, size double, keep_id string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_exact_dedup(docs, none):
    got = {r["doc_id"]: r for r in exact_dedup(docs, keep="largest").collect()}
    for i, t in enumerate(TEXTS):
        same = [j for j, u in enumerate(TEXTS) if (u or "") == (t or "")]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(same), len(same), i == max(same))
        assert got[i]["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert exact_dedup(none).count() == 0
    assert exact_dedup(docs.withColumn("doc_id", F.lit(None).cast("bigint"))).where("kept").count() == 0


def test_line_dedup(docs, none):
    pages = docs.withColumn("host", F.lit("h"))
    got = {r["doc_id"]: r for r in line_dedup(pages, "doc_id", max_ratio=0.1, min_pages=3).collect()}
    assert got[14]["text"] == "line one\nlast" and got[16]["text"] == "" and got[16]["n_dropped"] == 1
    assert got[0]["n_lines"] == 0 and got[11]["text"] == TEXTS[11] and got[14]["keep_id"] == "k"
    assert line_dedup(none, "doc_id", host_col="source").count() == 0


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS)
    sizes = collections.Counter()
    for r in rows:
        assert r["size"] == len(words(TEXTS[r["doc_id"]])) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
    plan = {s: t for s, _, t in mixing.targets(list(sizes.items()))}
    taken = collections.Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - plan[s]) <= max(3, 0.02 * plan[s]) for s in plan)
    assert sorted(rows) == sorted(mixing.mix(docs).collect())
    assert mixing.mix(none).count() == 0
    assert mixing.targets([("a", 10), ("b", 100), (None, 1)])[0][2] == 20.0


def plain_targets(sizes, weights, share, most):
    """Share by share: what is over goes back to the rest until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in out]
        each = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if each[s] > most * sizes[s]]
        if not over:
            return out | each
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]


def test_mixing_against_every_word(spark, docs):
    """Every word of every source on its line, every slot of the schedule one by one."""
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)] + [(7, "one two three", "a"), (7, "one two three", "a"), (None, "x y", "b"), (8, None, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(df, block_tokens=5).collect()
    key = lambda i, t: hashlib.md5(f"{'' if i is None else str(i) + ':'}{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
    n = {r: len(words(r[1])) for r in rows}
    sizes = collections.Counter()
    for r in rows:
        sizes[r[2]] += n[r]
    targets = plain_targets(sizes, mixing.WEIGHTS, mixing.SHARE, mixing.MAX_REPEATS)
    total = sum(targets.values())
    block = int(max(1, min(5, total // 4096)))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    ends, cum = [], 0.0
    for s in names:
        cum += targets[s]
        ends.append(round(cum / total * mixing.ROUND))
    ranks, times = collections.Counter(), collections.Counter()
    for i in range(-(-int(total * 1000) // (block * 1000)) if total != int(total) else -(-int(total) // block)):
        point = i * mixing.GOLDEN % mixing.ROUND
        s = next(s for s, e in zip(names, ends) if point < e)
        blocks = -(-sizes[s] // block)
        if ranks[s] < 2 * blocks:
            times[s, ranks[s] % blocks] += 1
        ranks[s] += 1
    want = collections.Counter()
    for s in names:
        at = 0
        grouped = collections.Counter(r for r in rows if r[2] == s)
        for r in sorted(grouped, key=lambda r: key(r[0], r[1])):
            whole = n[r] * grouped[r]
            want[r] = sum(times[s, w // block] for w in range(at, at + whole)) // grouped[r]
            at += whole
    for r in got:
        assert r["taken"] == want[r["doc_id"], r["text"], r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6


def test_near_dedup(spark, docs, none):
    big = [(100 + i, edited(BASE, RNG.randrange(4))) for i in range(40)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(big, "doc_id bigint, text string"))
    for n, percent in ((3, 85), (5, 80)):
        got = {r["doc_id"]: r for r in near_dedup.near_dedup(every, words=n, similarity=percent).collect()}
        sets = {}
        for i, t in [*enumerate(TEXTS), *big]:
            w = words(t)
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        root = {i: i for i in sets}

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in itertools.combinations(sorted(sets), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
        for i, s in sets.items():
            assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s), find(i), find(i) == i)
    assert near_dedup.near_dedup(none).count() == 0


def test_near_dedup_of_groups_of_many_blocks_and_rows_of_one_id(spark, docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)  # read on the driver
    rng = random.Random(8)
    base = " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(90))
    rows = [(i, base if i % 5 == 0 else edited(base, rng.randrange(6))) for i in range(60)]
    rows += [(100, base + " more words at the end of it"), (101, "nothing in common with others here"), (101, rows[3][1]), (102, "a b c d e f"), (102, "a b c d e f g h i j k l")]
    got = {}
    for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        assert got.setdefault(r["doc_id"], r["component_id"]) == r["component_id"]
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = words(t)
        sets[i].append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {i: find(i) for i in sets}


def test_blocks_find_what_one_matrix_finds():
    sets = [np.sort(np.array(RNG.sample(range(1, 400), 60), np.uint64)) for _ in range(5)]
    sets += [np.unique(np.append(s[2:], np.uint64(1000 + i))) for i, s in enumerate(sets)]
    assert {tuple(sorted(p)) for p in near_dedup.linked(sets, 80)} == {(i, i + 5) for i in range(5)}
    assert set(near_dedup.linked(sets, 80, 5)) == {(i, i + 5) for i in range(5)}


def test_suffix_array():
    for _ in range(800):
        s = [RNG.randrange(RNG.choice([1, 2, 3])) for _ in range(RNG.randrange(30))]
        assert suffix_array.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_arrays_of_many_strings():
    for _ in range(400):
        strings = [[RNG.randrange(RNG.choice([1, 2, 3, 5])) for _ in range(RNG.randrange(1, 40))] for _ in range(RNG.randrange(1, 8))]
        if RNG.random() < 0.3:
            strings = [(s[:5] * 8)[: RNG.randrange(1, 41)] for s in strings]
        size = np.array([len(s) for s in strings])
        got, at = suffix_array.suffix_arrays(np.array([c for s in strings for c in s]), size), 0
        for s in strings:
            assert (got[at : at + len(s)] - at).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
            at += len(s)


def test_substring_dedup(spark, docs, none):
    extra = [(200, "y" * 200), (201, "y" * 90 + "z" * 60), (202, "q" + "z" * 55), (203, BASE[30:130] + "!" + BASE[:70])]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(every).collect()}
    seen = {}
    for i, t in [*enumerate(TEXTS), *extra]:
        b = (t or "").encode()
        gone = bytearray(len(b))
        own = [b[s : s + 50] for s in range(len(b) - 49)]
        for s, w in enumerate(own):
            if w in seen:
                gone[s : s + 50] = b"\1" * 50
        seen.update(dict.fromkeys(own, i))
        assert bytes(got[i]["kept"]) == bytes(x for x, g in zip(b, gone) if not g), i
        assert sum(e - a for a, e in got[i]["spans"]) == sum(gone)
    assert substring_dedup.substring_dedup(none).count() == 0


def without_repeats(rows):
    """Brute force: by id, what is left of each text once every 50 bytes that an earlier id has are gone."""
    seen, left = {}, {}
    for i, t in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if seen.setdefault(b[s : s + 50], i) < i:
                gone[s : s + 50] = b"\1" * 50
        left[i] = bytes(x for x, g in zip(b, gone) if not g)
    return left


def test_substring_dedup_of_rules_before_a_common_tail(spark, docs):
    rng = random.Random(11)
    say = lambda n: "".join(rng.choices("abcdefghij klmnop", k=n))
    # The rules whose 24 bytes have the least hashes: they are anchors of the strings that hold them.
    rules = sorted(map(chr, range(33, 127)), key=lambda c: substring_dedup.windows([c.encode() * 50])[3][0])[:6]
    rows = []
    for k in range(60):
        rule, tail = rules[k % 6], say(60)
        for n in (24, rng.choice([25, 30, 40])):
            rows.append((len(rows), say(40) + rule * n + tail + say(rng.randrange(40))))
    got = {r["doc_id"]: bytes(r["kept"]) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == without_repeats(rows)


def periodic(rng, n):
    """Pairs of texts that repeat one unit of 20 to 60 bytes, starting at different places, between other bytes."""
    say = lambda k: "".join(rng.choices("abcdefghij klmnop", k=k))
    rows = []
    for _ in range(n):
        unit = say(rng.randrange(20, 61))
        for _ in range(2):
            a = rng.randrange(len(unit))
            rows.append((len(rows), say(rng.randrange(30)) + (unit * 9)[a : a + rng.randrange(40, 200)] + say(rng.randrange(30))))
    return rows


@pytest.mark.parametrize("meet", [substring_dedup.MEET, 1])
def test_substring_dedup_of_periodic_texts(spark, docs, monkeypatch, meet):
    monkeypatch.setattr(substring_dedup, "MEET", meet)  # 1: every group is dealt out by cells
    rows = periodic(random.Random(13), 2000)
    got = {r["doc_id"]: bytes(r["kept"]) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = without_repeats(rows)
    assert [i for i in want if got[i] != want[i]] == []


def test_slices_hold_every_string_once():
    texts = [b"", b"x" * 49, b"ab" * 300, b"c", bytes(range(256)) * 4]
    found = [(int(i), int(o) + k) for owner, offset, parts in substring_dedup.slices(texts, 100) for i, o, p in zip(owner, offset, parts) for k in range(len(p) - 49)]
    assert sorted(found) == [(i, k) for i, t in enumerate(texts) for k in range(len(t) - 49)]


def test_substring_dedup_tells_rows_of_one_id_apart(spark, docs):
    rng = random.Random(5)
    a, b, c, d = ("".join(rng.choices("abcdefghij", k=120)) for _ in range(4))
    rows = [(1, a), (None, a), (None, b), (None, "x" + a[:70] + c), (2, c), (2, a), (2, d), (2, a[20:90] + d[:30]), (3, d)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    kept = sorted((r["doc_id"] or 9, r["n_bytes"], bytes(r["kept"]).decode()) for r in got)
    assert kept == sorted([(1, 120, a), (9, 120, ""), (9, 120, b), (9, 191, "x"), (2, 120, c), (2, 120, ""), (2, 120, d), (2, 100, d[:30]), (3, 120, "")])


def test_bpe_against_the_library(docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_tokenizer()
    t = tokenizers.Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in bpe.bpe_decode(bpe.bpe_encode(docs, path), path).collect()}
    for i, x in enumerate(TEXTS):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["decoded"] == t.decode(ids, skip_special_tokens=False)
    both = {r["doc_id"]: r for r in bpe.bpe_encode(docs, path, decoded_col="decoded").collect()}
    assert all(both[i]["ids"] == got[i]["ids"] and both[i]["decoded"] == got[i]["decoded"] for i in got)
    e = bpe.Encoder(bpe.Bpe(bpe.load(path)), kept=5)
    odd = ["a<|endoftext|>b  \n\n x", "it's we'll 12,3 \x00\x01", " " * 50, "aaaa" * 300, "tail ", "\n a\t b"] * 2
    for x in odd:
        assert e.encode([x])[0].tolist() == t.encode(x, add_special_tokens=False).ids
    assert bpe.bpe_encode(none, path).count() == 0


def test_bpe_on_every_control_and_space_character():
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_tokenizer()
    t = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(3)
    odd = [chr(c) for c in (*range(33), *range(0x7F, 0xA1), 0xAD, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
    pool = [*odd, *odd, *"abXYZ019.,'!-é中🎉ß", *[" "] * 60, "'s", "'ll", " the", "<|endoftext|>", "ing"]
    e = bpe.Encoder(bpe.Bpe(bpe.load(path)), kept=3000)
    for _ in range(400):
        texts = ["".join(rng.choices(pool, k=rng.randrange(25))) for _ in range(20)] + ["a .\x1fb"]
        ids, size = e.encode(texts)
        ends = np.cumsum(size).tolist()
        for x, a, b in zip(texts, [0, *ends], ends):
            assert ids[a:b].tolist() == t.encode(x, add_special_tokens=False).ids, x
    e.table["edge"] = -1
    with pytest.raises(ValueError):
        e.number("edge")


def test_lattice_sums_all_segmentations():
    pieces, w = lattice.pieces_of(lattice.default_pieces())
    table, ids = lattice.Lattice(pieces), {p: i for i, p in enumerate(pieces)}

    def brute(s, i=0):
        if i == len(s):
            return 1.0
        total = sum(np.exp(w[ids[s[i:j]]]) * brute(s, j) for j in range(i + 1, len(s) + 1) if s[i:j] in ids)
        return total + (0 if s[i] in ids else np.exp(sum(w[table.bytes_at[b]] for b in s[i].encode())) * brute(s, i + 1))

    for at, codes in lattice.grouped(["thorre", "é🎉x", "a"]):
        for i, v in zip(at, table.log_prob(codes, w)):
            assert abs(v - np.log(brute(lattice.MARK + ["thorre", "é🎉x", "a"][i]))) < 1e-9


def test_lattice_scores(docs, none):
    rows = {r["doc_id"]: r for r in lattice.lattice_scores(docs, F.col("doc_id") % 2 == 0, lattice.default_pieces(), head_words=3).collect()}
    train = collections.Counter()
    for i, t in enumerate(TEXTS):
        if i % 2 == 0:
            train.update([*words(t), None])
    n, v = sum(train.values()), len(train)
    for i, t in enumerate(TEXTS):
        tokens = [*words(t), None]
        assert (rows[i]["n_tokens"], rows[i]["n_known"], rows[i]["train_tokens"]) == (len(tokens), sum(x in train for x in tokens), n)
        assert abs(rows[i]["base_score"] - sum(np.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens)) < 1e-6 and rows[i]["score"] < 0
    assert lattice.lattice_scores(none, F.lit(True), lattice.default_pieces()).count() == 0


def test_quality():
    of = quality.Featurizer()
    good = [edited(BASE, 30) + "." for _ in range(60)]
    bad = [" ".join([w + "%%%" for w in edited(BASE, 30).split()]) for _ in range(60)]
    m = quality.fit([of(t) for t in good + bad], np.array([1] * 60 + [-1] * 60))
    assert all(m.score(of(edited(BASE, 30) + ".")) > 0.5 for _ in range(5)) and m.score(of(bad[0])) < 0.3
    assert 0 <= m.score(of("")) <= 1 and quality.fit([of("a")], np.array([1])).score(of("b")) > 0.5


def test_shapes_are_of_whole_words():
    long = "aB1-" * 100
    assert quality.shape(long) == "aA0-" * 100 and quality.shape("x" * 500 + "Y") == "aA"
    of = quality.Featurizer()
    # One word each, the same but for the last letter's case: they share the word's feature alone.
    assert len(of(long + "a")) == 2 and len(set(of(long + "a").tolist()) & set(of(long + "A").tolist())) == 1


def test_quality_columns(spark, docs, none):
    labels = spark.createDataFrame([(5, 1), (6, 1), (9, 0), (11, 0), (11, 1), (99, None)], "doc_id bigint, quality int")
    model = quality.learn(docs, labels)
    assert quality.score(docs, model).where("score between 0 and 1").count() == len(TEXTS)
    assert quality.score(none, quality.learn(none, labels)).count() == 0


def plain_spans(text):
    d = lambda s: "".join(re.findall("[0-9]", s))
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(d(m.group())) <= 19 and pii.luhn(d(m.group()))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(d(m.group())) <= 15]
    return sorted(out)


def test_pii(docs, none):
    for _ in range(5000):
        t = "".join(RNG.choices("ab@.1234567890 +()-x", k=RNG.randrange(60)))
        assert pii.base_spans(t) == plain_spans(t)
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
    for i, t in enumerate(TEXTS):
        assert [(s["start"], pii.KINDS.index(s["kind"]), s["end"]) for s in got[i] if s["base"]] == plain_spans(t or "")
    assert pii.personal_data(none).count() == 0
    q = pii.em({"++00+": 50, "--0-0": 40, "+0000": 5})
    assert q["++00+"] > 0.9 > 0.1 > q["--0-0"]


def test_media_round_trip(docs, none):
    for r in webp.media_column(docs).collect():
        p = webp.padded((TEXTS[r["doc_id"]] or "").encode())
        assert webp.samples_of(bytes(r["media"]), len(p)).tobytes() == p and r["payload_bytes"] == len(p)
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-64:])
    assert webp.media_column(none).count() == 0


class Bits(webp.BitWriter):
    """A writer of streams that use what our own files don't."""

    def simple(self, *symbols):
        self.put(1, 1)
        self.put(len(symbols) - 1, 1)
        self.put(1, 1)
        self.put(symbols[0], 8)
        if len(symbols) > 1:
            self.put(symbols[1], 8)

    def file(self):
        body = b"\x2f" + self.value.to_bytes((self.n + 7) // 8, "little")
        chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
        return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def head(w, width, height):
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)


def test_transforms():
    # Subtract green, then one colour in every pixel.
    w = Bits()
    head(w, 3, 2)
    w.put(1, 1), w.put(2, 2), w.put(0, 1), w.put(0, 1), w.put(0, 1)
    for s in (10, 20, 30, 255):
        w.simple(s)
    w.simple(0)
    assert (webp.read_webp(w.file()) == (255 << 24 | 30 << 16 | 10 << 8 | 40)).all()
    # Predictor "left" everywhere: residues of one sum up along the rows.
    w = Bits()
    head(w, 4, 2)
    w.put(1, 1), w.put(0, 2), w.put(0, 3), w.put(0, 1)
    for s in (1, 0, 0, 0, 0):
        w.simple(s)
    w.put(0, 1), w.put(0, 1), w.put(0, 1)
    for s in (1, 0, 0, 0, 0):
        w.simple(s)
    green = webp.read_webp(w.file()) >> 8 & 255
    assert green.tolist() == [[1, 2, 3, 4], [2, 3, 4, 5]]
    with pytest.raises(ValueError):
        webp.read_webp(b"RIFFxxxxWEBPVP8 ")


def test_copies_and_cache():
    # Green alphabet: 0 and 1 as literals, symbol 256 (a copy of one pixel), and a cache entry; two bits each.
    w = Bits()
    head(w, 6, 1)
    w.put(0, 1)  # no transform
    w.put(1, 1), w.put(1, 4)  # a cache of two colours
    w.put(0, 1)  # one group
    w.put(0, 1)  # lengths in full: 7 is "2", 8 is literal order
    used = {0: 2, 1: 2, 256: 2, 280: 2}
    cl = {2: 2, 0: 2, 17: 2, 18: 2}
    order = webp.CODE_LENGTH_ORDER
    w.put(15, 4)
    for s in order:
        w.put(cl.get(s, 0), 3)
    code = {s: int(f"{i:02b}"[::-1], 2) for i, s in enumerate(sorted(cl))}
    w.put(0, 1)

    def put(s, extra=0, bits=0):
        w.put(code[s], 2)
        w.put(extra, bits)

    put(2), put(2), put(18, 127, 7), put(18, 254 - 138 - 11, 7), put(2), put(18, 23 - 11, 7), put(2), put(0)
    for s in (5, 6, 255):
        w.simple(s)
    w.simple(1)  # distance symbol 1: two in the table, one to the left
    sym = {s: int(f"{i:02b}"[::-1], 2) for i, s in enumerate(sorted(used))}
    for s in (0, 1, 256, 0, 280, 256):
        w.put(sym[s], 2)
    got = webp.read_webp(w.file())[0]
    a, b = 255 << 24 | 5 << 16 | 6, 255 << 24 | 5 << 16 | 1 << 8 | 6
    slot = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> 31
    cache = {}
    for p in (a, b, b, a):
        cache[slot(p)] = p
    assert got[:4].tolist() == [a, b, b, a] and got[4] == cache.get(0, 0) and got[5] == got[4]


def test_media_of_texts_with_copies():
    rng = random.Random(2)
    some = 0
    for _ in range(400):
        levels = rng.choice([2, 5, 17, 40, 100, 200, 256])
        b = bytes(rng.randrange(levels) for _ in range(rng.randrange(1500)))
        for _ in range(rng.randrange(4)):
            if b:
                i = rng.randrange(len(b))
                b += b[i : i + rng.randrange(300)] + bytes(rng.randrange(levels) for _ in range(rng.randrange(50)))
        p = np.frombuffer(webp.padded(b), np.uint8)
        some += bool(webp.copies_in(p))
        for start, n, d in webp.copies_in(p):
            assert all(p[start + j] == p[start + j - d] for j in range(n))
        assert webp.samples_of(webp.write_webp(p), len(p)).tobytes() == p.tobytes()
        assert webp.samples_of(webp.write_webp(p, most=128), len(p)).tobytes() == p.tobytes()  # several files
    assert some > 100
    repeated = np.frombuffer(webp.padded(b"The quick brown fox jumps over the lazy dog, 0123.\n" * 2000), np.uint8)
    media = webp.write_webp(repeated)
    assert len(media) < len(repeated) / 100 and webp.samples_of(media, len(repeated)).tobytes() == repeated.tobytes()


def plain_prediction(mode, left, top, top_left, top_right):
    """One channel; modes 11 to 13 need all channels and are below."""
    avg = lambda a, b: (a + b) // 2
    return {1: left, 2: top, 3: top_right, 4: top_left, 5: avg(avg(left, top_right), top), 6: avg(left, top_left), 7: avg(left, top), 8: avg(top_left, top), 9: avg(top, top_right), 10: avg(avg(left, top_left), avg(top, top_right))}[mode]


def predict(mode, px, y, x, w):
    black = (255, 0, 0, 0)
    if x == 0 and y == 0 or mode == 0 and x and y:
        return black
    if y == 0:
        return px[y][x - 1]
    if x == 0:
        return px[y - 1][x]
    l, t, tl = px[y][x - 1], px[y - 1][x], px[y - 1][x - 1]
    tr = px[y - 1][x + 1] if x + 1 < w else px[y][0]
    if mode == 11:
        p = [a + b - c for a, b, c in zip(l, t, tl)]
        return l if sum(abs(a - b) for a, b in zip(p, l)) < sum(abs(a - b) for a, b in zip(p, t)) else t
    clip = lambda v: max(0, min(255, v))
    if mode == 12:
        return [clip(a + b - c) for a, b, c in zip(l, t, tl)]
    if mode == 13:
        return [clip((a + b) // 2 + int(((a + b) // 2 - c) / 2)) for a, b, c in zip(l, t, tl)]
    return [plain_prediction(mode, *v) for v in zip(l, t, tl, tr)]


def pixels_to(w, px):
    """Pixels as literals with codes of eight bits for each channel; no cache, one distance symbol."""
    webp.put_code(w, [8] * 256)
    for _ in range(3):
        webp.put_code(w, [8] * 256)
    webp.put_code(w, [1])
    for a, r, g, b in px:
        for v in (g, r, b, a):
            w.put(int(f"{v:08b}"[::-1], 2), 8)


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor_undoes_what_a_plain_one_does(mode):
    rng = random.Random(mode)
    wd, ht = 7, 6
    px = [[tuple(rng.randrange(256) for _ in range(4)) for _ in range(wd)] for _ in range(ht)]
    left = [tuple((p - q) % 256 for p, q in zip(px[y][x], predict(mode, px, y, x, wd))) for y in range(ht) for x in range(wd)]
    w = Bits()
    head(w, wd, ht)
    w.put(1, 1), w.put(0, 2), w.put(1, 3), w.put(0, 1)  # predictor, tiles of 8
    for v in (mode, 0, 0, 255, 0):
        w.simple(v)
    w.put(0, 1), w.put(0, 1), w.put(0, 1)
    pixels_to(w, left)
    got = webp.read_webp(w.file())
    assert [[tuple(int(p) >> s & 255 for s in (24, 16, 8, 0)) for p in row] for row in got] == px


def test_cross_colour_undoes_what_a_plain_one_does():
    rng = random.Random(5)
    wd, ht = 6, 5
    signed = lambda v: v - 256 if v > 127 else v
    for _ in range(5):
        rb, gb, gr = (rng.randrange(256) for _ in range(3))
        px = [tuple(rng.randrange(256) for _ in range(4)) for _ in range(wd * ht)]
        delta = lambda t, c: signed(t) * signed(c) >> 5
        made = [(a, (r - delta(gr, g)) % 256, g, (b - delta(gb, g) - delta(rb, r)) % 256) for a, r, g, b in px]
        w = Bits()
        head(w, wd, ht)
        w.put(1, 1), w.put(1, 2), w.put(1, 3), w.put(0, 1)
        for v in (gb, rb, gr, 255, 0):
            w.simple(v)
        w.put(0, 1), w.put(0, 1), w.put(0, 1)
        pixels_to(w, made)
        got = webp.read_webp(w.file()).reshape(-1)
        assert [tuple(int(p) >> s & 255 for s in (24, 16, 8, 0)) for p in got] == px


def test_groups_of_codes_by_tile():
    # Two tiles of four columns: green is one symbol in each, a different one.
    w = Bits()
    head(w, 8, 2)
    w.put(0, 1), w.put(0, 1)  # no transform, no cache
    w.put(1, 1), w.put(0, 3)  # groups, tiles of 4
    w.put(0, 1)
    w.simple(0, 1)  # the group's low byte is green
    for v in (0, 0, 255, 0):
        w.simple(v)
    w.put(0, 1), w.put(1, 1)
    for green in (7, 9):
        for v in (green, 1, 2, 255, 0):
            w.simple(v)
    assert (webp.read_webp(w.file()) >> 8 & 255).tolist() == [[7] * 4 + [9] * 4] * 2


def test_near_offsets():
    assert webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and len(webp.NEAR) == 120 and webp.NEAR[-1] == (8, 7)
