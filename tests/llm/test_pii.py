"""Added spans on planted personal data that the base patterns miss, beside decoys: precision and recall, and base spans as they are."""

import random

import pytest

from glyphmill.llm import pii
from glyphmill.llm.common import ship


def planted(seed, n=1500):
    """(text, [(kind, start, end)] of spelt addresses, grouped telephone numbers and 13-digit cards) among base spans, plain words and decoys."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("ba de ki lo mu ra st en tion".split()) for _ in range(r.randrange(1, 4)))
    name = lambda: r.choice("jane bob maria otto chen ivan".split()) + r.choice(["", ".", "_"]) + r.choice(["doe", "smith", "ruiz", ""])
    host, end = lambda: r.choice("mail example test corp".split()) + num(1), lambda: r.choice("com org net de fr es".split())
    checked = lambda d: next(d + c for c in "0123456789" if pii.luhn(d + c))
    hidden = {
        "email": [lambda: f"{name()} [at] {host()} [dot] {end()}", lambda: f"{name()} (at) {host()}.{end()}", lambda: f"{name()} at {host()} dot {end()}"],
        "phone": [lambda: f"({num(3)}) 555-{num(4)}", lambda: f"0{num(3)} 555 {num(2)} {num(2)}", lambda: f"{r.randrange(200, 999)}-555-{num(4)}", lambda: f"0{r.randrange(20, 99)} {num(4)} {num(4)}"],
        "card": [lambda: checked("4" + num(11))],
    }
    lead = {"email": ["mail: ", "contact ", "write to "], "phone": ["tel. ", "call ", "phone: ", "fax "], "card": ["card ", "visa ", "payment by "], "ip": ["host ", "server "]}
    open_ = {"email": lambda: f"{name()}@{host()}.{end()}", "phone": lambda: f"+{r.choice(pii.CALLING)} {num(3)} 555 {num(4)}", "card": lambda: checked("4" + num(14)), "ip": lambda: ".".join(str(r.randrange(1, 255)) for _ in range(4))}
    decoys = [lambda: f"order {num(2)} {num(3)} {num(4)}", lambda: f"invoice {num(4)}-{num(4)}-{num(2)}", lambda: f"version 2.{num(2)}.{r.randrange(300, 999)}.1", lambda: f"isbn 978 {num(1)} {num(2)} {num(6)} {num(1)}", lambda: f"page {num(3)}-{num(3)}-{num(3)}",
              lambda: f"token {num(16)}", lambda: f"{word()} {num(16)} {word()}", lambda: f"order {num(13)}", lambda: f"release {num(3)} {num(4)} {num(3)}", lambda: "look at this dot thing", lambda: f"x={num(5)}-{num(5)}", lambda: f"{word()} 19{num(2)}-20{num(2)}"]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randrange(1, 5)):
            text += " ".join(word() for _ in range(r.randrange(3, 9))) + " "
            x = r.random()
            if x < 0.3:
                k = r.choice(list(open_))
                text += (r.choice(lead[k]) if r.random() < 0.6 else "") + open_[k]()
            elif x < 0.55:
                k = r.choice(["email", "phone", "phone", "card"])
                text += r.choice(lead[k]) if r.random() < 0.75 else ""
                s = r.choice(hidden[k])()
                spans.append((k, len(text), len(text) + len(s)))
                text += s
            else:
                text += r.choice(decoys)()
            text += r.choice([" ", ", ", ". ", "\n"])
        out.append((text, spans))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_added_spans_on_planted_data(spark, seed):
    ship(spark)
    docs = planted(seed)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(docs)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(df).collect()}
    for kind, precision, recall in (("email", 0.98, 0.95), ("card", 0.98, 0.95), ("phone", 0.85, 0.88)):
        hit = miss = wrong = 0
        for i, (_, spans) in enumerate(docs):
            want = [(a, b) for k, a, b in spans if k == kind]
            added = [(s["start"], s["end"]) for s in got[i] if s["kind"] == kind and not s["base"]]
            near = lambda x, ys: any(abs(x[0] - a) <= 1 and abs(x[1] - b) <= 1 for a, b in ys)  # noqa: E731, B023
            hit += sum(near(x, want) for x in added)
            wrong += sum(not near(x, want) for x in added)
            miss += sum(not near(x, added) for x in want)
        assert hit >= 100 and hit / (hit + wrong) >= precision and hit / (hit + miss) >= recall, (kind, hit, wrong, miss)
    for i, (t, _) in enumerate(docs):
        assert [(s["start"], pii.KINDS.index(s["kind"]), s["end"]) for s in got[i] if s["base"]] == pii.base_spans(t)
    assert not any(s["kind"] == "ip" and not s["base"] for spans in got.values() for s in spans)
