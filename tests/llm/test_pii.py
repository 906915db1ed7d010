import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest

from basketwise.llm.pii import digests, sanitised

from .helpers import documents, prose, rows


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def brute(text):
    text = text or ""
    out = []
    digits = lambda x: re.sub("[^0-9]", "", x)
    for kind, pattern, good in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 13 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if good(m.group())]
    return out


def fixture():
    return [
        None, "", "plain text", "a@b.c", "mail a.b+c@d-e.f.g, x@y @z.w q@r.s@t.u v@w.x_y@z.a", "é🙂é a@b.cé 🙂c@d.e", "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 0001.002.03.255 1.2.3",
        "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111x5500005555555559", "+1 (212) 555-0100 +1234567 +49.30.1234567- +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+4111 1111 1111 1111",
        "1" * 30000 + " 1.1.1.1", "a" * 30000 + " x@y.zz", "." * 5000 + "@" * 5000 + "1-" * 9000, ("a@b.cc +123456789 " * 300), "x@y.z\nx@y.z\n\n1.1.1.1", "٣.٣.٣.٣ ４111111111111111 +1２34567890",
    ]


def test_base_spans_equal_brute_force(spark):
    texts = fixture()
    got = {r["doc_id"]: r for r in digests(documents(spark, texts).repartition(2)).collect()}
    for i, t in enumerate(texts):
        own = brute(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[0] == k for x in own) for k in ("email", "ip", "card", "phone")], (i, t)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and got[i]["spans"].startswith(text)


def revealing():
    """Zaphodine stands only beside one address, in several contexts; contact beside many."""
    texts = [f"{prose(i, 12)} contact Zaphodine today number{i} at zed@corp.example soon {prose(100 + i, 10)}" for i in range(6)]
    texts += [f"{prose(200 + i, 12)} contact someone at user{i}@corp.example soon {prose(300 + i, 10)}" for i in range(30)]
    return texts + [f"{prose(400 + i, 30)} contact" for i in range(60)] + ["Zaphodine not here"] * 0


def test_terms_that_reveal_an_entity(spark):
    texts = revealing()
    df = documents(spark, texts).selectExpr("*", "1 AS k", "2 AS id", "3 AS term").repartition(3)
    got = {r["doc_id"]: r["spans"] for r in digests(df).collect()}
    for i in range(6):
        at = texts[i].index("Zaphodine")
        assert f"removed:{at}:{at + 9}" in got[i].split(",") and "email:" in got[i]
        here = texts[i].index("contact")
        assert f":{here}:{here + 7}" not in got[i]
    assert all(got[i].count(":") == 2 for i in range(6, 36)) and all(got[i] == "" for i in range(36, 96))
    assert {r["doc_id"]: r["spans"] for r in digests(df, broadcast_terms=0).collect()} == got  # terms joined by a shuffle
    out = {r["doc_id"]: r for r in sanitised(df).collect()}
    assert "Zaphodine" not in out[0]["text"] and "<EMAIL>" in out[0]["text"] and out[0]["n_chars"] == len(out[0]["text"])
    assert out[50]["text"] == texts[50] and sanitised(df).columns == df.columns


def test_sanitised_text_and_odd_rows(spark):
    df = documents(spark, [(1, "a@b.c x"), (1, "a@b.c x"), (1, "y"), (None, "+1 234567890 z"), (None, None), (2, "🙂+4111 1111 1111 1111🙂 q 1.1.1.1")])
    assert rows(sanitised(df), "doc_id", "text") == sorted([(1, "<EMAIL> x"), (1, "<EMAIL> x"), (1, "y"), (None, "<PHONE> z"), (None, None), (2, "🙂+<CARD>🙂 q <IP>")], key=repr)
    empty = documents(spark, [])
    assert digests(empty).count() == 0 and sanitised(empty).count() == 0


def test_far_short_and_second_mentions(spark):
    """A short name with a digit, 500 characters before the address and again at the end."""
    texts = [f"{prose(i, 3)} Zx7 {'filler words ' * 45}{prose(50 + i, 12)} at zed@corp.example {prose(100 + i, 60)} zx7 end" for i in range(6)]
    texts += [f"filler words end at {prose(200 + i, 40)}" for i in range(60)]
    texts += [f"abe@corp.example {prose(300 + i, 40)} Qy9" for i in range(4)]  # nothing stands before the address
    got = {r["doc_id"]: r["spans"].split(",") for r in digests(documents(spark, texts).repartition(3)).collect()}
    for i in range(6):
        for at in (texts[i].index("Zx7"), texts[i].rindex("zx7")):
            assert f"removed:{at}:{at + 3}" in got[i]
    assert all(got[i] == [""] for i in range(6, 66))
    assert all(f"removed:{len(texts[i]) - 3}:{len(texts[i])}" in got[i] for i in range(66, 70))


def test_dotted_capital_and_kinds_of_terms(spark):
    """A name whose lower case has one more code point is found as well; numbers and codes are told apart from words."""
    texts = [f"{prose(i, 12)} İstanbullu at zed@corp.example {prose(100 + i, 10)}" for i in range(6)] + [f"{prose(400 + i, 30)} contact" for i in range(60)]
    df = documents(spark, texts)
    got = {r["doc_id"]: r["spans"].split(",") for r in digests(df).collect()}
    for i in range(6):
        at = texts[i].index("İstanbullu")
        assert f"removed:{at}:{at + 10}" in got[i]
    assert all("İstanbullu" not in r["text"] for r in sanitised(df).collect())
    often = [f"{prose(i, 12)} {'Zorro 4711 zx7' if i < 20 else ''} {'zed@corp.example' if i < 6 else ''} {prose(100 + i, 10)}" for i in range(400)]
    out = {r["doc_id"]: r["text"] for r in sanitised(documents(spark, often)).collect()}
    assert all("<WORD> <NUMBER> <CODE>" in out[i] and "Zorro" not in out[i] for i in range(6)) and "Zorro 4711 zx7" in out[19]


def test_long_texts_take_time_in_proportion(spark):
    """Hundreds of thousands of numbers, and spans by the thousand over many chunks."""
    numbers = " ".join(str(7919 * i % 10**9) for i in range(200_000))
    cards = "é🙂 4111 1111 1111 1111 a@b.cc, " * 3000
    texts = [numbers, cards, "x" * 4090 + " a@b.cc " + "y" * 4090 + " +123456789", "5" * 20_000]
    began = time.time()
    got = {r["doc_id"]: r for r in digests(documents(spark, texts)).collect()}
    out = {r["doc_id"]: r["text"] for r in sanitised(documents(spark, texts)).collect()}
    assert time.time() - began < 120
    for i, t in enumerate(texts):
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(t))
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert out[0] == texts[0] and out[1].count("<CARD>") == 3000 and out[1].count("<EMAIL>") == 3000 and "4111" not in out[1]
    assert out[2] == texts[2].replace("a@b.cc", "<EMAIL>").replace("+123456789", "<PHONE>")


def brute_terms(docs, reach=48, general=0.7, remove=0.9, support=2):
    """What each document (id, text) discloses by co-occurrence: for each term its kind, counted over different documents."""
    every = sorted({(i, t or "") for i, t in docs})
    held = {}
    for d in every:
        spans = brute(d[1])
        if spans:
            around = {}
            for kind, a, b in spans:
                value = d[1][a:b].lower() if kind == "email" else re.sub("[^0-9.]", "", d[1][a:b])
                around.setdefault((kind, value), set()).update((d[1][max(a - reach, 0) : a], d[1][b : b + reach]))
            plain = list(d[1])
            for _, a, b in spans:
                plain[a:b] = "\n" * (b - a)
            held[d] = ({e: frozenset(x) for e, x in around.items()}, {x.lower() for x in re.findall(r"[^\W_]+", "".join(plain))})
    n_term = Counter(x for _, t in every for x in {x.lower() for x in re.findall(r"[^\W_]+", t)})
    found = {d: {} for d in held}
    for e in {e for around, _ in held.values() for e in around}:
        of = [d for d in held if e in held[d][0]]
        bits = math.log2(len(every) / len(of))
        if len(of) < support or bits <= 0:
            continue
        for term in {t for d in of for t in held[d][1]}:
            both = [d for d in of if term in held[d][1]]
            if len(both) >= support and len({held[d][0][e] for d in both}) >= support:
                share = math.log2(len(both) * len(every) / (len(of) * max(n_term[term], len(both)))) / bits
                if share >= general - 1e-12:
                    for d in both:
                        found[d][term] = max(found[d].get(term, 0), 2 if share >= remove - 1e-12 else 1)
    return found


def random_corpus(seed, n=160):
    """Names that stand beside some addresses, in one document or several, and rows that repeat."""
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        text = [prose(rng.random(), rng.randrange(3, 12), 90)]
        for _ in range(rng.randrange(4)):
            who = rng.randrange(14)
            text.append(rng.choice([f"name{who % 5} mail u{who}@corp.example", f"u{who}@corp.example , Nn{who} x{who % 3}", f"name{who}", f"+1234567{who:03d} tel{who % 4}"]))
            text.append(prose(rng.random(), rng.randrange(1, 9), 90))
        docs += [(i, " ".join(text))] * rng.choice([1, 1, 1, 5])
    return docs + [(n, None), (n + 1, "")]


@pytest.mark.parametrize("seed", range(3))
def test_disclosed_terms_equal_brute_force(spark, seed):
    docs = random_corpus(seed)
    want = brute_terms(docs)
    assert sum(map(len, want.values())) > 20
    for r in digests(documents(spark, docs).repartition(3)).collect():
        text = dict(docs)[r["doc_id"]] or ""
        told = want.get((r["doc_id"], text), {})
        plain = list(text)
        for _, a, b in brute(text):
            plain[a:b] = "\n" * (b - a)
        spans = {(m.start(), m.end(), told[m.group().lower()]) for m in re.finditer(r"[^\W_]+", "".join(plain)) if m.group().lower() in told}
        got = [x.split(":") for x in r["spans"].split(",") if x and x.split(":")[0] in ("word", "number", "code", "removed")]
        assert {(int(a), int(b), 2 if k == "removed" else 1) for k, a, b in got} == spans, r["doc_id"]


def test_repeated_rows_disclose_the_same(spark):
    pair = [(i, f"{prose(i, 12)} Zaphodine at zed@corp.example {prose(100 + i, 10)}") for i in range(2)]
    rest = [(10 + i, prose(200 + i, 20)) for i in range(60)]
    once = {r["doc_id"]: r["spans"] for r in digests(documents(spark, pair + rest)).collect()}
    assert "removed" in once[0] and "removed" in once[1]
    for r in digests(documents(spark, pair + [pair[1]] * 8 + rest + [rest[3]] * 5).repartition(3)).collect():
        assert r["spans"] == once[r["doc_id"]]


def test_dense_documents_end_soon(spark):
    """Two lists of ten thousand addresses and a hundred thousand terms that share both, in other words around each."""
    texts = []
    for turn in range(2):
        lines = [f"{'left' if turn else 'right'} u{i}@corp.example" for i in range(10_000)] + [f"t{i}q" for i in range(100_000)]
        texts.append("\n".join(lines))
    began = time.time()
    got = {r["doc_id"]: r for r in digests(documents(spark, texts + [prose(i, 30) for i in range(60)])).collect()}
    assert time.time() - began < 120
    assert got[0]["n_email"] == 10_000 and got[0]["spans"].count("removed:") == 100_000
