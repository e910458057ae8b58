import hashlib
import random
import re

from leakframe.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def fine(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 10 <= len(d) <= 15


def base(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if fine(kind, m[0])]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def texts():
    rnd = random.Random(4)
    out = [
        None, "", "a@b.c%d@e.f", "a@b@c.d", "x@y", "1.2.3.4.5.6.7.8", "001.2.3.0255 256.1.1.1 0000000000000000000001.1.1.1", "4111 1111 1111 1111 é 4111-1111-1111-1112",
        "4111111111111111" * 2, "+1 (988) 555-2485 ok +1..... +12 3", "é😀 me@é.com you@ex-a.co.uk. +49 30 1234567890123456", "5 5  5", "a" * 50_000 + "@", "1" * 50_000, "+1" + " " * 50_000,
        "1 " * 20_000, "a@b.cc " * 700, "1.1.1.1 " * 600,
    ]
    out += ["".join(rnd.choice("a1@. -+()4é\n29") for _ in range(rnd.randint(5, 80))) for _ in range(400)]
    out += ["".join(rnd.choice(["4111111111111111", "4111 1111 1111 1111", " ", "-", ".", "1", "+1 555", "a@b.c", "1.2.3.4", "é"]) for _ in range(9)) for _ in range(200)]
    return out


def test_base_spans_by_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in pii.digest(pii.personal_data(spark.createDataFrame(rows, "doc_id int, text string, spans string"))).collect()}
    for i, text, _ in rows:
        want = base(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (text or "")[:80]
        for kind in BASE:
            assert got[i][f"n_{kind}"] == sum(w.startswith(kind + ":") for w in want)
        assert [s for s in got[i].spans.split(",") if s and s.split(":")[0] in BASE] == want


def test_validators_and_context(spark):
    rows = [
        (1, "pay to GB82 WEST 1234 5698 7654 32 now"), (2, "GB82WEST12345698765432"), (3, "GB83WEST12345698765432"), (4, "my SSN: 123-45-6789"),
        (5, "number 123-45-6789"), (6, "ssn 000-45-6789"), (7, "call +1 (988) 555-2485"), (8, "+1 (988) 555-2485"), (None, None),
    ]
    found = pii.personal_data(spark.createDataFrame(rows, "doc_id int, text string"))
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in found.collect()}
    assert got[1] == [("iban", 7, 34)] and got[2] == [("iban", 0, 22)] and got[3] == []
    assert got[4] == [("ssn", 8, 19)] and got[5] == [] and got[6] == [] and got[None] == []
    score = {r.doc_id: r.spans[0].score for r in found.collect() if r.doc_id in (7, 8)}
    assert score[7] > score[8]
    assert pii.personal_data(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_words_of_a_list_hold_for_all_of_it(spark):
    def number(i):
        return f"{100 + i % 500}-{10 + i % 89}-{1000 + i}"

    far = " and so on" * 8
    rows = [
        (1, "SSN: 123-45-6789, 234-56-7891, 345-67-8912", 3), (2, "123-45-6789 (SSN)", 1), (3, "SSNs: 123-45-6789", 1),
        (4, "SSNs\n" + "\n".join(f"Mr. É{i}: {number(i)}" for i in range(1000)), 1000), (5, ", ".join(map(number, range(600))) + " are social security numbers", 600),
        (6, f"ssn{far} 123-45-6789", 0), (7, f"123-45-6789{far} ssn", 0), (8, f"ssn 123-45-6789, 000-11-2222, 234-56-7891{far} 345-67-8912", 2),
        (9, "classns 123-45-6789", 0), (10, f"123-45-6789{far} 234-56-7891, 345-67-8912 ssn", 2),
    ]
    found = pii.personal_data(spark.createDataFrame(rows, "doc_id int, text string, want int"))
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "ssn"] for r in found.collect()}
    for i, text, want in rows:
        every = [m.span() for m in re.finditer(r"\b(?!000)\d{3}-\d\d-\d{4}\b", text)]
        assert len(got[i]) == want and got[i] == (every[-want:] if i == 10 else every[:want])


def test_no_python_and_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    plan = pii.digest(pii.personal_data(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
