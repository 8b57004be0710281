import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from filigree.llm import pii

from .fixtures import clashing, documents, edge_rows, empty

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "a@b.c_d@e.f x@y x@y.z. q@-.- é@b.c 😀a.b+c@d-e.fr a@b.c@d.e",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0000255.01.2.3 999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 12 4111111111111111 5500 0000 0000 0004-1",
    "+1 (415) 555-2671 ++49 30 1234567 +1 +12345678901234567 +123456789012.",
    "call 4111  1111 1111 1111\n+44 20 7946 0958",
    "x" * 3_000 + "@" + "b." * 3_000 + "c",
    "1" * 5_000,
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))
    return total % 10 == 0


def brute(text):
    spans = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda m=m: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 14 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 10 <= len(d) <= 15,
            }[kind]()
            if good:
                spans.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s[2] for s in sorted(spans)]


def test_base_spans_equal_brute_force(spark):
    rows = edge_rows() + [(500 + i, t, None, None, None) for i, t in enumerate(TEXTS)]
    got = sorted(pii.find_personal_data(clashing(documents(spark, rows))).collect(), key=lambda r: repr((r["doc_id"], r["spans"])))
    expected = []
    for r in rows:
        own = brute(r[1])
        counts = [sum(s.startswith(k + ":") for s in own) for k in PATTERNS]
        expected.append((r[0], *counts, hashlib.sha256(",".join(own).encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(expected, key=repr)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert set(brute(texts[r["doc_id"]])) <= set(r["spans"].split(",") if r["spans"] else [])


def test_many_matches_take_time_in_proportion(spark):
    cards = "pay 4111111111111111 é " * 40_000
    docs = documents(spark, [(1, cards, None, None, None)]).cache()
    docs.count()
    begin = time.monotonic()
    [row] = pii.find_personal_data(docs).collect()
    assert time.monotonic() - begin < 20  # a second or two for each kind; appending to one array took minutes
    assert row["n_card"] == 40_000 and row["scored"][-1]["end"] == 23 * 40_000 - 3 and {s["score"] for s in row["scored"]} == {1.0}


def test_context_is_the_text_around_a_span(spark):
    """Around every place, also where pages of text meet."""
    rows = [(i, "é" * i + " card 4111111111111111 " + "x" * (i % 50) + " order", None, None, None) for i in range(440, 560, 7)]
    for r in pii.find_personal_data(documents(spark, rows)).collect():
        assert r["scored"][0]["score"] == (0.8 if r["doc_id"] % 50 + 2 + 5 <= 40 else 1.0)


def test_checksums_and_context_decide_on_added_spans(spark):
    rows = [
        (1, "IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000", None, None, None),
        (2, "GB82 WEST 1234 5698 7654 33", None, None, None),
        (3, "her social security number 123-45-6789", None, None, None),
        (4, "part 123-45-6789", None, None, None),
    ]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["score"]) for s in r["scored"] if s["kind"] in ("iban", "ssn")] for r in pii.find_personal_data(documents(spark, rows)).collect()}
    assert got == {1: [("iban", 5, 32, 1.0), ("iban", 37, 59, 1.0)], 2: [], 3: [("ssn", 27, 38, 0.6)], 4: []}


def test_context_moves_the_score(spark):
    rows = [(1, "my card 4111111111111111", None, None, None), (2, "order 4111111111111111", None, None, None), (3, "4111111111111111", None, None, None)]
    got = {r["doc_id"]: r["scored"][0]["score"] for r in pii.find_personal_data(documents(spark, rows)).collect()}
    assert got == {1: pytest.approx(1.0), 2: pytest.approx(0.5), 3: pytest.approx(0.8)}


@pytest.mark.parametrize(("number", "good"), [("GB82 WEST 1234 5698 7654 32", True), ("FR1420041010050500013M02606", True), ("FR1420041010050500013M02607", False)])
def test_mod97(spark, number, good):
    assert spark.range(1).select(pii.mod97(F.lit(number))).first()[0] is good


def test_no_python_in_the_plan_and_empty_table(spark):
    out = pii.find_personal_data(empty(spark))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and out.count() == 0
