"""Personal data: base spans against the contract's patterns, linear time, disclosing terms, awkward rows."""

import hashlib
import random
import re
import time

import pytest

from quillon.llm import op09_pii as pii
from quillon.llm import queries

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(sum(map(int, str(d))) for d in doubled) % 10 == 0


def brute_force(text):
    """(kind, start, end) straight from the contract."""
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in re.finditer(EMAIL, text)]
    out += [("ip", *m.span()) for m in re.finditer(IP, text) if all((p.lstrip("0") or "0").isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(CARD, text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(PHONE, text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_base_spans_equal_the_patterns_on_random_texts():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "x@y.z", ".", "-", "_", "%", "+", "+1 ", "1", "25", "255", "256", "4111 1111 1111 1111", " ", "(", ")", "é", "0", "00", "12345", "\n", "a@b.c_d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == brute_force(text), text


def test_spans_of_long_runs_take_linear_time():
    began = time.time()
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)]
    for text in ("7" * 1_000_000, "a" * 1_000_000 + "@", "a." * 500_000 + "@b", "x@" * 300_000, "1." * 500_000, "+1" + " " * 1_000_000, "9 " * 500_000, "+" * 1_000_000):
        spans = pii.base_spans(text)
        pii.terms_near(text, spans)
    many = "1.2.3.4 " * 60_000
    spans = pii.base_spans(many)
    assert len(spans) == 60_000 and pii.terms_near(many + "word", spans) == {("ip", pii.entity_of("ip", "1.2.3.4"), "word")}
    assert len(pii.term_places("abc 1.2.3.4 " * 60_000, pii.base_spans("abc 1.2.3.4 " * 60_000), ["abc"])) == 60_000
    assert time.time() - began < 30


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force_on_whole_tables(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    got = rows_of(queries.op9_pii(spark, f"/root/testdata/{sf}"))
    assert len(got) == len(texts)
    for r in got:
        want = brute_force(texts[r["doc_id"]])
        assert tuple(r[f"n_{k}"] for k in ("email", "ip", "card", "phone")) == tuple(sum(s[0] == k for s in want) for k in ("email", "ip", "card", "phone"))
        assert r["base_sha256"] == sha(want)
        told = [s.split(":") for s in r["spans"].split(",") if s]
        assert [(k, int(a), int(b)) for k, a, b in told if k != "term"] == want and sum(k == "term" for k, _, _ in told) == r["n_term"]


def test_terms_of_a_kind_are_found(spark):
    assert pii.cleaned("mail a.b@c.example now, 1.2.3.4 and 300.1.1.1, 4111 1111 1111 1111, +1 (555) 123-4567.", []) == "mail [EMAIL] now, [IP] and 300.1.1.1, [CARD], [PHONE]."
    rows = [(i, f"the zephyrine x{i}@mail.example of") for i in range(8)] + [(100 + i, "the of and plain text") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows_of(pii.pii(df))}
    assert all((got[i]["n_email"], got[i]["n_term"]) == (1, 1) for i in range(8)) and all(got[i + 100]["spans"] == "" for i in range(60))
    clean = {r["doc_id"]: r["text"] for r in rows_of(pii.sanitize(df))}
    assert clean[0] == "the  [EMAIL] of" and clean[100] == "the of and plain text"


def test_disclosing_terms_go_everywhere(spark):
    far = "one two three four five six seven"
    rows = [(i, f"mail x{i}@mail.example from zephyrine") for i in range(3)] + [(3, f"x3@mail.example {far} zephyrine"), (4, "Zephyrine wrote plain text")]
    rows += [(100 + i, f"the of and plain text mail from no. {i}") for i in range(95)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows_of(pii.pii(df))}
    # Three documents of five hold the term near a span, two elsewhere: beyond the window and without any span.
    assert [got[i]["n_term"] for i in range(5)] == [1] * 5 and got[4]["spans"] == "term:0:9"
    assert all(got[100 + i]["n_term"] == 0 for i in range(95))
    clean = {r["doc_id"]: r["text"] for r in rows_of(pii.sanitize(df))}
    assert not any("zephyrine" in t.lower() for t in clean.values()) and clean[4] == " wrote plain text" and clean[100] == rows[5][1]


def test_names_beside_one_address_are_found(spark):
    """Each person's name stands beside their own address only; addresses abound, so no name tells of the kind."""
    people = ["Quimby", "Zorba", "Ximena", "Thaddeus"]
    rows = [(10 * i + j, f"please write to {p} at {p[0].lower()}{i}@mail.example about item {j}") for i, p in enumerate(people) for j in range(3)]
    rows += [(1000 + i, f"please write to us at office{i}@mail.example about plain things") for i in range(100)] + [(5000, "then Quimby spoke")]
    got = {r["doc_id"]: r for r in rows_of(pii.pii(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert [got[10 * i + j]["n_term"] for i in range(4) for j in range(3)] == [1] * 12
    assert got[5000]["spans"] == "term:5:11" and all(got[1000 + i]["n_term"] == 0 for i in range(100))


def test_awkward_rows_and_clashing_columns(spark):
    schema = "doc_id long, text string, _terms string, _key long, _sha string, term string, p double"
    rows = [(1, None, None, None, None, None, None), (None, "a@b.c", "keep", 5, "s", "t", 1.0), (2, "", "", 0, "", "", 0.0), (2, "", "", 0, "", "", 0.0), (3, "no data", "x", 1, "y", "z", 2.0)]
    rows += [(10 + i, "zephyrine x@mail.example", "x", 1, "y", "z", 2.0) for i in range(6)] + [(100 + i, "plain words", "x", 1, "y", "z", 2.0) for i in range(60)]
    df = spark.createDataFrame(rows, schema)
    got = rows_of(pii.pii(df))
    assert len(got) == len(rows) and {(r["doc_id"], r["n_email"]) for r in got if r["doc_id"] is None} == {(None, 1)}
    assert [r["base_sha256"] for r in got if r["doc_id"] in (1, 2)] == [sha([])] * 3
    clean = pii.sanitize(df)
    assert clean.columns == df.columns
    by = [r for r in rows_of(clean)]
    assert next(r for r in by if r["doc_id"] is None) == {"doc_id": None, "text": "[EMAIL]", "_terms": "keep", "_key": 5, "_sha": "s", "term": "t", "p": 1.0}
    assert next(r for r in by if r["doc_id"] == 1)["text"] is None and next(r for r in by if r["doc_id"] == 10)["text"] == " [EMAIL]"
    none = spark.createDataFrame([], schema)
    assert rows_of(pii.pii(none)) == [] and rows_of(pii.sanitize(none)) == []
