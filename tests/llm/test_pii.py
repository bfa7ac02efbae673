import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jurybox.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, rx in BASE.items():
        for m in re.finditer(rx, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                  "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def spans(df, base=True):
    picked = F.filter("spans", lambda s: s["base"]) if base else F.col("spans")
    return [(r[0], r[1]) for r in pii.find_spans(df).select("row.doc_id", pii.listing(picked)).collect()]


def check(documents, texts):
    got = dict(spans(documents(list(enumerate(texts)))))
    for i, text in enumerate(texts):
        assert got[i] == brute(text), text


CARD = "4111 1111 1111 1111"


def test_edges(documents):
    check(documents, [
        None, "", "é𝄞 a.b@c.de x", "a@b.c_d@e.f", "a@b..c @x.y a@b", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.255", "1.2.3.99999999999999999999",
        CARD, CARD + "2", "x" + CARD.replace(" ", "") + "-", "+1 (555) 010-9999", "+12", "+1 " + " " * 50, "+1234567 890 1234567 88",
        "ab" * 20000, "1" * 20000, "1-" * 9000 + "1", "a@" + "b." * 9000 + "c", ("x@y.zz " * 700),
    ])


@given(st.lists(st.text(alphabet="a@.1+4 -(é2", max_size=50), min_size=1, max_size=12))
@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_random(documents, texts):
    check(documents, texts)


@pytest.mark.parametrize("text,kinds", [
    ("my iban is DE89 3704 0044 0532 0130 00 ok", ["iban"]), ("DE88370400440532013000", []), ("the ssn 123-45-6789", ["ssn"]), ("number 123-45-6789", []),
    ("ssn 000-45-6789", []),
])
def test_added_kinds(documents, text, kinds):
    found = spans(documents([(1, text)]), base=False)[0][1]
    assert [s.split(":")[0] for s in found.split(",") if s] == kinds


def test_context_raises_score(documents):
    rows = pii.find_spans(documents([(1, "credit card " + CARD), (2, "x " + CARD)])).collect()
    assert rows[0].spans[0].score > rows[1].spans[0].score


def test_running_sum(spark):
    sizes = [0, 1, 255, 256, 257, 1000]
    for n in sizes:
        values = list(range(n))
        df = spark.range(1).select(F.lit(values).cast("array<bigint>").alias("v")).select(pii.running_sum(F.col("v")).alias("s"))
        assert df.first().s == [sum(values[:i + 1]) for i in range(n)]


def test_redact(documents):
    df = documents([(1, f"write a.b@c.de or {CARD}, 1.2.3.4@x.yz end"), (2, None), (3, "nothing"), (1, "nothing")])
    out = pii.redact(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(
        [(1, "write [EMAIL] or [CARD], [EMAIL] end"), (2, None), (3, "nothing"), (1, "nothing")], key=str)
    assert pii.redact(documents([])).count() == 0


def test_digest(documents):
    assert hashlib.sha256(b"").hexdigest() == pii.find_spans(documents([(1, "x")])).select(
        F.sha2(pii.listing(F.col("spans")).cast("binary"), 256)).first()[0]
