import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d))))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m[0])]


def base(text):
    return [s[:3] for s in pii.find(text) if s.kind in pii.BASE]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="01234567899..--++@@ ab()é%A", max_size=60))
def test_base_spans_match_the_patterns(text):
    assert base(text) == brute(text)


def test_planted():
    text = "é Mail a.b+c@x-1.co.uk, 10.0.0.255 or 300.1.1.1; 4111 1111-1111 1111, +1 (017) 555-7713."
    assert base(text) == brute(text) and {k for k, *_ in base(text)} == set(pii.BASE)
    iban = "Konto GB82 WEST 1234 5698 7654 32 ok, GB82 WEST 1234 5698 7654 33"
    found = [s for s in pii.find(iban) if s.kind == "iban"]
    assert [iban[s.start : s.end] for s in found] == ["GB82 WEST 1234 5698 7654 32"] and found[0].score > 0.8
    assert [s.kind for s in pii.find("SSN 123-45-6789")] == ["ssn"] and not pii.find("no 123-45-6789")
    assert pii.redact("a x@y.z b", pii.find("a x@y.z b")) == "a <email> b"
    assert pii.find(None) == pii.find("") == []


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" + "(" * 300_000, "@" * 100_000):
        pii.find(text)


def test_long_digit_runs_are_parsed():
    zeros = "0" * 5000
    assert base(f"{zeros}1.2.3.4 {zeros}.{zeros}.{zeros}.0 {zeros}256.1.1.1") == [("ip", 0, 5007), ("ip", 5008, 20012)]
    assert base("9" * 5000 + ".1.1.1") == []


def test_query_columns(spark, tmp_path):
    rows = [(1, "x@y.zz 1.2.3.4", "en"), (2, None, None), (2, "", "de"), (None, "+1 (017) 555-7713", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, pii_spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.spans): r for r in pii.op8_pii(spark, str(tmp_path)).collect()}
    assert len(got) == 3
    r = got[1, "email:0:6,ip:7:14"]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 0)
    assert r.base_sha256 == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest()
    assert got[2, ""].base_sha256 == hashlib.sha256(b"").hexdigest()
    out = pii.detect(spark.read.parquet(f"{tmp_path}/documents.parquet"), redacted=True).where("doc_id = 1").first()
    assert out.text == "<email> <ip>"
