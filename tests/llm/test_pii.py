"""Operator 3 against the contract's patterns taken literally."""

import hashlib
import random
import re

from metricslake.llm import pii
from metricslake.llm.registry import op3_pii

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def own_base(text):
    return [s for s in pii.find(text) if s[0] in pii.BASE_KINDS]


def test_odd_texts():
    for text in [
        None, "", "@", "+", "a@b@c.com", "a@b.c@d.e", "x@y", "x@y.", "x@y..z", "1.2.3.4.5.6.7.8", "1.2.3.256 1.2.3", "+12", "+123",
        "+1 (988) 555-2485 ", "+1 988 555 2485-", "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111  1111 1111 1111", "é@b.co a.b@é.de",
        "0001.002.03.4", "a" * 3000 + "@b.c", "1" * 4000, "1 " * 3000, "+1" + "2" * 20 + "+1 234 567 890", "١٢٣ +١٢", "9.9.9.9@x.y", "@@a@b.c.@d",
    ]:
        assert own_base(text) == base(text), text


def test_random_texts():
    rng = random.Random(3)
    for _ in range(20000):
        letters = rng.choice(["a1@.", "0123456789 -", "+1 ().-9", "12.5 ", "a.@-%+1 é"])
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(45)))
        assert own_base(text) == base(text), text


def test_method_kinds():
    found = lambda t: [s for s in pii.find(t) if s[0] not in pii.BASE_KINDS]
    assert found("IBAN: DE89 3704 0044 0532 0130 00 ok") == [("iban", 6, 33)]
    assert found("IBAN: DE88 3704 0044 0532 0130 00 ok") == []
    assert found("ssn 123-45-6789.") == [("ssn", 4, 15)]
    assert found("ssn 000-45-6789, 123-45-6789") == []
    assert found("see https://bob:pw@host.example/x and https://host.example/") == [("url", 4, 31)] or found(
        "see https://bob:pw@host.example/x"
    )[0][0] == "url"
    assert found("visa https and an iban of none") == []


def test_redact():
    assert pii.redact("mail a.b@c.de or 10.0.0.1!") == "mail <EMAIL> or <IP>!"
    assert pii.redact(None) is None and pii.redact("") == ""


def test_query(spark):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op3_pii(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = base(docs[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in PATTERNS]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_frames(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "a@b.c", 2), (1, "a@b.c", 2)], "doc_id long, text string, spans int")
    assert sorted(r.spans for r in pii.digests(pii.detect(df)).collect()) == ["", "email:0:5", "email:0:5"]
    assert pii.detect(df.limit(0)).collect() == []
    assert pii.redacted(df).columns == df.columns
    assert sorted(r.text or "" for r in pii.redacted(df).collect()) == ["", "<EMAIL>", "<EMAIL>"]
