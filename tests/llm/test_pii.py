"""Personal data spans against a plain scan with Python's regular expressions."""

import hashlib
import random
import re
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from passagemill.llm import pii

from .conftest import SCHEMA, filler

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?a:\b)[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?a:\b)",
    "ssn": r"(?a:\b)[0-9]{3}-[0-9]{2}-[0-9]{4}(?a:\b)",
    "birth": r"(?a:\b)(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?a:\b)",
}
CONTEXT = {k.name: k.context for k in pii.KINDS}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def good(kind, hit, context):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "iban":
        bare = hit.replace(" ", "")
        return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    if kind == "ssn":
        return context and not re.search("^(?:000|666|9)|-00-|-0000$", hit)
    if kind == "birth":
        try:
            return context and bool(date.fromisoformat(hit))
        except ValueError:
            return False
    return True


def scan(text):
    text, spans = text or "", []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        hits = list(re.finditer(pattern, text))
        for i, m in enumerate(hits):
            low = hits[i - 1].end() if i else 0
            high = hits[i + 1].start() if i + 1 < len(hits) else len(text)
            sides = text[max(low, m.start() - pii.BEFORE) : m.start()], text[m.end() : min(high, m.end() + pii.AFTER)]
            lowered = [re.sub("[A-Z]", lambda c: c.group().lower(), s) for s in sides]
            context = any(re.search(rf"(?:^|[^a-z])(?:{'|'.join(CONTEXT[kind])})(?:[^a-z]|$)", s) for s in lowered)
            if good(kind, m.group(), context):
                spans.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    spans.sort()
    base = ",".join(s for _, o, s in spans if o < 4)
    counts = [sum(o == k for _, o, _ in spans) for k in range(4)]
    return (*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(s for *_, s in spans))


def check(df):
    rows = pii.counted(pii.found(df)).collect()
    got = sorted(((r["doc"]["doc_id"], r["doc"]["text"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], r["spans"]) for r in rows), key=repr)
    assert got == sorted(((r["doc_id"], r["text"], *scan(r["text"])) for r in df.collect()), key=repr)
    return got


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1) + filler("x") for i, t in enumerate(texts)], SCHEMA)


def test_given_documents(spark, data):
    assert any(r[2] or r[3] for r in check(spark.read.parquet(f"{data}/documents.parquet")))


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert pii.counted(pii.found(no_docs)).collect() == []


def test_hand_written(spark):
    texts = [
        "write to a.b+c@mail.example.org. or x@y, é@z.de, 🙂 me@host.co.uk",
        "a@b.c_d@e.f@g.h a@b.c..x@y.z",
        "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3 9999999999999999999999.1.1.1",
        "4111 1111 1111 1111, 4111-1111-1111-1112 5500000000000004x 4111  1111 1111 1111 0000000000000000000000000",
        "call +1 (132) 555-1352 or +49 30 1234567--- +12 +1 555 +1((((",
        "IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, not DE89370400440532013001; NO93 8601 1117 947 is one",
        "SSN: 123-45-6789, 000-12-3456 ssn, and 123-45-6789 " + "far " * 30 + "321-54-9876",
        "born 1990-02-30, born on 1990-02-28 or 2001-12-31 ref. 1999-01-01" + " x" * 40 + " 1999-01-01",
        "", None, "\n\n", "+" * 50 + "@" * 50 + "." * 50,
    ]
    got = {r[1]: r for r in check(table(spark, texts))}
    assert got[texts[0]][2] == 2
    assert got[texts[5]][-1].count("iban") == 3
    assert got[texts[6]][-1].count("ssn") == 2
    assert got[texts[7]][-1].count("birth") == 1


def test_random_mixtures(spark):
    draw = random.Random(11)
    pieces = ["a", "B", "7", "12", "4111111111111111", ".", ".", "@", "@", "+", "-", " ", " ", "(", ")", "_", "%", "255", "é", "🙂", "\n", "ssn", "born", "DE89 3704 0044 0532 0130 00", "1999-01-02", "123-45-6789"]
    check(table(spark, ["".join(draw.choice(pieces) for _ in range(draw.randrange(1, 60))) for _ in range(4000)]))


def test_blocks_of_matches(spark):
    """More matches than a block of running sums holds."""
    check(table(spark, ["me@host.org, " * n + "1.2.3.4 " * (n // 2) for n in (1, pii.BLOCK - 1, pii.BLOCK, pii.BLOCK + 1, 3 * pii.BLOCK + 7)]))


@pytest.mark.parametrize("unit", ["a", "7", "7 ", "a@b.c ", "a@", "+1", "+1(", "1.1.1 ", "AB12", ".", "a.", "12-"])
def test_very_long_texts_are_read_once(spark, unit):
    df = table(spark, [unit * (1_000_000 // len(unit))])
    begun = time.time()
    pii.counted(pii.found(df)).agg(F.max("spans")).collect()
    assert time.time() - begun < 20
