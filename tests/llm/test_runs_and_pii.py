"""Periodic runs and personal data against brute force, over awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import periodic_runs, pii, queries

SCHEMA = "doc_id long, text string, spans string, runs int, lang string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, "en") for i, t in rows], SCHEMA).repartition(3)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_runs(w):
    """All periods, all stretches; the period must be the smallest of the stretch."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if n >= max(6, 4 * q) and not any(all(w[s + k] == w[s + k + r] for k in range(n - r)) for r in range(1, q)):
                out.append((s, n, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = words(text)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *longest, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic(rng):
    k = rng.choice([1, 2, 3, 5])
    w = [str(rng.randrange(k)) for _ in range(rng.randint(0, 60))]
    if rng.random() < 0.6:
        p = rng.randint(1, 8)
        b = [str(rng.randrange(k)) for _ in range(p)]
        at = rng.randint(0, len(w))
        w[at:at] = [b[i % p] for i in range(rng.randint(4 * p, 6 * p + 3))]
    return rng.choice([" ", "\n", "\t  "]).join(w)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    rows = [(i, periodic(rng)) for i in range(700)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a " * 3000), (1004, "a b c " * 900 + "x"), (None, "z " * 9), (5, "one two three four five six"), (5, rows[5][1]), (5, rows[5][1])]
    return rows


def columns(found):
    return [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, hashlib.sha256(r.runs).hexdigest(), hashlib.sha256(r.collapsed).hexdigest()) for r in found.collect()]


def test_runs(spark, texts):
    got = columns(periodic_runs.collapse(make(spark, texts), damage=True))
    want = [brute_row(*r) for r in texts]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[1] for w in want) > 300
    assert columns(periodic_runs.collapse(make(spark, []))) == []


def test_runs_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, folder).collect()]

    def row(i, t):  # only stretches whose first five words occur twice can be runs; the plain search takes too long for the others
        return brute_row(i, t) if len(words(t)) < 700 else None

    want = {i: row(i, t) for i, t in rows}
    assert len(got) == len(rows)
    assert all(want[g[0]] in (g, None) for g in got)
    assert sum(g[1] for g in got) > 20


def test_runs_of_long_texts():
    rng = np.random.default_rng(1)
    for p in (1, 2, 700):
        w = np.concatenate([rng.integers(10, 1 << 20, 500), np.arange(60_000) % p, rng.integers(10, 1 << 20, 500)])
        (part,) = periodic_runs.stretches([w])
        assert periodic_runs.runs_of([part[2]]) == [[(500 - part[1], 60_000, p)]]


# Patterns as the contract has them, over plain text with the re module.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def junk(rng):
    bits = ["a@b.c_d@e.f", "x@@y.z", "é@b.cd", "1.2.3.4", "256.1.1.1", "0001.02.3.255", "1.2.3.4.5.6.7.8", "4111 1111-1111 1111", "4111111111111112", "4111111111111111", "5500-0000-0000-0004", "+1 (459) 555-9246", "+12", "+1-", "+49 30 1234567 8", "++1234567890", "9" * 25, ".", "@", "-", " ", "\n", "x", "é", "𝄞", "7", "00", "+", "(", "card", "b.c", "a@b.", "%", "a@b.c.d.e-f"]
    return "".join(rng.choice(bits) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 25)))


def test_base_spans(spark):
    rng = random.Random(3)
    rows = [(i, junk(rng)) for i in range(3000)] + [(9000, None), (9001, ""), (None, "a@b.c"), (7, "ip 1.2.3.4"), (9002, "a" * 8_000), (9003, "1 " * 5_000), (9004, "a@b.c " * 5000), (9005, "a@b" + ".c" * 9_000), (9006, "1.1.1.1." * 9000)]
    found = [(r.doc_id, [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in pii.BASE]) for r in pii.find(make(spark, rows)).collect()]
    want = [(i, plain_spans(t)) for i, t in rows]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert {x.split(":")[0] for _, w in want for x in w} == set(PLAIN)
    assert pii.find(make(spark, [])).count() == 0


def test_added_spans_and_scores(spark):
    rows = [
        (1, "IBAN: DE89 3704 0044 0532 0130 00, or GB82WEST12345698765432."),
        (2, "DE89 3704 0044 0532 0130 01"),  # fails the remainder
        (3, "my ssn is 078-05-1120"),
        (4, "part 078-05-1120"),  # no word nearby
        (5, "ssn 000-05-1120"),
        (6, "Call (555) 123-4567 now, order no. 555-123-4567"),
        (7, "amex 378282246310005"),
        (8, "378282246310005"),
        (9, "version 1.2.3.4 on host 5.6.7.8"),
        (10, "phone +1 (459) 555-9246"),
    ]
    got = {r.doc_id: [(s.kind, s.value, s.score) for s in r.spans] for r in pii.find(make(spark, rows)).collect()}
    assert got[1] == [("iban", "DE89 3704 0044 0532 0130 00", 1.0), ("iban", "GB82WEST12345698765432", 0.8)]
    assert [got[k] for k in (2, 4, 5, 8)] == [[]] * 4
    assert got[3] == [("social_security", "078-05-1120", 0.75)]
    assert got[6] == [("local_phone", "(555) 123-4567", 0.75)]
    assert got[7] == [("short_card", "378282246310005", 0.75)]
    assert [s[2] for s in got[9]] == [0.65, 0.95]  # "host" stands near the first, too
    assert got[10] == [("phone", "+1 (459) 555-9246", 1.0)]


def test_pii_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: plain_spans(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op12_pii(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        assert hashlib.sha256(",".join(rows[r.doc_id]).encode()).hexdigest() == r.base_sha256
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in rows[r.doc_id]) for k in PLAIN]
        assert set(rows[r.doc_id]) <= set(r.spans.split(","))
    assert all(sum(getattr(r, f"n_{k}") for r in got) for k in PLAIN)


def test_pii_runs_no_python(spark):
    plan = queries.op12_pii(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
