"""Repaired conversations against shortest paths by brute force."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tidemark.llm import auction, conversation_repair, queries

RULES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def cheapest(rows):
    """By Dijkstra over (cost, audit): rows are (role, must go, truncated). The cost, the audit and the repaired roles and texts."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, q, out = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit, out
        if (i, q) in done:
            continue
        done.add((i, q))
        fit = "assistant" if q == 2 else "user"
        heapq.heappush(heap, (cost + 5, audit + "I", i, RULES[q][fit[0]], (*out, (fit, ""))))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q, out))
            if not gone:
                heapq.heappush(heap, (cost + 1 + 5 * cut, audit + "R", i + 1, RULES[q][fit[0]], (*out, (fit, text))))
                if role[:1] in RULES[q]:
                    heapq.heappush(heap, (cost + 5 * cut, audit + "K", i + 1, RULES[q][role[:1]], (*out, (role, text))))
    raise AssertionError


def brute(rows, damage=True):
    """rows: (conv_id, turn, role, text) -> {conv_id: digest row}"""
    out = {}
    for conv in {r[0] for r in rows}:
        left = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
            if k == 0:
                continue
            if k == 1:
                text = ""
            if k == 2:
                text = re.sub("[.!?]", "", text)
            if k == 4:
                role = "user"
            left += [(turn, role, text)] * (2 if k == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked = set(), []
        n = dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in left:
            words = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for t, *_ in left if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(left, left[1:], strict=False))
        cost, audit, repaired = cheapest(marked)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest)
    return out


def talk(rng, conv, n):
    roles = ["system", "user", "assistant", "tool", "", "usher", None]
    texts = ["Yes.", "No", " ", "Wherefore? ", "ok!\n", None, "é.", "a b"]
    out = []
    for i in range(n):
        role = ["user", "assistant"][i % 2] if rng.random() < 0.7 else rng.choice(roles)
        turn = None if rng.random() < 0.03 else i + rng.choice([0, 0, 0, 1])
        out.append((conv, turn, role, rng.choice(texts) if rng.random() < 0.5 else f"Words of {conv} in {i}."))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [r for c in range(300) for r in talk(rng, c, rng.randint(1, 9))]
    out += talk(rng, 1000, 120) + talk(rng, 1001, 70) + talk(rng, None, 25)
    out += [(2000, 1, "user", "Copy.")] * 50 + [(2000, 1, "user", "Cut")] * 30 + [(2001, None, None, None)] * 3 + out[:40]
    rng.shuffle(out)
    return out


SCHEMA = "conv_id long, turn long, role string, text string, audit string, part int"
FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize(("whole", "size"), [(128, 64), (6, 4), (1, 1)])
@pytest.mark.parametrize("damage", [True, False])
def test_repair(spark, rows, whole, size, damage):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = [(r.conv_id, tuple(r[f] for f in FIELDS)) for r in conversation_repair.repair(df, damage, whole, size).collect()]
    want = brute(rows, damage)
    assert len(got) == len(want)
    assert dict(got) == want


def test_repair_of_an_empty_table(spark):
    assert conversation_repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    table = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in queries.op11_conversation_repair(spark, folder).collect()}
    assert got == brute(table)


def test_prices_are_least_costs_and_all_ties_are_seen():
    rng = random.Random(2)
    for _ in range(400):
        shape = "".join(rng.choice("suaosuaSUAO"[: rng.choice([3, 7, 11])]) for _ in range(rng.randint(0, 9)))
        rows = [({"s": "system", "u": "user", "a": "assistant", "o": "tool"}[c.lower()], "x", False, c.isupper()) for c in shape]
        cost, audit, _ = cheapest(rows)
        found, letters, state = auction.trace(shape, auction.START, auction.AT_END)
        assert (found, letters + "I" * (auction.AT_END[state] // 5)) == (cost, audit), shape
        k = rng.randint(0, len(shape))
        a, b = auction.between(shape[:k]), auction.between(shape[k:])
        whole = auction.between(shape)
        for q in range(4):
            for to in range(4):
                # what is put in where the parts meet belongs to the second one
                assert whole[4 * q + to] == min(auction.INF, *[a[4 * q + m] + b[4 * m + to] for m in range(4)])
