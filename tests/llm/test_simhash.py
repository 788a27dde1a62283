import random
import re

import numpy as np
import pytest
import xxhash

from flowloom.llm import simhash as h
from tests.llm.helpers import ODD_TEXTS, docs, documents

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def mark(text):
    """From the statement, bit by bit."""
    w = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def brute(rows):
    """Components by comparing each pair of distinct fingerprints."""
    return joined([(i, mark(t)) for i, t in rows])


def joined(rows):
    marks = np.array(sorted({m for _, m in rows}), np.uint64)
    root = list(range(len(marks)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, m in enumerate(marks):
        for j in np.flatnonzero(np.bitwise_count(marks[:i] ^ m) <= 4).tolist():
            root[find(j)] = find(i)
    place, least = {int(m): i for i, m in enumerate(marks)}, {}
    for i, m in rows:
        r = find(place[m])
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return sorted(((i, f"{m:016x}", least[find(place[m])]) for i, m in rows), key=repr)


def found(frame):
    return sorted((tuple(r) for r in h.near_duplicates(frame).collect()), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    got = sorted((tuple(r) for r in h.op12_simhash(spark, f"/root/testdata/{sf}").collect()), key=repr)
    want = brute([(r["doc_id"], r["text"]) for r in documents(f"/root/testdata/{sf}")])
    assert got == want and len({c for _, _, c in want}) < len(want)


def test_odd_rows(spark):
    texts = [*ODD_TEXTS, "a b c", "A  b\tc", "a b c d", "a b c d e", "x y", None, "", "\x0b\x0c", "K\u212a k"]
    rows = [*enumerate(texts), (None, "lone row without an id"), (None, ""), (3, "word"), (3, "other text of this id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as mark", "2 as key", "'x' as component_id")
    assert found(frame.repartition(3)) == brute(rows)
    assert found(docs(spark, [])) == []
    assert found(docs(spark, [None])) == [(0, "0" * 16, 0)]


def test_a_very_long_text_is_taken_in_slices(spark, monkeypatch):
    rng = random.Random(2)
    text = " ".join(rng.choice(["ab", "Cd", "e", "fgh"]) for _ in range(9000))
    monkeypatch.setattr(h, "SLICE", 1000)
    assert h.fingerprint(text.encode()) == mark(text)


def ball(rng, n, centres, most):
    out = []
    for _ in range(n):
        m = rng.choice(centres)
        for b in rng.sample(range(64), rng.randrange(most + 1)):
            m ^= 1 << b
        out.append(m)
    return out


@pytest.mark.parametrize(("seed", "block"), [(0, 1024), (1, 8), (2, 40)])
def test_links_against_all_pairs(spark, seed, block, monkeypatch):
    monkeypatch.setattr(h, "BLOCK", block)
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1]
    marks = list(dict.fromkeys([*ball(rng, 500, centres, 6), *ball(rng, 300, centres[-2:], 3), *(rng.getrandbits(64) for _ in range(200))]))
    signed = lambda m: m - 2**64 if m >> 63 else m
    frame = spark.createDataFrame([(signed(m),) for m in marks], "mark long")
    edges = [(r.a % 2**64, r.b % 2**64) for r in h.linked(frame.repartition(2)).collect()]
    root = {m: m for m in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = joined([(m, m) for m in marks])
    assert sorted(((m, f"{m:016x}", find(m)) for m in marks), key=repr) == want
    assert len({c for _, _, c in want}) > 100


def test_chains_lose_no_link():
    rng = np.random.default_rng(1)
    for n in range(7):
        for _ in range(300):
            m = int(rng.integers(0, 2**63))
            other = m ^ sum(1 << int(b) for b in rng.choice(64, n, False))
            pair = np.array([[m, other]], np.uint64)
            assert any(h.near(pair, s)[0, 0, 1] for s in range(h.RING)) == (n <= 4)


def test_a_group_gives_a_forest():
    rng = random.Random(3)
    marks = np.array(sorted(set(ball(rng, 400, [12345], 2))), np.uint64)
    own = marks[np.bitwise_count(marks & h._MASK[0]) == int(marks[0] & h._MASK[0]).bit_count()]
    edges = list(h._edges(np.array([0, len(own)]), np.zeros(len(own), np.int64), own))
    assert sum(len(a) for a, _ in edges) < len(own)
