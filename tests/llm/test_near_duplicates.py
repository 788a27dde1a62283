import random
import re

import numpy as np
import pytest

from flowloom.llm import near_duplicates as d
from tests.llm.helpers import ODD_TEXTS, docs, documents

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    """Components by comparing all pairs that share a shingle."""
    sets = [(i, shingles(t)) for i, t in rows]
    post, root = {}, list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, (_, s) in enumerate(sets):
        inner = {}
        for g in s:
            for y in post.get(g, ()):
                inner[y] = inner.get(y, 0) + 1
            post.setdefault(g, []).append(x)
        for y, n in inner.items():
            if 100 * n >= 80 * (len(s) + len(sets[y][1]) - n):
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        r = find(x)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return sorted(((i, len(s), least[find(x)]) for x, (i, s) in enumerate(sets)), key=repr)


def found(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in d.near_duplicates(frame).collect()), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in documents(f"/root/testdata/{sf}")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in d.op1_ngram_jaccard_join(spark, f"/root/testdata/{sf}").collect()), key=repr)
    want = brute(rows)
    assert got == want
    assert len({c for _, _, c in want}) < len(want)


def near_copies(seed):
    """Chains and stars around the threshold, with passages that all texts share."""
    rng = random.Random(seed)
    shared = [" ".join(f"s{k}x{i}" for i in range(30)) for k in range(3)]
    texts = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(90)}" for _ in range(rng.randrange(6, 90))]
        for _ in range(rng.randrange(1, 25)):
            own = list(base)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            base = own if rng.random() < 0.3 else base
            text = " ".join(own)
            texts.append(f"{rng.choice(shared)} {text}" if rng.random() < 0.5 else text.upper())
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_near_copies(spark, seed, monkeypatch):
    monkeypatch.setattr(d, "PARTNERS", 5)
    texts = near_copies(seed)
    ids = random.Random(seed).sample(range(1000), len(texts))
    frame = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    assert found(frame.repartition(3)) == brute(list(zip(ids, texts, strict=True)))


@pytest.mark.parametrize("pivots", [0, 1, 2])
def test_fewer_pivots_and_a_full_filter(spark, pivots, monkeypatch):
    monkeypatch.setattr(d, "PIVOTS", pivots)
    monkeypatch.setattr(d, "FILTER", 256)  # nearly every text passes
    monkeypatch.setattr(d, "SHARD", 3)
    texts = near_copies(9)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(frame) == brute(list(enumerate(texts)))


@pytest.mark.parametrize("bits", [2, 6])
def test_tokens_that_look_alike(spark, bits, monkeypatch):
    monkeypatch.setattr(d, "LOOK", bits)
    texts = near_copies(11)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(frame) == brute(list(enumerate(texts)))


def test_rank_never_saturates():
    grams = np.arange(4, dtype=np.uint64)
    sketch = np.zeros(d.SKETCH, np.uint32)
    sketch[:4] = [2**32 - 1, 2**31, 2**22, 0]
    order, _, _ = d.prefix(grams, sketch, 0.0)
    codes = (order >> np.uint64(44)).tolist()
    assert codes == sorted(codes) and len(set(codes)) == 4 and d.coarse(order).tolist() == sorted(d.coarse(order).tolist())


def test_one_of_each_group_with_odd_columns(spark):
    rows = [(1, "a b c d e f", 1, "x"), (2, "A b c d e f", 2, "y"), (3, "q", 3, "z"), (3, "q", 4, "w"), (None, None, 5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __id int, `a.b` string").selectExpr("*", "1 as __key", "2 as __state", "3 as component")
    out = d.without_near_duplicates(frame)
    assert out.columns == frame.columns
    assert sorted((r["doc_id"] or -1) for r in out.collect()) == [-1, 1, 3]


def test_odd_rows(spark):
    texts = [*ODD_TEXTS, "a b c", "A  b\tc", "a b c d e", "a b c d", "a b c d e f", "a b c d e f"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b c"), (None, "only null here"), (3, "same id, other text"), (3, "same id, other text")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as class")
    assert found(frame) == brute(rows)


def test_empty(spark):
    assert found(docs(spark, [])) == []
    assert found(docs(spark, [None, ""])) == [(0, 0, 0), (1, 0, 1)]


def test_mixed_prefixes_share_enough_tokens():
    rng = np.random.Generator(np.random.PCG64(3))
    for _ in range(300):
        n = int(rng.integers(1, 60))
        pool = rng.integers(0, 2**63, 200, dtype=np.uint64)
        a = np.unique(rng.choice(pool, n))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.92], rng.choice(pool, int(rng.integers(0, 4)))]))
        inner = len(np.intersect1d(a, b))
        if not len(b) or 100 * inner < 80 * (len(a) + len(b) - inner):
            continue
        sketch = rng.integers(0, 2000, d.SKETCH).astype(np.uint32)
        (x, i, _), (y, j, _) = d.prefix(a, sketch, 5.0), d.prefix(b, sketch, 900.0)
        assert len(np.intersect1d(x, y)) >= min(i, j)


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def test_words_made_for_polynomial_hashes_are_told_apart(spark):
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    short, mirrored = thue_morse(256), thue_morse(256).translate(str.maketrans("ab", "ba"))
    framed = lambda w: w.replace("a", "xxxxxxxxaxxxxxxxx").replace("b", "xxxxxxxxbxxxxxxxx")
    texts = [word, other, f"{word} p q r s", f"{other} p q r s", short, mirrored, framed(word), framed(other), framed(short), framed(mirrored), word]
    rows = list(enumerate(texts))
    assert found(docs(spark, texts)) == brute(rows)
    assert {i: c for i, _, c in brute(rows)} == {**{i: i for i in range(10)}, 10: 0}


def test_ranges_are_hashed_by_their_bytes_alone():
    from flowloom.llm import kernels as k

    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 5000, dtype=np.uint8)
    start = rng.integers(0, 4000, 3000)
    end = start + rng.integers(0, 40, 3000)
    end[:20] += 600
    got = k.range_hash(data, start, end).tolist()
    names = {}
    for a, b, h in zip(start.tolist(), end.tolist(), got, strict=True):
        assert names.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(names.values())) == len(names)
    for size in (8, 9, 16, 50):
        at, names = np.arange(len(data) - size + 1), {}
        for a, h in zip(at.tolist(), k.window_hash(data, at, size).tolist(), strict=True):
            assert names.setdefault(data[a : a + size].tobytes(), h) == h
        assert len(set(names.values())) == len(names)


def test_sets_that_share_a_number_get_others():
    a, b = np.array([1, 2, 3], np.uint64), np.array([4, 5], np.uint64)
    clash = {d.fingerprint(a): d.second(b)}
    assert d.fingerprint(a, clash) not in (d.fingerprint(a), 0)
    assert d.fingerprint(b, clash) == d.fingerprint(b)
    assert d.fingerprint(a, {d.fingerprint(a): d.second(a)}) == d.fingerprint(a)
