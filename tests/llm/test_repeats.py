import hashlib
import random

import numpy as np
import pytest

from flowloom.llm import repeats as r
from tests.llm.helpers import ODD_TEXTS, docs, documents


def brute(rows, depth=50):
    """From the statement: every window of every document against the least id that holds it."""
    least = {}
    for i, t in rows:
        raw = (t or "").encode()
        for a in range(len(raw) - depth + 1) if i is not None else ():
            w = raw[a : a + depth]
            if w not in least or i < least[w]:
                least[w] = i
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - depth + 1) if i is not None else ():
            if least[raw[a : a + depth]] < i:
                gone[a : a + depth] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(frame):
    rows = r.remove_repeats(frame).collect()
    assert all(sum(s.end - s.start for s in x.spans) == x.n_removed for x in rows)
    return sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in rows), key=repr)


def test_query(spark, small):
    got = sorted((tuple(x) for x in r.op10_remove_repeats(spark, small).collect()), key=repr)
    want = brute([(x["doc_id"], x["text"]) for x in documents(small)])
    assert got == want
    assert any(x[2] for x in want)


def repeated(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 9)))
    passages = ["".join(word() for _ in range(rng.randrange(6, 40))) for _ in range(8)] + ["ab" * 60, "x" * 120]
    texts = []
    for _ in range(60):
        t = ""
        for _ in range(rng.randrange(0, 6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            t += p[a : a + rng.randrange(30, 130)] if rng.random() < 0.6 else "".join(word() for _ in range(rng.randrange(1, 30)))
        texts.append(t)
    return texts + rng.choices(texts, k=10)


@pytest.mark.parametrize(("seed", "partitions"), [(0, 1), (1, 3), (2, 5)])
def test_against_brute_force(spark, seed, partitions):
    texts = repeated(seed)
    ids = random.Random(seed).sample(range(-100, 1000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)) == brute(rows)


def test_long_texts_are_taken_in_segments(spark, monkeypatch):
    monkeypatch.setattr(r, "SEGMENT", 1 << 10)
    from flowloom.llm import kernels

    monkeypatch.setattr(kernels, "SLAB", 1 << 9)
    texts = ["".join(repeated(5)), "".join(repeated(5)[20:50]), "q" * 3000, "q" * 49, "q" * 50]
    got = {}
    import pyarrow as pa

    data, offsets = r.k.texts(pa.array(texts))
    for i, slab, at, place in r._segments(data, offsets):
        runs = r.Runs(slab, at)
        for o, s, c in zip(runs.owner, runs.start, runs.count, strict=True):
            got.setdefault(i + int(o), []).extend(range(place + int(s - at[o]), place + int(s - at[o] + c)))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == list(range(max(0, len(t.encode()) - 49)))


@pytest.mark.parametrize("size", [1, 700, 1 << 20])
def test_units_of_any_size(spark, size, monkeypatch):
    monkeypatch.setattr(r, "UNIT", size)
    rows = list(enumerate([*repeated(7), "".join(repeated(8)) * 20]))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert found(frame) == brute(rows)
    sizes = [x.n for x in r.units(frame).groupBy("part").agg({"text": "count"}).toDF("part", "n").collect()]
    assert sum(sizes) == len(rows) and (len(sizes) > 40) == (size == 1)


def test_odd_rows(spark):
    long = "a passage of more than fifty bytes, with é and ß, that comes again and again."
    rows = [*enumerate(ODD_TEXTS), (None, long), (None, long), (50, long), (50, long), (51, long + "!"), (60, None), (61, long[:50]), (62, long[:49]), (3, "same id"), (3, "other text of the id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as n_bytes")
    assert found(frame.repartition(2)) == brute(rows)


def test_empty(spark):
    assert found(docs(spark, [])) == []
    assert found(docs(spark, [None, ""])) == brute([(0, None), (1, "")])


def test_texts_made_for_polynomial_hashes(spark):
    word = "".join("ab"[i.bit_count() & 1] for i in range(700))
    other = word.translate(str.maketrans("ab", "ba"))
    framed = lambda w: w.replace("a", "xxxxxxxxaxxxxxxxx").replace("b", "xxxxxxxxbxxxxxxxx")
    rows = [(3, word[:64] * 2), (1, other[:64] * 2), (2, framed(word[:64])), (4, framed(other[:64])), (5, framed(word)), (6, framed(other)), (7, word), (8, other)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)
