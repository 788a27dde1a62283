import math
import random

import numpy as np
import pytest

from flowloom.llm import vector_codes as v

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, rounds=4):
    """From the statement, in Python's integers."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in e], lab, e) for i, e, lab in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    if not kept:
        return [], ""
    q = len(kept[0][1]) // 4
    parts = [[r[1][p * q : (p + 1) * q] for r in kept] for p in range(4)]
    books = [own[:256] for own in parts]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min((distance(x, b), e) for e, b in enumerate(book))
    for _ in range(rounds):
        for p, own in enumerate(parts):
            code = [nearest(x, books[p])[1] for x in own]
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if (m := [x for x, k in zip(own, code, strict=True) if k == e]) else b for e, b in enumerate(books[p])]
    out = []
    for j, (i, _, lab, _) in enumerate(kept):
        found = [nearest(parts[p][j], books[p]) for p in range(4)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    import hashlib

    return sorted(out, key=repr), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def found(frame):
    codes, books = v.compress(frame)
    return sorted((tuple(r) for r in codes.collect()), key=repr), v.codebooks_sha256(books) if books else ""


def vectors(seed, n, width=8, spread=0.05):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(30)]
    rows = [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)], rng.choice([None, 0, 1, 2])) for i in rng.sample(range(-500, 10 * n), n)]
    return [(i, [float(np.float32(x)) for x in e], lab) for i, e, lab in rows]


@pytest.mark.parametrize(("seed", "n", "partitions"), [(0, 700, 3), (1, 40, 1)])
def test_against_brute_force(spark, seed, n, partitions):
    rows = vectors(seed, n)
    assert found(spark.createDataFrame(rows, VECTORS).repartition(partitions)) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(2, 300, 4)
    rows += [(None, [0.0, 0.5, -1.0, 2.0], None), (5000, None, 1), (5001, [1.0, None, 0.0, 0.0], 1), (5002, [1.0, float("nan"), 0.0, 0.0], 1), (5003, [1.0, float("-inf"), 0.0, 0.0], 1)]
    rows += rows[:3] + [(7000 + i, [0.25, 0.25, 0.25, 0.25], 1) for i in range(200)] + [(rows[0][0], [9.0, -9.0, 0.0, 1e-9], 1)]
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as code", "2 as whole", "'x' as body")
    assert found(frame.repartition(2)) == brute(rows)
    wrong = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], 1), (2, [1.0], 1), (3, [], 1)], VECTORS)
    assert [r[0] for r in found(wrong)[0]] == [1]
    assert found(spark.createDataFrame([], VECTORS)) == ([], "")
    assert found(spark.createDataFrame([(1, None, 1)], VECTORS)) == ([], "")
    with pytest.raises(ValueError, match="equal parts"):
        found(spark.createDataFrame([(1, [1.0, 2.0], 1)], VECTORS))


def test_large_components_take_exact_integers(spark):
    rows = [(i, [float(np.float32(x * 1e4)) for x in e], lab) for i, e, lab in vectors(4, 60, 4)]
    assert found(spark.createDataFrame(rows, VECTORS)) == brute(rows)


def test_trees_assign_like_all_comparisons(monkeypatch):
    rng = np.random.default_rng(5)
    for kind in ("float64", "int64"):
        points = rng.integers(-9, 9, (900, 3)).astype(kind)
        entries = rng.integers(-9, 9, (40, 3)).astype(kind)
        code, count, total = v.Tree(points).assigned(entries)
        want = ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)
        assert (code == want).all() and (count == np.bincount(want, minlength=40)).all()
        assert (total == np.array([points[want == e].sum(0) for e in range(40)])).all()


def test_subtrees_are_assigned_at_once(monkeypatch):
    monkeypatch.setattr(v, "LEAF", 16)
    rng = np.random.default_rng(6)
    centres = rng.integers(-4000, 4000, (20, 4)).astype(float)
    points = centres[rng.integers(0, 20, 5000)] + rng.integers(-3, 4, (5000, 4))
    tree, compared = v.Tree(points), []
    own = v.Tree._filtered
    monkeypatch.setattr(v.Tree, "_filtered", lambda self, nodes, *rest: compared.append(len(nodes)) or own(self, nodes, *rest))
    tree.assigned(centres)
    assert sum(compared) < len(tree.low) / 3


def test_blocks_of_any_size(spark, monkeypatch):
    rows = vectors(7, 200, 4)
    frame = spark.createDataFrame(rows, VECTORS).repartition(1)
    monkeypatch.setattr(v, "BLOCK_BYTES", 32 * 30)
    assert v.planted(v.kept_vectors(frame), 4, "float64").count() == 7
    assert found(frame) == brute(rows)


def test_query_and_sql(spark, small):
    import duckdb

    got = sorted((tuple(r) for r in v.op11_vector_codes(spark, small).collect()), key=repr)
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{small}/embeddings.parquet'")
    assert got == sorted(c.execute(v.OP11_SQL).fetchall(), key=repr)
    assert len(got) == 500
