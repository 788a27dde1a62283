import numpy as np
import pytest

from flowloom.llm import vector_search as v

ROWS = "vec_id long, embedding array<float>"


def brute(rows, k=10):
    dims = {}
    ok = []
    for i, x in rows:
        if i is None or x is None or not x or any(c is None or not np.isfinite(c) for c in x) or not any(x):
            continue
        ok.append((i, np.asarray(x, np.float32).astype(float)))
        dims[len(x)] = dims.get(len(x), 0) + 1
    dim = max(dims, key=lambda d: (dims[d], -d), default=0)
    ok = [r for r in ok if len(r[1]) == dim]
    out = {}
    for q, x in ok:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in ok if i != q)[:k]
            out[q] = near
    return out


def found(spark, rows, k=10):
    frame = spark.createDataFrame(rows, ROWS)
    out = {}
    for r in v.search(frame, frame.where("vec_id % 100 = 0"), k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert len(out[r.query_id]) == r["rank"]
    return out


@pytest.mark.parametrize("dim", [2, 13, 64])
def test_recall_against_brute_force(spark, dim, monkeypatch):
    monkeypatch.setattr(v, "VECTORS", 300)
    monkeypatch.setattr(v, "QUERIES", 5)
    monkeypatch.setattr(v, "small_batches", lambda spark: spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "170"))
    rng = np.random.Generator(np.random.PCG64(dim))
    centres = rng.standard_normal((6, dim))
    rows = [(i, (centres[i % 6] + 0.3 * rng.standard_normal(dim)).astype(np.float32).tolist()) for i in range(2000)]
    rows += [(3000 + i, rows[7][1]) for i in range(40)]
    want, got = brute(rows), found(spark, rows)
    assert want.keys() == got.keys()
    hits = [len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want]
    assert np.mean(hits) >= 9.9
    for q in want:
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]])


@pytest.mark.parametrize("dim", [5, 64, 100])
def test_bounds_from_bits_hold(dim):
    rng = np.random.Generator(np.random.PCG64(dim))
    x, q = rng.standard_normal((4000, dim)) + 0.5, rng.standard_normal((30, dim))
    coder = v.Coder(x.mean(0))
    about, least = coder.bounds(*coder.codes(x), q)
    exact = ((q[:, None] - x[None]) ** 2).sum(2)
    assert (least <= exact).mean() > 0.999
    assert np.abs(about - exact).mean() < 3.5 * dim / np.sqrt(dim)  # a one-bit code's spread


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 0.0]), (200, None), (300, [float("nan"), 1.0]), (1, [1.0, None]), (2, [float("inf"), 0.0]), (None, [1.0, 1.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (400, [1.0, 1.0]), (5, [1.0, 2.0, 3.0]), (6, [])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == {}
    assert found(spark, [(0, [1.0])]) == {}
    assert found(spark, [(0, [1.0]), (7, [1.0])]) == {0: [(0.0, 7)]}


def test_query_recall(spark, small):
    import pyarrow.parquet as pq

    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{small}/embeddings.parquet").to_pylist()]
    want = brute(rows)
    got = {}
    for r in v.op9_one_bit_search(spark, small).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len({i for _, i in want[q]} & got[q]) for q in want]) >= 9.5
