import zlib

import numpy as np

from flowloom.llm import quality as q
from tests.llm.helpers import ODD_TEXTS, docs


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_held_out_accuracy(spark):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in q.op6_quality_classifier(spark, sf).collect()}
    rows = [r for r in pq.read_table(f"{sf}/labels.parquet").to_pylist() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(got) == 1000 and all(got[r["doc_id"]].held_out for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    label = np.array([r["quality"] for r in rows])
    score = np.array([got[r["doc_id"]].score for r in rows])
    assert auc(score, label) > 0.97
    assert np.mean((score >= 0.5) == label) > 0.95


def test_sample_reaches_its_bounds_and_no_further(spark, monkeypatch):
    import pyarrow.parquet as pq

    assert (q.POSITIVES, q.UNLABELLED) == (6000, 12000)
    sf = "/root/testdata/sf0.1"
    known = {r["doc_id"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist() if r["quality"] == 1}
    free = [r for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id"])["doc_id"].to_pylist() if zlib.crc32(str(r).encode()) % 3 != 1]
    assert len(free) > 5000 and len(known.intersection(free)) > 2000
    seen = []
    monkeypatch.setattr(q, "fit", lambda dense, words, positive, prior: seen.append((positive.sum(), (~positive).sum(), len(dense), words.n)))
    for most in ((100, 300), (90, 310), (5, 7)):
        monkeypatch.setattr(q, "POSITIVES", most[0])
        monkeypatch.setattr(q, "UNLABELLED", most[1])
        q.train(spark.read.parquet(f"{sf}/documents.parquet"), q.quality_labels(spark, sf))
    for most, (p, u, n, rows) in zip(((100, 300), (90, 310), (5, 7)), seen, strict=True):
        assert 0 < p <= most[0] and 0 < u <= most[1] and n == rows == p + u


def test_sparse_rows(monkeypatch):
    rng = np.random.default_rng(1)
    full = rng.random((50, q.WORDS)).astype(np.float32) * (rng.random((50, q.WORDS)) < 0.01)
    full[[0, 20, 49]] = 0
    monkeypatch.setattr(q.Rows, "SLAB", 100)
    rows = q.Rows(np.nonzero(full)[1].astype(np.uint16), full[full != 0], (full != 0).sum(1))
    w, g = rng.random(q.WORDS), rng.random(50)
    assert np.allclose(rows.times(w), full @ w) and np.allclose(rows.back(g), full.T @ g)


def test_prior_is_estimated_without_negatives(spark, small):
    labels = q.quality_labels(spark, small).where("label = 1")
    frame = spark.read.parquet(f"{small}/documents.parquet")
    model = q.train(frame, labels)
    assert 0.4 < model.prior <= 0.99


def test_odd_cases(spark):
    frame = docs(spark, ODD_TEXTS).withColumnRenamed("lang", "score")
    labels = spark.createDataFrame([(i, 1) for i in range(5)] + [(None, 1), (2, None), (99, 0)], "doc_id long, label int")
    rows = q.score(frame, q.train(frame, labels)).collect()
    assert len(rows) == len(ODD_TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in q.score(frame, None).collect()} == {0.5}
    none = labels.where("false")
    assert q.train(frame, none) is None
    assert q.score(docs(spark, []), q.train(docs(spark, []), labels)).count() == 0


def test_score_is_of_the_text_alone():
    from flowloom.llm import kernels as k
    import pyarrow as pa

    texts = ["a b c", "", "X! Y! Z!", "é è", None, "a b c"]
    whole = q.features(*k.texts(pa.array(texts)))[0]
    for i, t in enumerate(texts):
        assert np.allclose(q.features(*k.texts(pa.array([t], pa.string())))[0][0], whole[i])


def plain_risk(model, texts, positive, share):
    """The risk and its two parts, text by text from the definition."""
    from flowloom.llm import kernels as k
    import pyarrow as pa

    g = np.array([model.margin(*q.features(*k.texts(pa.array([t]))))[0] for t in texts])
    pos, neg = np.log(1 + np.exp(-g)), np.log(1 + np.exp(g))
    rest = neg.mean() - share * neg[positive].mean()
    return share * pos[positive].mean() + max(0.0, rest), rest


def random_model(rng, texts, size):
    from flowloom.llm import kernels as k
    import pyarrow as pa

    dense, _, _ = q.features(*k.texts(pa.array(texts)))
    edges = np.quantile(dense, np.linspace(0, 1, q.BINS + 2)[1:-1], axis=0).T
    n = dense.shape[1]
    return q.Model(dense.mean(0), dense.std(0) + 1e-9, edges, size * rng.normal(size=n * (1 + q.BINS)), size * rng.normal(size=q.WORDS), 0.1, 0.4)


def test_risk_over_all_rows_by_brute_force(spark, small):
    from dataclasses import replace

    rng = np.random.default_rng(3)
    texts = [r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    positive = np.arange(len(texts)) % 3 == 0
    texts = [t + " zebra" * 30 * int(p) for t, p in zip(texts, positive)]
    zebra = int(q.features(np.frombuffer(b"zebra", np.uint8), np.array([0, 5]))[1][0])
    frame = spark.createDataFrame([(i, t, int(p), i) for i, (t, p) in enumerate(zip(texts, positive.tolist()))], "doc_id long, text string, label int, chance long").repartition(5)
    rows = q._featured(frame)
    clipped = set()
    for size, weight in ((0.02, 0.0), (0.05, 0.0), (0.02, 20.0)):
        model = random_model(rng, texts, size)
        model.words[zebra] += weight  # positives alone score high, so that the rest falls below 0
        for share in (0.3, 0.95):
            value, slope = q.risk(q.totals(model, rows), share)
            want, rest = plain_risk(model, texts, positive, share)
            assert np.isclose(value, want, rtol=1e-5)
            clipped.add(bool(rest < 0))
            for i in (0, 7, int(np.argmax(np.abs(slope[:-1])))):  # slopes by differences
                ends = []
                for move in (-1e-4, 1e-4):
                    dense, words = model.dense.copy(), model.words.copy()
                    part, at = (dense, i) if i < len(dense) else (words, i - len(dense))
                    part[at] += move
                    a, b = plain_risk(replace(model, dense=dense, words=words), texts, positive, share)
                    ends.append(-b if rest < 0 else a)  # where it clips, the rest goes up again
                assert np.isclose((ends[1] - ends[0]) / 2e-4, slope[i], rtol=1e-3, atol=1e-5)
    assert clipped == {False, True}


def test_steps_go_over_all_rows_and_never_raise_the_risk(spark, small, monkeypatch):
    texts = [r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    frame = spark.createDataFrame([(i, t, int(i % 2 == 0), i) for i, t in enumerate(texts)], "doc_id long, text string, label int, chance long")
    rows = q._featured(frame.repartition(3))
    start = random_model(np.random.default_rng(5), texts, 0.01)
    seen, plain = [], q.totals
    monkeypatch.setattr(q, "totals", lambda model, rows: seen.append(plain(model, rows)) or seen[-1])
    end = q.refined(start, rows)
    assert len(seen) == q.ALL_STEPS + 1 and {x[0] for x in seen} == {len(texts)}
    weight = lambda m: q.DECAY / 2 * (m.dense @ m.dense + m.words @ m.words)
    assert q.risk(plain(end, rows), 0.4)[0] + weight(end) < q.risk(seen[0], 0.4)[0] + weight(start)


def test_features_are_deleted_after_training(spark, small):
    import os

    from flowloom.llm import common

    q.train(spark.read.parquet(f"{small}/documents.parquet"), q.quality_labels(spark, small))
    at = f"{common.shared_dir(spark)}/flowloom".removeprefix("file:")
    assert not os.path.isdir(at) or not [x for x in os.listdir(at) if x.startswith("features")]


def test_steps_go_over_every_trusted_positive(spark, small, monkeypatch):
    monkeypatch.setattr(q, "POSITIVES", 40)
    monkeypatch.setattr(q, "ALL_STEPS", 1)
    frame, labels = spark.read.parquet(f"{small}/documents.parquet"), q.quality_labels(spark, small)
    positives, sampled = [], []
    monkeypatch.setattr(q, "risk", lambda total, share, old=q.risk: positives.append(total[1]) or old(total, share))
    monkeypatch.setattr(q, "fit", lambda dense, words, positive, prior, old=q.fit: sampled.append(positive.sum()) or old(dense, words, positive, prior))
    assert q.train(frame, labels) is not None
    every = frame.where("text is not null").join(labels.where("label = 1"), "doc_id").where(~q.held_out()).count()
    assert 0 < sampled[0] <= 40 < every
    assert positives == [every, every]
