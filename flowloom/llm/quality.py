"""Quality scores by positive-unlabelled learning.

Trusted positives are training rows with label 1, the unlabelled rows the
web text itself. A linear model minimises the non-negative unbiased risk

    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])

(logistic loss l; where the second part is negative its gradient is reversed) with
the class prior estimated first: the share of label 1 among the labelled training
rows, or, if no row is labelled 0, from the scores of positives and unlabelled rows.

Inputs of a score are of the text alone: shares of kinds of bytes and words, each
also in bins, and hashed words. A first model, with the scale and the bins of the
inputs, is fitted on at most ``POSITIVES`` and ``UNLABELLED`` rows, chosen by a hash of
doc_id. From there, ``ALL_STEPS`` steps go over every unlabelled training row and every
trusted positive: each task sums the risk and its gradients over its rows, and what is
kept is the model of least risk over all rows, never a worse one than the first. Scores
cover every whole text.

Nulls: a null text counts as empty and has a score. Rows with a null label, doc_id
or without text teach nothing. Without positives every score is one half. Of several
labels of one id the least counts, so an id with both labels is no trusted positive.
Equal texts have equal scores, and repeated rows each keep theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import kernels as k
from flowloom.llm.common import _trim, deleted, mapped, shared_path, small_batches, small_enough, table, tidy, trimmed

#: Most rows of each kind that the model is fitted on, and the hashed words' dimensions.
POSITIVES, UNLABELLED, WORDS = 6000, 12000, 1 << 12
BINS, STEPS, RATE, DECAY = 8, 160, 0.05, 1e-4
#: Steps over all rows, the first one's rate, and the number of sums that the tasks' sums are added up to.
ALL_STEPS, ALL_RATE, SUMS = 8, 0.02, 256
_SYMBOLS = b"*#$%&^~@=<>{}[]\\_+"
_CLASSES = [np.isin(np.arange(256), list(x)) for x in (range(65, 91), range(97, 123), range(48, 58), b" ", b"\n\r\t", b"!", b"?", b"|", b".,;:", _SYMBOLS, b"'\"()-/", range(128, 256), range(0, 9))]
_LAST = np.isin(np.arange(256), list(_SYMBOLS + b"!|"))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense features of each text; hashed words, and the number of them before each text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    safe = np.maximum(size, 1)
    dense = [np.log1p(size)]
    for kind in _CLASSES:
        sums = np.concatenate([[0], np.cumsum(kind[data])])
        dense.append((sums[offsets[1:]] - sums[offsets[:-1]]) / safe)
    small = k.LOWER[data]
    start, end, first = k.words(small, offsets)
    count = np.diff(first).astype(float)
    many = np.maximum(count, 1)
    code = k.range_hash(small, start, end)
    owner = np.repeat(np.arange(n), np.diff(first))
    per = lambda x: np.bincount(owner, x, n)[:n] / many
    dense.append(np.log1p(count))
    dense.append(per((end - start).astype(float)))
    dense.append(per(((end - start) > 12).astype(float)))
    dense.append(per(_LAST[data[end - 1]].astype(float)) if len(end) else np.zeros(n))
    order = np.lexsort((code, owner))
    new = np.ones(len(code), bool)
    if len(code) > 1:
        new[1:] = (code[order][1:] != code[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    dense.append(per(new.astype(float)))
    same = np.zeros(len(code))
    if len(code) > 1:
        same[1:] = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
    dense.append(per(same))
    return np.column_stack(dense), (code % np.uint64(WORDS)).astype(np.int64), first


@dataclass
class Model:
    """Weights of a fitted model; of a size that does not depend on the data."""

    mean: np.ndarray
    scale: np.ndarray
    edges: np.ndarray
    dense: np.ndarray
    words: np.ndarray
    bias: float
    prior: float

    def expand(self, dense: np.ndarray) -> np.ndarray:
        z = np.clip((dense - self.mean) / self.scale, -4, 4)
        bins = (dense[:, :, None] >= self.edges[None]).astype(float).reshape(len(dense), -1)
        return np.hstack([z, bins])

    def margin(self, dense: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.words[words])])
        share = (sums[first[1:]] - sums[first[:-1]]) / np.sqrt(np.maximum(np.diff(first), 1))
        return self.expand(dense) @ self.dense + share + self.bias

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = [1 / (1 + np.exp(-np.clip(self.margin(*features(d, o)), -50, 50))) for _, _, d, o in k.slabs(data, offsets)]
        return np.concatenate(out) if out else np.zeros(0)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least ratio of the tails of two sets of scores, where both tails are well filled."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.9, 40))
    tail = np.array([[np.mean(unlabelled <= c), np.mean(positive <= c)] for c in cuts])
    return float(np.clip(min((u / p for u, p in 1 - tail if p > 0.05), default=0.5), 0.05, 0.99))


class Rows:
    """Sparse rows of hashed words: each row's distinct words and their weights, one row after another.

    Sums go over slabs of rows, so that only these two lists are as long as the sample.
    """

    SLAB = 1 << 18

    def __init__(self, flat: np.ndarray, value: np.ndarray, size: np.ndarray):
        self.n, self.flat, self.value = len(size), flat, value
        self.at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)

    def _slabs(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        i = 0
        while i < self.n:
            j = min(self.n, max(i + 1, int(np.searchsorted(self.at, self.at[i] + self.SLAB, "right")) - 1))
            a, b = self.at[i], self.at[j]
            yield i, j, np.repeat(np.arange(j - i), np.diff(self.at[i : j + 1])), self.flat[a:b], self.value[a:b]
            i = j

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for i, j, owner, flat, value in self._slabs():
            out[i:j] = np.bincount(owner, value * w[flat], j - i)
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(WORDS)
        for i, j, owner, flat, value in self._slabs():
            out += np.bincount(flat, value * g[i:j][owner], WORDS)
        return out


def fit(dense: np.ndarray, words: Rows, positive: np.ndarray, prior: float | None) -> Model | None:
    """Minimises the non-negative risk; rows where ``positive`` is false are unlabelled. None without rows of both kinds."""
    if not positive.any() or positive.all():
        return None
    mean, scale = dense.mean(0), dense.std(0) + 1e-9
    edges = np.quantile(dense, np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T
    model = Model(mean, scale, edges, np.zeros(dense.shape[1] * (1 + BINS)), np.zeros(WORDS), 0.0, prior or 0.5)
    x, rows = model.expand(dense), words
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)

    def descend(share: float, p: np.ndarray, u: np.ndarray) -> np.ndarray:
        model.dense[:], model.words[:], model.bias = 0, 0, 0.0
        state = [[np.zeros_like(w), np.zeros_like(w)] for w in (model.dense, model.words, np.zeros(1))]
        g = np.zeros(len(x))
        for step in range(1, STEPS + 1):
            g = x @ model.dense + rows.times(model.words) + model.bias
            s = 1 / (1 + np.exp(-np.clip(g, -50, 50)))
            soft = np.logaddexp(0, g)
            rest = soft[u].mean() - share * soft[p].mean()
            grad = np.zeros(len(x))
            if rest >= 0:
                grad[p] = share * (s[p] - 1) / len(p) - share * s[p] / len(p)
                grad[u] = s[u] / len(u)
            else:  # more than the negatives' risk was fitted away: go back
                grad[p] = share * s[p] / len(p)
                grad[u] = -s[u] / len(u)
            grads = (x.T @ grad + DECAY * model.dense, rows.back(grad) + DECAY * model.words, np.array([grad.sum()]))
            moves = []
            for (m, v), d in zip(state, grads, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                moves.append(RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
            model.dense -= moves[0]
            model.words -= moves[1]
            model.bias -= float(moves[2][0])
        return g

    if prior is None:  # scores of the half that was not fitted on
        g = descend(0.5, p[::2], u[::2])
        model.prior = estimated_prior(g[p[1::2]], g[u[1::2]]) if len(p) > 1 and len(u) > 1 else 0.5
    descend(model.prior, p, u)
    return model


def sums(model: Model, dense: np.ndarray, words: Rows, positive: np.ndarray) -> np.ndarray:
    """What the risk and its gradient are made of, as one vector that adds up over rows; every row is unlabelled too."""
    x = model.expand(dense)
    g = x @ model.dense + words.times(model.words) + model.bias
    s, soft, p = 1 / (1 + np.exp(-np.clip(g, -50, 50))), np.logaddexp(0, g), positive.astype(float)
    slopes = [np.concatenate([x.T @ d, words.back(d), [d.sum()]]) for d in (s, p * s, p)]
    return np.concatenate([[len(g), p.sum(), soft.sum(), p @ soft, p @ (soft - g)], *slopes])


def risk(total: np.ndarray, share: float) -> tuple[float, np.ndarray]:
    """The non-negative risk by the sums of all rows, and the direction to descend in, reversed where it clips."""
    n, n_p, all_neg, p_neg, p_pos = total[:5]
    all_slope, p_slope, p_count = total[5:].reshape(3, -1)
    rest = all_neg / n - share * p_neg / n_p
    if rest >= 0:
        return share * p_pos / n_p + rest, all_slope / n - share * p_count / n_p
    return share * p_pos / n_p, share * p_slope / n_p - all_slope / n


def totals(model: Model, rows: DataFrame) -> np.ndarray:
    """``sums`` over all rows of ``_featured``: added up in each task, then in ``SUMS`` groups of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows:
                own = sums(model, *_unpacked(batch), batch.column("label").to_numpy() == 1)
                found = own if found is None else found + own
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUMS], pa.int32()), pa.array([found.tobytes()], pa.binary())], names=["part", "sums"])

    def added(group: pa.Table) -> pa.Table:
        one = sum(np.frombuffer(x.as_py()) for x in group["sums"])
        return pa.table({"part": group["part"].slice(0, 1), "sums": pa.array([one.tobytes()], pa.binary())})

    schema = "part int, sums binary"
    found = rows.select("label", "dense", "words", "value").mapInArrow(trimmed(run), schema).groupBy("part").applyInArrow(tidy(added), schema)
    return sum(np.frombuffer(x.as_py()) for x in found.sort("part").toArrow()["sums"])


def refined(start: Model, rows: DataFrame) -> Model:
    """From ``start``, steps over all rows; of the models met, the one of least risk over all rows."""
    w = np.concatenate([start.dense, start.words, [start.bias]])
    of = lambda w: replace(start, dense=w[: len(start.dense)], words=w[len(start.dense) : -1], bias=float(w[-1]))
    best, least = start, np.inf
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, ALL_STEPS + 2):
        value, slope = risk(totals(of(w), rows), start.prior)
        value += DECAY / 2 * (w[:-1] @ w[:-1])
        if value < least:
            best, least = of(w), value
        slope[:-1] += DECAY * w[:-1]
        m += 0.3 * (slope - m)
        v += 0.1 * (slope * slope - v)
        w = w - ALL_RATE / step**0.5 * (m / (1 - 0.7**step)) / (np.sqrt(v / (1 - 0.9**step)) + 1e-8)
    return best


def _unpacked(found: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, Rows]:
    joined = lambda c, kind: np.frombuffer(b"".join(found.column(c).to_pylist()), kind)
    size = np.array([len(x) // 2 for x in found.column("words").to_pylist()], np.int64)
    return joined("dense", np.float64).reshape(found.num_rows, -1), Rows(joined("words", np.uint16), joined("value", np.float32), size)


def _featured(rows: DataFrame) -> DataFrame:
    """Features of training rows, to be fitted on: dense ones, distinct hashed words and their weights, as bytes. Other columns than the text stay."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in k.slabs(*k.texts(batch.column("text"))):
                dense, words, first = features(data, offsets)
                size = np.diff(first)
                key, count = np.unique(np.repeat(np.arange(len(size)), size) * WORDS + words, return_counts=True)
                at = np.searchsorted(key, np.arange(len(size) + 1) * WORDS)
                flat = (key % WORDS).astype(np.uint16)
                value = (count / np.sqrt(np.maximum(size, 1))[key // WORDS]).astype(np.float32)
                packed = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())  # noqa: B023, E731
                kept = [batch.column(c).slice(i, j - i) for c in others]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([x.tobytes() for x in dense], pa.binary()), packed(flat), packed(value)], names=[*others, "dense", "words", "value"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(trimmed(run), ", ".join([*(f"{c} {kinds[c]}" for c in others), "dense binary, words binary, value binary"]))


def _bounded(found: pa.Table) -> pa.Table:
    """``found`` by label and doc_id, with the rows of least chance where there are more than the bounds."""
    found = found.sort_by([("label", "ascending"), ("chance", "ascending"), ("doc_id", "ascending")])
    unlabelled = int(np.count_nonzero(found["label"].to_numpy() == 0))
    kept = pa.concat_tables([found.slice(0, min(unlabelled, UNLABELLED)), found.slice(unlabelled, POSITIVES)])
    return kept.sort_by([("label", "ascending"), ("doc_id", "ascending")])


def held_out(doc_id: str = "doc_id"):
    """The rows whose labels nothing is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fits the model; ``labels`` has doc_id and label (1, or 0 for the prior alone)."""
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and label in (0, 1)").where(~held_out()).select("doc_id", F.col("label").cast("int").alias("label")).groupBy("doc_id").agg(F.min("label").alias("label"))
    count = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if not count.get(1):
        return None
    prior = count[1] / (count[1] + count[0]) if count.get(0) else None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null").where(~held_out())
    chance = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30))
    taken = lambda rows, most, of: rows.where(chance < int(min(1.0, most / max(of, 1)) * (1 << 30)))
    trusted = known.where("label = 1")
    trusted = F.broadcast(trusted) if small_enough(trusted, 16) else trusted  # neither texts nor, within the bound, features are shuffled
    marked = _featured(texts.withColumn("chance", chance)).join(trusted, "doc_id", "left")
    path = shared_path(docs.sparkSession, "features")
    marked.select("doc_id", F.coalesce("label", F.lit(0)).alias("label"), "chance", "dense", "words", "value").write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    sample = taken(rows.where("label = 1"), POSITIVES, count[1]).union(taken(rows, UNLABELLED, rows.count()).withColumn("label", F.lit(0)))
    found = _bounded(sample.toArrow())
    model = fit(*_unpacked(found), found["label"].to_numpy() == 1, prior) if found.num_rows else None
    del found
    if model is not None:
        model = refined(model, rows)
    deleted(docs.sparkSession, path)
    _trim()
    return model


def score(docs: DataFrame, model: Model | None, out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text."""
    docs = docs.drop(out)
    if model is None:
        return docs.withColumn(out, F.lit(0.5))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(*k.texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out])

    return mapped(docs, run, (out, "double"))


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, quality_labels(spark, sf_dir)))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
