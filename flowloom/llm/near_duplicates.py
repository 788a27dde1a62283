"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of hashed shingles (five words). Two link when their sets'
Jaccard similarity is at least ``THRESHOLD``; the result is each document's
component over links. Only components are returned: within one, most links between
its classes are neither looked for nor counted.

1. ``fingerprints``: one pass gives each document's set size and a fingerprint of
   its set, and a count sketch of fixed size of how many documents hold a shingle.
   Equal sets are one class from here on.
2. Shingles have one global order: rare first by the sketch, then by hash. A class
   of n shingles must share a = ceil(0.8 n) with any partner, so among its first
   n - a + l shingles at least l are shared. Each class picks the l, from
   ``least_level`` on where its size allows, whose prefix has the least estimated cost:
   documents met through its tokens, and candidates left to verify, which thin out
   with l. A pair needs min(l, l') shared prefix tokens before it is verified.
3. Prefix tokens are dealt to buckets by hash, packed. A token that no other class
   has in its prefix is dead. Classes with too few live tokens for any partner go.
   Dead tokens that come before the end of another class's prefix are not in that
   class, which bounds what the two can share. First each class is verified against
   the most central classes that have its first live tokens, then its next ones
   (``PIVOTS`` rounds, ``VOTES`` rows a class at most); links merge classes. Then each class is held against
   all of every other component that it may link to, with the whole count of shared
   tokens: no link between components is lost, and the pairs within a group of copies
   are never listed.
4. Verification compares whole sets. Those of a component lie in shards of bounded
   size, each indexed by one task, and classes outside stream by.

Words, shingles and classes are named by hashes of 64 bits over mixed blocks. Sets that
share a class's number are told apart by a second one of 64 bits, and all but one of them get
another class: n documents merge wrongly with a chance of about n^2 / 2^129, and n distinct words
with one of n^2 / 2^65.

Nulls: a null or empty text has the empty set, which links with nothing; its
component is its own doc_id. An empty table has no rows. A null doc_id is kept, and is the component only where
no other id is reached. Repeated rows are copies. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import kernels as k
from flowloom.llm.common import buckets, columns, fresh, looked_up, small_batches, small_enough, table, tidy, tidy_both, trimmed, written
from flowloom.llm.graph import components

#: Words of a shingle, and the similarity as a fraction.
SHINGLE, THRESHOLD = 5, (80, 100)
#: Counters of the sketch (a fixed 16 MB), slices in which it is summed.
SKETCH, SLICES = 1 << 22, 16
#: Shortest multi-match: LEAST, or a SHARE-th of a set's size, as chance matches grow with it;
#: how many MORE it may take; the cost of verifying a candidate in documents met, the part of candidates that one more shared token leaves, and the least that a token meets.
LEAST, SHARE, MORE, VERIFY_COST, LEFT, FLOOR = 4, 40, 4, 20.0, 0.3, 0.1
#: Steps of a token's rank for each doubling of its documents: 2^20 for 2^32.
RANK = 32767
#: Rounds against central classes before all remaining pairs are listed, and tokens at which a class meets one in a round.
PIVOTS, VOTES = 2, 8
#: Bits of the filter that finds the texts whose sets are needed (a fixed 8 MB); what passes it is joined exactly.
FILTER = 1 << 26
#: Guests that one copy of a shard of sets serves, and sets of a shard.
PARTNERS, SHARD = 256, 256
#: Bits, 32 at most, by which a token is known within its bucket. Others that look like it only add candidates.
LOOK = 32
#: Prefix tokens that a task holds before it deals them out.
HELD = 500_000
SALTS = 32

_U = np.uint64
_K = _U(0x9E3779B97F4A7C55)
_NULL = -(2**63)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    for _, _, slab, at in k.slabs(data, offsets):
        small = k.LOWER[slab]
        start, end, first = k.words(small, at)
        word = k.range_hash(small, start, end)
        n = len(word)
        grams = np.zeros(max(0, n - size + 1), _U)
        for j in range(size if len(grams) else 0):
            grams = grams * _K + word[j : j + len(grams)]
        grams = k.mix(grams)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                yield k.distinct(grams[a : b - size + 1])
            elif b > a:
                h = np.full(1, b - a, _U)
                for w in word[a:b]:
                    h = h * _K + w
                yield k.mix(k.mix(h))
            else:
                yield np.zeros(0, _U)


def fingerprint(grams: np.ndarray, clashes: dict[int, int] | None = None) -> int:
    """A signed 64-bit number of a set; 0 only for the empty one.

    ``clashes``: of numbers that several sets share, the second number of the set that keeps it.
    """
    if not len(grams):
        return 0
    mixed = k.mix(grams)
    total = mixed.sum(dtype=_U, keepdims=True)  # arrays wrap around without a warning
    x = k.mix((grams * _K).sum(dtype=_U, keepdims=True) ^ total * _U(3) + _U(len(grams)))
    own = int(x.view(np.int64)[0]) or 1
    if clashes and own in clashes and (other := second(grams)) != clashes[own]:
        return int(k.mix(x ^ np.array([other]).view(_U)).view(np.int64)[0]) or 1
    return own


def second(grams: np.ndarray) -> int:
    """Another number of a set, independent of ``fingerprint``."""
    x = k.mix(grams ^ _U(0x5851F42D4C957F2D))
    return int(k.mix(x.sum(dtype=_U, keepdims=True) ^ (x * _K).sum(dtype=_U, keepdims=True) * _U(5)).view(np.int64)[0])


def _sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return shingle_sets(*k.texts(batch.column("text")))


def fingerprints(docs: DataFrame, clashes: dict[int, int] | None = None) -> DataFrame:
    """Rows of two kinds: documents (doc_id, key, n, class, second), and slices of the partition's sketch."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key", "n", "class", "second", "slice", "counts"]
        kinds = [*[pa.int64()] * 5, pa.int32(), pa.binary()]
        sketch, seen = np.zeros(SKETCH, np.uint32), set()
        for batch in batches:
            rows, fresh = [], []
            for doc, key, grams in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), _sets(batch), strict=True):
                c = fingerprint(grams, clashes)
                rows.append((doc, key, len(grams), c, second(grams)))
                if c not in seen:  # copies count once in a partition
                    seen.add(c)
                    fresh.append(grams)
            for grams in fresh:  # a set has no shingle twice, but two may share a counter
                np.add.at(sketch, (grams & _U(SKETCH - 1)).astype(np.int64), 1)
            if rows:
                none = pa.nulls(len(rows))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in zip(*rows, strict=True)), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        if seen:
            parts = sketch.astype("<u4").reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, t) for t in kinds[:5]] + [pa.array(range(SLICES), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=names)

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    return named.mapInArrow(trimmed(run), "doc_id long, key long, n long, class long, second long, slice int, counts binary")


def summed_sketch(slices: DataFrame) -> np.ndarray:
    """The sketch over all partitions: a streaming sum by slice, of fixed size at the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
                part = np.frombuffer(zlib.decompress(raw.as_py()), np.uint32)
                held[i] = held[i] + part if i in held else part.astype(np.uint64)
        rows = sorted(held.items())
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([np.minimum(p, 2**32 - 1).astype(np.uint32).tobytes() for _, p in rows], pa.binary())], names=["slice", "counts"])

    out = np.zeros((SLICES, SKETCH // SLICES), np.uint32)
    for i, raw in slices.repartition(SLICES, "slice").mapInArrow(run, "slice int, counts binary").collect():
        out[i] = np.frombuffer(raw, np.uint32)
    return out.ravel()


def required(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles that a set of n must share with any partner."""
    return -(-n * THRESHOLD[0] // THRESHOLD[1])


def least_level(n: np.ndarray | int) -> np.ndarray | int:
    """Shared tokens that a set of n asks for at least, where its size allows."""
    return np.maximum(LEAST, n // SHARE)


def prefix(grams: np.ndarray, sketch: np.ndarray, noise: float) -> tuple[np.ndarray, int, float]:
    """A set's adaptive prefix in order, the shared tokens it asks for, its centrality."""
    n = len(grams)
    rank = np.log2(1.0 + sketch[(grams & _U(SKETCH - 1)).astype(np.int64)])  # of at most 32 bits, so the code never saturates
    order = ((rank * RANK).astype(_U) << _U(44)) | (grams >> _U(20))
    need = required(n)
    short, top = n - need, min(least_level(n) + MORE, need)
    if short + top < n:
        order = np.partition(order, short + top - 1)[: short + top]
    order = np.sort(order)
    met = np.maximum(np.exp2((order >> _U(44)) / RANK) - 1 - noise, FLOOR).cumsum()
    levels = np.arange(min(least_level(n), top), top + 1)
    cost = met[short + levels - 1] * (1 + VERIFY_COST * LEFT ** (levels - 1.0))
    level = int(levels[np.argmin(cost)])
    return order[: short + level], level, float(met[short] / (short + 1))


def coarse(order: np.ndarray) -> np.ndarray:
    """The order in 16 bits; never reverses it."""
    return (order >> _U(48)).astype("<u2")


#: A prefix token, and what is known of its class; ``end`` is the coarse order of its prefix's last token,
#: ``lost`` the tokens that look like another one of the prefix when dealt, by which ``level`` is less.
_TOKEN = np.dtype([("token", "<u4"), ("class", "<i8"), ("order", "<u2")])
_ABOUT = np.dtype([("class", "<i8"), ("n", "<u4"), ("level", "<u4"), ("centre", "<f4"), ("end", "<u2"), ("size", "<u4"), ("lost", "<u2")])
#: A live token of a class that may have partners; ``most`` shingles of it are not dead, ``last`` is its last dead token's order,
#: ``turn`` the round in which the class is held against this token's most central class (``NEVER``: in none).
_POSTING = np.dtype([("token", "<u4"), ("class", "<i8"), ("n", "<u4"), ("level", "<u4"), ("centre", "<f4"), ("end", "<u2"), ("most", "<u4"), ("last", "<u2"), ("turn", "u1")])
NEVER = 255


def _pack_about(own: np.ndarray, orders: list[np.ndarray]) -> bytes:
    """Classes, and the coarse orders of all their prefixes behind them."""
    return len(own).to_bytes(4, "little") + pack(own) + b"".join(o.tobytes() for o in orders)


def _unpack_about(raw: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    n = int.from_bytes(raw[:4], "little")
    own = unpack(raw[4 : 4 + n * _ABOUT.itemsize], _ABOUT)
    return own, np.split(np.frombuffer(raw, "<u2", offset=4 + n * _ABOUT.itemsize), np.cumsum(own["size"].astype(np.int64))[:-1])


def pack(x: np.ndarray) -> bytes:
    """Column after column, so that repeated values lie together."""
    return b"".join(np.ascontiguousarray(x[f]).tobytes() for f in x.dtype.names)


def unpack(raw: bytes, kind: np.dtype) -> np.ndarray:
    n, at = len(raw) // kind.itemsize, 0
    out = np.empty(n, kind)
    for f in kind.names:
        size = kind[f].itemsize * n
        out[f] = np.frombuffer(raw, kind[f], n, at)
        at += size
    return out


def _rows(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x[f].astype(np.int64) if x[f].dtype.kind in "iu" else x[f].astype(float)) for f in x.dtype.names], names=list(x.dtype.names))


def _bodies(bucket: np.ndarray, kind: int, rows: np.ndarray) -> pa.RecordBatch:
    """(bucket, kind, body) of rows dealt to buckets."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    edge = _groups(bucket)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[edge[:-1]], pa.int32()), pa.array(np.full(len(edge) - 1, kind), pa.int32()), pa.array([pack(rows[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())],
        names=["bucket", "kind", "body"],
    )


def postings(docs: DataFrame, sketch: np.ndarray, parts: int, clashes: dict[int, int] | None = None) -> DataFrame:
    """(bucket, kind, body): prefix tokens (0), and what is known of their classes (1), packed."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(sketch)  # of fixed size
    noise = float(sketch.mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        orders: list[np.ndarray] = []
        about: list[tuple] = []
        size = 0

        def dealt() -> Iterator[pa.RecordBatch]:
            own = np.array(about, _ABOUT)
            whole = np.concatenate(orders)
            key, order = k.mix(whole), coarse(whole)
            # Two tokens of a class that look alike when dealt count as one; whoever shares both shares one less.
            owner = np.repeat(np.arange(len(own)), own["size"])
            seen_as = ((key >> _U(64 - LOOK)) << _U(32)) | (key % _U(parts))
            by = np.lexsort((seen_as, owner))
            again = by[1:][(owner[by][1:] == owner[by][:-1]) & (seen_as[by][1:] == seen_as[by][:-1])]
            if len(again):
                own["lost"] = np.bincount(owner[again], minlength=len(own))
                own["size"] -= own["lost"]
                own["level"] = np.maximum(own["level"].astype(np.int64) - own["lost"], 1)
                key, order = np.delete(key, again), np.delete(order, again)
            rows = np.empty(len(key), _TOKEN)
            rows["token"], rows["class"], rows["order"] = (key >> _U(64 - LOOK)).astype(np.uint32), np.repeat(own["class"], own["size"]), order
            yield _bodies((key % _U(parts)).astype(np.int64), 0, rows)
            each = np.split(order, np.cumsum(own["size"].astype(np.int64))[:-1])
            part = own["class"] % parts
            found = [(int(b), 1, _pack_about(own[at], [each[i] for i in at])) for b in np.unique(part) for at in (np.flatnonzero(part == b),)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "kind", "body"])

        for batch in batches:
            for grams in _sets(batch):
                c = fingerprint(grams, clashes)
                if not c or c in seen:
                    continue
                seen.add(c)
                order, level, centre = prefix(grams, sent.value, noise)
                orders.append(order)
                about.append((c, len(grams), level, centre, int(coarse(order[-1:])[0]), len(order), 0))
                size += len(order)
            if size > HELD:
                yield from dealt()
                orders, about, size = [], [], 0
        if about:
            yield from dealt()

    return docs.select("text").mapInArrow(trimmed(run), "bucket int, kind int, body binary")


def live(dealt: DataFrame) -> DataFrame:
    """One row a bucket and kind: the tokens that several classes share, in order; the classes once."""

    def run(group: pa.Table) -> pa.Table:
        kinds, out = np.asarray(group["kind"]), []
        bucket = group["bucket"][0].as_py()
        rows = _all(group["body"].filter(pa.array(kinds == 0)), _TOKEN)
        rows = rows[np.lexsort((rows["class"], rows["token"]))]
        same = np.zeros(len(rows), bool)
        same[1:] = (rows["token"][1:] == rows["token"][:-1]) & (rows["class"][1:] == rows["class"][:-1])
        if len(rows := _several(rows[~same])):
            out.append((bucket, 0, pack(rows)))
        if (kinds == 1).any():
            owns, lists = zip(*(_unpack_about(b.as_py()) for b in group["body"].filter(pa.array(kinds == 1))), strict=True)
            own, each = np.concatenate(owns), [o for x in lists for o in x]
            at = np.unique(own["class"], return_index=True)[1]
            out.append((bucket, 1, _pack_about(own[at], [each[i] for i in at])))
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "kind", "body"])

    return dealt.groupBy("bucket").applyInArrow(tidy(run), "bucket int, kind int, body binary")


def _groups(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, np.int64)


def _several(rows: np.ndarray) -> np.ndarray:
    """Rows, in order of token, whose token is in several."""
    size = np.diff(_groups(rows["token"]))
    return rows[np.repeat(size > 1, size)]


_LIVE = np.dtype([("class", "<i8"), ("order", "<u2")])
_KNOWN = np.dtype([(f, _POSTING[f]) for f in _POSTING.names[1:]])
_MOVED = np.dtype([("class", "<i8"), ("component", "<i8"), ("size", "<u4")])
_BODY = "bucket int, part int, body binary"


def _body_rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 3
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "part", "body"])


def _all(bodies: pa.ChunkedArray, dtype: np.dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *(unpack(b.as_py(), dtype) for b in bodies)])


def _questions(bodies: DataFrame, dtype: np.dtype, parts: int) -> DataFrame:
    """(bucket, part, body), dealt to parts by class: each bucket's live tokens, or of postings its classes."""

    tokens = dtype == _TOKEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, raw in zip(batch.column("bucket").to_pylist(), batch.column("body"), strict=True):
                found = unpack(raw.as_py(), dtype)
                if not tokens:
                    found = found[np.unique(found["class"], return_index=True)[1]]
                rows = np.zeros(len(found), _LIVE)
                rows["class"] = found["class"]
                if tokens:
                    rows["order"] = found["order"]
                part = rows["class"] % parts
                order = np.lexsort((rows["class"], part))
                edge = _groups(part[order])
                yield from _body_rows([(bucket, int(part[order[a]]), pack(rows[order[a:b]])) for a, b in zip(edge[:-1], edge[1:], strict=True)]).to_batches()

    return bodies.select("bucket", "body").mapInArrow(run, _BODY)


def _turns(classes: np.ndarray, bucket: np.ndarray, order: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each bucket the classes that have a turn there, and which: a class's buckets by the first live token in each.

    Classes that share these tokens have the same turns, as tokens have one order.
    """
    if not len(classes):
        return {}
    by = np.lexsort((order, bucket, classes))
    new = np.concatenate([[True], (classes[by][1:] != classes[by][:-1]) | (bucket[by][1:] != bucket[by][:-1])])
    classes, bucket, order = classes[by][new], bucket[by][new], order[by][new]
    by = np.lexsort((bucket, order, classes))
    classes, bucket = classes[by], bucket[by]
    turn = np.arange(len(classes)) - np.searchsorted(classes, classes)
    few = turn < PIVOTS * VOTES
    classes, bucket, turn = classes[few], bucket[few], turn[few]
    return {int(b): (classes[bucket == b], turn[bucket == b]) for b in k.distinct(bucket)}


def eligible(alive: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """(class) of classes with enough live tokens for a partner; and (bucket, body) of their postings.

    A partner has at least 0.8 n shingles, which bounds from below what it asks for.
    """
    tokens = alive.where("kind = 0").select("bucket", "body")
    about = alive.where("kind = 1").select(F.lit(-1).alias("bucket"), F.col("bucket").alias("part"), "body")

    def judge(group: pa.Table) -> pa.Table:
        bucket = np.asarray(group["bucket"])
        abouts = group["body"].filter(pa.array(bucket < 0))
        if not len(abouts):
            return _body_rows([])
        own, each = _unpack_about(abouts[0].as_py())  # one a part, in order of class
        asked = [(int(bucket[i]), unpack(group["body"][int(i)].as_py(), _LIVE)) for i in np.flatnonzero(bucket >= 0)]
        alive = np.concatenate([np.zeros(0, _LIVE), *(rows for _, rows in asked)])
        at = np.searchsorted(own["class"], alive["class"])
        total = np.bincount(at, minlength=len(own))
        # The last dead token: orders that more tokens of the prefix have than live ones.
        mine, mines = np.unique((np.repeat(np.arange(len(own)), own["size"]) << 16) | np.concatenate(each), return_counts=True)
        live_keys, lives = np.unique((at << 16) | alive["order"], return_counts=True)
        mines[np.searchsorted(mine, live_keys)] -= lives
        dead = mine[mines > 0]
        last = np.zeros(len(own), np.int64)
        np.maximum.at(last, dead >> 16, dead & 0xFFFF)
        near = required(own["n"].astype(np.int64))  # the least size of a partner
        lost = own["lost"].astype(np.int64)
        need = np.maximum(np.minimum(np.minimum(own["level"] + lost, least_level(near)), required(near)) - lost, 1)
        known = np.empty(len(own), _KNOWN)
        for f in ("class", "n", "level", "centre", "end"):
            known[f] = own[f]
        known["most"], known["last"] = own["n"] - own["size"] + total, last
        able = total >= need
        out = [(-1, 0, known["class"][able].tobytes())]
        turns = _turns(np.searchsorted(own["class"], alive["class"]), np.repeat([b for b, _ in asked], [len(rows) for _, rows in asked]), alive["order"])
        for b, rows in asked:
            at = k.distinct(np.searchsorted(own["class"], rows["class"]))
            at = at[able[at]]
            if len(at):
                known["turn"] = NEVER
                mine, turn = turns.get(b, (at[:0], at[:0]))
                known["turn"][mine] = turn
                out.append((b, 0, pack(known[at])))
        return _body_rows(out)

    answers = written(_questions(tokens, _TOKEN, parts).union(about).groupBy("part").applyInArrow(tidy(judge), _BODY), "eligible")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("body"):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw.as_py(), np.int64))], names=["class"])

    def narrowed(tokens: pa.Table, answers: pa.Table) -> pa.Table:
        own = _all(answers["body"], _KNOWN)
        if not len(own) or not len(tokens):
            return _body_rows([]).select(["bucket", "body"])
        own, found = own[np.argsort(own["class"])], _all(tokens["body"], _TOKEN)
        at = np.minimum(np.searchsorted(own["class"], found["class"]), len(own) - 1)
        hit = own["class"][at] == found["class"]
        rows = np.empty(int(hit.sum()), _POSTING)
        rows["token"] = found["token"][hit]
        for f in own.dtype.names:
            rows[f] = own[f][at[hit]]
        size = np.diff(_groups(rows["token"]))
        several = np.repeat(size > 1, size)
        rows, order = rows[several], found["order"][hit][several]
        # A class's turn in this bucket is at its first token there.
        by = np.lexsort((rows["token"], order, rows["class"]))
        rows["turn"][by[1:][rows["class"][by][1:] == rows["class"][by][:-1]]] = NEVER
        return _body_rows([(tokens["bucket"][0].as_py(), 0, pack(rows))] if len(rows) else []).select(["bucket", "body"])

    kept = tokens.groupBy("bucket").cogroup(answers.where("bucket >= 0").groupBy("bucket")).applyInArrow(tidy_both(narrowed), "bucket int, body binary")
    return answers.where("bucket < 0").select("body").mapInArrow(ids, "class long"), written(kept, "postings")


def _compatible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs that can reach the threshold by their sizes and by what is dead in them."""
    n, m = a["n"].astype(np.int64), b["n"].astype(np.int64)
    part, whole = THRESHOLD
    # The other class has none of those dead tokens that come before its prefix's end.
    enough = lambda x, y: (x["last"] >= y["end"]) | (x["most"].astype(np.int64) * (part + whole) >= (n + m) * part)
    return (np.minimum(n, m) * whole >= np.maximum(n, m) * part) & enough(a, b) & enough(b, a)


def _pivot_rows(rows: np.ndarray, component: np.ndarray, turn: int) -> np.ndarray:
    """(host, guest): each class at each of its tokens of this turn, and the turn-th most central class that has it."""
    dead = (rows["n"] - rows["most"].astype(np.int64)) / rows["n"]  # what is a class's own is no other's
    order = np.lexsort((rows["class"], -rows["centre"], dead, rows["token"]))
    rows, component = rows[order], component[order]
    edge = _groups(rows["token"])
    size = np.diff(edge)
    pivot = np.repeat(edge[:-1] + turn % np.maximum(size, 1), size)
    ok = (rows["turn"] // VOTES == turn) & (component[pivot] != component) & _compatible(rows, rows[pivot])
    out = np.empty(int(ok.sum()), [("host", "<i8"), ("guest", "<i8")])
    out["host"], out["guest"] = rows["class"][pivot[ok]], rows["class"][ok]
    return np.unique(out)


def _guests(rows: np.ndarray, component: np.ndarray, size: np.ndarray, block: int = 1024) -> Iterator[np.ndarray]:
    """(host, guest, tokens, needed): tokens that a class shares with another component, of bounded runs.

    Of two components the larger one, or the one with the larger name, is the host;
    a token counts where the guest could reach the threshold with a member that has it.
    """
    edge = _groups(rows["token"])
    own, back = np.unique(rows["class"], return_inverse=True)
    hosts, host = np.unique(component, return_inverse=True)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    total = 0

    def least(keys: np.ndarray, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        out = np.full(len(key), 2**31 - 1, np.int64)
        np.minimum.at(out, inverse, needed)
        return key, out, count

    def counted() -> np.ndarray:
        key, needed, tokens = least(*map(np.concatenate, zip(*held, strict=True)))
        out = np.empty(len(key), [("host", "<i8"), ("guest", "<i8"), ("tokens", "<i8"), ("needed", "<i8")])
        out["host"], out["guest"], out["tokens"], out["needed"] = hosts[key % len(hosts)], own[key // len(hosts)], tokens, needed
        return out

    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        part = host[a:b]
        if (part == part[0]).all():
            continue
        # Members of a component lie together, large ones first, so that blocks within one are skipped.
        order = np.lexsort((part, -size[a:b]))
        part, mine, who, large = part[order], rows[a:b][order], back[a:b][order], size[a:b][order]
        one = [(part[i : i + block] == part[i]).all() for i in range(0, b - a, block)]
        found = []
        for i in range(0, b - a, block):
            for j in range(i, b - a, block):
                if one[i // block] and one[j // block] and part[i] == part[j]:
                    continue
                x, y = np.nonzero((part[i : i + block, None] != part[None, j : j + block]) & _compatible(mine[i : i + block, None], mine[None, j : j + block]))
                x, y = x + i, y + j
                x, y = (x[x < y], y[x < y]) if i == j else (x, y)
                first = (large[x] > large[y]) | ((large[x] == large[y]) & (part[x] > part[y]))
                h, g = np.where(first, x, y), np.where(first, y, x)
                found.append(least(who[g] * len(hosts) + part[h], np.minimum(mine["level"][x], mine["level"][y]))[:2])
        keys, needed = map(np.concatenate, zip(*found, strict=True))
        keys, needed, _ = least(keys, needed)  # a token counts once
        held.append((keys, needed))
        total += len(keys)
        if total > 500_000:
            yield counted()
            held, total = [], 0
    if total:
        yield counted()


def _moved(kept: DataFrame, merged: DataFrame | None, parts: int) -> DataFrame:
    """(bucket, body): for each bucket its classes that are merged, packed with their components and those' sizes."""
    if merged is None:
        return kept.sparkSession.createDataFrame([], "bucket int, body binary")
    sizes = merged.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    changed = looked_up(merged, sizes, "component", SALTS, "inner").select(F.expr(f"int(pmod(node, {parts}L))").alias("part"), "node", "component", "size")

    def answer(questions: pa.Table, merged: pa.Table) -> pa.Table:
        pair = np.empty(len(merged), _MOVED)
        pair["class"], pair["component"], pair["size"] = np.asarray(merged["node"]), np.asarray(merged["component"]), np.asarray(merged["size"])
        pair = pair[np.argsort(pair["class"])]
        out = []
        for bucket, raw in zip(questions["bucket"].to_pylist(), questions["body"], strict=True) if len(pair) and len(questions) else ():
            own = unpack(raw.as_py(), _LIVE)["class"]
            at = np.minimum(np.searchsorted(pair["class"], own), len(pair) - 1)
            if (hit := pair["class"][at] == own).any():
                out.append((bucket, 0, pack(pair[at[hit]])))
        return _body_rows(out).select(["bucket", "body"])

    return written(_questions(kept, _POSTING, parts).groupBy("part").cogroup(changed.groupBy("part")).applyInArrow(tidy_both(answer), "bucket int, body binary"), "moved")


def _component_of(rows: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, size = rows["class"].copy(), np.ones(len(rows), np.int64)
    if len(pair):
        pair = pair[np.argsort(pair["class"])]
        at = np.minimum(np.searchsorted(pair["class"], out), len(pair) - 1)
        hit = pair["class"][at] == out
        out[hit], size[hit] = pair["component"][at[hit]], pair["size"][at[hit]]
    return out, size


def _by_bucket(kept: DataFrame, moved: DataFrame, make, schema: str) -> DataFrame:
    """Rows that ``make`` yields of a bucket's postings, their components and those' sizes."""

    def run(postings: pa.Table, moved: pa.Table) -> pa.Table:
        rows = _all(postings["body"], _POSTING)
        made = [_rows(x) for x in make(rows, *_component_of(rows, _all(moved["body"], _MOVED)))] if len(rows) else []
        return pa.Table.from_batches(made) if made else pa.table({f.split()[0]: pa.array([], pa.float64() if f.endswith("double") else pa.int64()) for f in schema.split(", ")})

    return kept.groupBy("bucket").cogroup(moved.groupBy("bucket")).applyInArrow(tidy_both(run), schema)


def pivot_pairs(kept: DataFrame, moved: DataFrame, turn: int) -> DataFrame:
    """(host, guest): at most ``VOTES`` pivots for each class, of other components, at the class's tokens of this turn.

    These rounds only merge classes early; what they leave, ``remaining_pairs`` lists in full.
    """
    return _by_bucket(kept, moved, lambda rows, component, size: [_pivot_rows(rows, component, turn)], "host long, guest long").distinct()


def remaining_pairs(kept: DataFrame, moved: DataFrame) -> DataFrame:
    """(host, guest): all components and classes outside with enough shared prefix tokens.

    A guest shares at least as many tokens with the component as with any member.
    """
    found = _by_bucket(kept, moved, _guests, "host long, guest long, tokens long, needed long")
    return found.groupBy("host", "guest").agg(F.sum("tokens").alias("tokens"), F.min("needed").alias("needed")).where("tokens >= needed").select("host", "guest")


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size in which the bits of all ``keys(key)`` are set; joined by slices."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER // 8, np.uint8)
        for batch in batches:
            at = k.mix(np.asarray(batch.column("key")).view(_U)) % _U(FILTER)
            np.bitwise_or.at(bits, (at >> _U(3)).astype(np.int64), np.uint8(1) << (at & _U(7)).astype(np.uint8))
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in bits.reshape(SLICES, -1)], pa.binary())], names=["slice", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("slice").to_pylist(), batch.column("bits"), strict=True):
                part = np.frombuffer(zlib.decompress(raw.as_py()), np.uint8)
                held[i] = held[i] | part if i in held else part
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([p.tobytes() for p in held.values()], pa.binary())], names=["slice", "bits"])

    out = np.zeros((SLICES, FILTER // 8 // SLICES), np.uint8)
    for i, raw in keys.mapInArrow(trimmed(mark), "slice int, bits binary").repartition(SLICES, "slice").mapInArrow(join, "slice int, bits binary").collect():
        out[i] = np.frombuffer(raw, np.uint8)
    return out.ravel()


def class_sets(docs: DataFrame, able: DataFrame, classes: DataFrame, clashes: dict[int, int] | None = None) -> DataFrame:
    """(class, grams): the sets of eligible classes, from the text of the class's least id.

    Texts stay where they are: a filter of fixed size picks those with such an id (and
    few others), and only the sets of these are moved. Where they meet, classes that
    are not eligible and sets that came before are left out, in a stream.
    """
    spark = docs.sparkSession
    keys = able.select("class").join(classes.select("class", F.coalesce("doc_id", F.lit(_NULL)).alias("key")), "class").select("key")
    sent = spark.sparkContext.broadcast(key_filter(keys))  # of fixed size
    parts = buckets(spark)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            at = k.mix(np.asarray(batch.column("key")).view(_U)) % _U(FILTER)
            batch = batch.filter(pa.array((sent.value[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1))
            out = [(c, grams.tobytes()) for grams in _sets(batch) if (c := fingerprint(grams, clashes)) and c not in seen and not seen.add(c)] if batch.num_rows else []
            columns = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], names=["class", "grams"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None
        for batch in batches:
            stay = []
            for i, (c, grams) in enumerate(zip(batch.column("class").to_pylist(), batch.column("grams").is_valid().to_pylist(), strict=True)):
                if not grams:
                    wanted = c
                elif c == wanted:
                    stay.append(i)
                    wanted = None
            if stay:
                yield batch.take(pa.array(stay))

    small_batches(spark)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("key"), "text")
    both = texts.mapInArrow(trimmed(sets), "class long, grams binary").union(able.select("class", F.lit(None).cast("binary").alias("grams")))
    return both.repartition(parts, "class").sortWithinPartitions(F.col("class"), F.col("grams").isNotNull()).mapInArrow(trimmed(once), "class long, grams binary")


def verified(pairs: DataFrame, sets: DataFrame, members: DataFrame | None) -> DataFrame:
    """Links (a, b) among ``pairs(host, guest)``: one, if there is any, for a guest and a shard of its host.

    A host's members, ``members(component, node)`` or else the class itself, are dealt
    to shards of ``SHARD`` sets; a task indexes a shard and lets the guests stream by.
    Hosts with very many guests have several copies of each shard.
    """
    spark = pairs.sparkSession
    held = pairs.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("copies"))
    if members is None:
        own = held.select("host", F.col("host").alias("class"), F.lit(1).alias("shards"), "copies")
    else:
        sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
        hosts = held.join(sizes, F.col("host") == F.col("component"), "left").select(F.col("host").alias("component"), F.coalesce("shards", F.lit(1)).alias("shards"), "copies", F.col("shards").isNull().alias("alone"))
        hosts = written(hosts, "hosts")
        inner = looked_up(members, hosts.where("not alone").drop("alone"), "component", SALTS, "inner").select(F.col("component").alias("host"), F.col("node").alias("class"), "shards", "copies")
        own = inner.union(hosts.where("alone").select("component", "component", "shards", "copies").toDF("host", "class", "shards", "copies"))
    own = written(own, "own")
    shards = written(own.groupBy("host").agg(F.first("shards").alias("shards"), F.first("copies").alias("copies")), "shards")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    fixed = own.withColumn("copy", each(F.col("copies"))).select("class", "host", F.expr("int(pmod(xxhash64(class), shards))").alias("shard"), "copy", F.lit(0).alias("turn"))
    asked = looked_up(pairs, shards, "host", SALTS, "inner").withColumn("shard", each(F.col("shards")))
    asked = asked.select(F.col("guest").alias("class"), "host", "shard", F.expr("int(pmod(xxhash64(guest), copies))").alias("copy"), F.lit(1).alias("turn"))
    wanted = written(fixed.unionByName(asked), "partners")
    flying = sets.join(wanted, "class").select("host", "shard", "copy", "turn", "class", "grams")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, grams, owner, size, raws = None, [], np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for batch in batches:
            out = []
            for h, shard, copy, turn, c, raw in zip(*(batch.column(x).to_pylist() for x in ("host", "shard", "copy", "turn", "class")), batch.column("grams"), strict=True):
                key = (h, shard, copy)
                if key != at:
                    at, names, raws, grams = key, [], [], None
                if turn == 0:
                    names.append(c)
                    raws.append(np.frombuffer(raw.as_py(), _U))
                    continue
                if not names:
                    continue
                if grams is None:
                    size = np.array([len(r) for r in raws])
                    grams, owner = np.concatenate(raws), np.repeat(np.arange(len(raws)), size)
                    order = np.argsort(grams, kind="stable")
                    grams, owner = grams[order], owner[order]
                mine = np.frombuffer(raw.as_py(), _U)
                low, high = np.searchsorted(grams, mine), np.searchsorted(grams, mine, "right")
                count = high - low
                hit = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                inner = np.bincount(owner[hit], minlength=len(names))
                linked = np.flatnonzero(inner * THRESHOLD[1] >= (size + len(mine) - inner) * THRESHOLD[0])
                out.extend((names[i], c) for i in linked[:1] if names[i] != c)
            columns = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64())], names=["a", "b"])

    small_batches(spark)
    dealt = flying.repartition(buckets(spark), "host", "shard", "copy").sortWithinPartitions("host", "shard", "copy", "turn", "class")
    return dealt.mapInArrow(trimmed(compare), "a long, b long")


def _classes(docs: DataFrame, clashes: dict[int, int] | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``fingerprints`` gives; its documents; and a row for each class."""
    first = written(fingerprints(docs, clashes), "fingerprints")
    rows = first.where("slice is null").select("doc_id", "key", "n", "class", "second")
    made = rows.where("class <> 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("members"), F.min("second").alias("kept"), F.max("second").alias("most"))
    return first, rows.drop("second"), written(made, "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, class, grouped, key) of each row of ``docs(doc_id, text)``.

    ``grouped``: the row has a near copy; ``key`` is a hash of its text.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    first, rows, classes = _classes(docs, None)
    # Sets that share a number: none on most corpora, n^2 / 2^65 are expected of n documents.
    clashes = {r["class"]: r["kept"] for r in classes.where("kept <> most").select("class", "kept").toLocalIterator()}
    if clashes:
        first, rows, classes = _classes(docs, clashes)
    sketch = summed_sketch(first.where("slice is not null").select("slice", "counts"))
    parts = buckets(spark)
    able, kept = eligible(written(live(postings(docs, sketch, parts, clashes)), "live"), parts)
    links: DataFrame | None = None
    merged: DataFrame | None = None
    # The sets lie in a table bucketed by class, so that the rounds' joins do not move them.
    name = f"flowloom_sets_{uuid.uuid4().hex}"
    class_sets(docs, able, classes, clashes).write.bucketBy(parts, "class").saveAsTable(name)
    try:
        sets = spark.table(name)
        for turn in range(PIVOTS + 1):
            moved = _moved(kept, merged, parts)
            pairs = written(pivot_pairs(kept, moved, turn) if turn < PIVOTS else remaining_pairs(kept, moved), "pairs")
            if pairs.isEmpty():
                continue
            found = written(verified(pairs, sets, merged if turn == PIVOTS else None), "links")
            if not found.isEmpty():
                links = found if links is None else links.union(found)
                merged = written(components(links), "merged")
    finally:
        spark.sql(f"drop table if exists {name}")
    if merged is None:
        merged = spark.createDataFrame([], "node long, component long")
    # The least doc_id of each component of classes; classes of one row without links need none.
    grouped = classes.join(merged.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = written(grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.sum("members").alias("size")).where("size > 1"), "least")
    known = written(looked_up(grouped.select("class", "component"), least.select("component", "component_id"), "component", SALTS, "inner").select("class", "component_id", F.lit(True).alias("grouped")), "known")
    out = looked_up(rows, known, "class", SALTS)
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "class",
        F.coalesce("grouped", F.lit(False)).alias("grouped"),
        "key",
    )


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: of those with the component's doc_id the one with the least hash of its text.

    Rows are named by doc_id and a hash of the text. Only rows that have near copies
    are in the list that ``docs`` is compared with; it is broadcast if its bytes are within a
    bound, else both sides are shuffled. Columns may have any names.
    """
    found = written(near_duplicates(docs).where("grouped").select(F.coalesce("doc_id", F.lit(_NULL)).alias("id"), F.coalesce("component_id", F.lit(_NULL)).alias("component"), "key"), "grouped")
    first = written(found.where("id = component").groupBy("component").agg(F.min("key").alias("first_key")), "first")
    rows = looked_up(found, first, "component", SALTS, "inner")
    own_id, own_key, state = (fresh(c, docs) for c in ("__id", "__key", "__state"))
    stays = (F.col("id") == F.col("component")) & (F.col("key") == F.col("first_key"))
    named = rows.withColumn("stays", stays).groupBy("id", "key").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    # Rows that stay and come once need no name.
    named = written(named.where("not stays or n > 1").select(F.col("id").alias(own_id), F.col("key").alias(own_key), F.col("stays").alias(state)), "named")
    repeated = not named.where(F.col(state)).isEmpty()
    keyed = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias(own_id), F.xxhash64("text").alias(own_key))
    joined = keyed.join(F.broadcast(named) if small_enough(named, 48) else named, [own_id, own_key], "left")
    out = joined.where(F.col(state).isNull())
    if repeated:
        out = out.unionByName(joined.where(F.col(state)).dropDuplicates([own_id, own_key]))
    return out.select(*columns(docs))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
