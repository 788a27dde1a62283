"""Compression of vectors to short codes by filtering Lloyd.

A vector's components become integers, ``floor(SCALE * x)``, and it is cut into
``PARTS`` equal consecutive parts. Each part position has a codebook of at most
``ENTRIES`` entries, first the parts of the smallest ids; a round assigns every part to
its nearest entry and moves each entry to the floor of its parts' mean.

1. ``planted``: each partition deals its vectors into blocks of bounded bytes and builds
   a kd-tree for each part position of a block. A node caches its box, count and sums.
   Blocks are written once to the shared folder; every round reads them.
2. A round: the codebooks are broadcast (entries x components, whatever the input). From
   each root, entries that cannot win anywhere in a node's box go: the entry nearest to
   the box's middle beats them at the corner that favours them most. A node with one
   entry left is assigned as a whole by its cached sums; only leaves with several compare
   points. Sums are added in the task, then by (part, entry, component).
3. At last parts are assigned again, and a block's codes go back to its ids.

All arithmetic is exact on integers: in doubles while squares stay below 2^53, beyond in
64 bits; components beyond 64-bit squares are a ValueError, as an error would not fit.

Dropped: vectors that are null or hold null, NaN or infinite components, and those of
another length than the vector of the smallest id; a length that ``PARTS`` does not divide is a ValueError.
Null ids are coded and count as the largest. Rows that repeat an id each keep a row; of equal
ids the lesser vector comes first. With fewer vectors than entries the codebooks are shorter; an
empty table has no rows. Other columns than vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import looked_up, table, trimmed, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bytes of components in a block, and points in a leaf.
BLOCK_BYTES, LEAF = 8 << 20, 32
#: Numbers that a step of the filter holds at a time.
STEP = 1 << 20
SALTS = 32


class Tree:
    """A kd-tree over points, stored by node; nodes of a level lie together.

    ``order``: the points by leaf. A node has the points ``low`` to ``high`` in that order,
    its ``first`` of two adjacent children or -1, its box and the sums of its points.
    """

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        low, high, first, least, most, sums = [], [], [], [], [], []
        level = [(0, len(points))]
        while level:
            following: list[tuple[int, int]] = []
            behind = len(low) + len(level)
            for a, b in level:
                own = points[self.order[a:b]]
                box = own.min(0), own.max(0)
                spread = box[1] - box[0]
                low.append(a)
                high.append(b)
                least.append(box[0])
                most.append(box[1])
                sums.append(own.sum(0))
                if b - a <= LEAF or not spread.any():
                    first.append(-1)
                    continue
                first.append(behind + len(following))
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, int(spread.argmax())], half)]
                following += [(a, a + half), (a + half, b)]
            level = following
        self.low, self.high, self.first = (np.array(x, np.int64) for x in (low, high, first))
        self.least, self.most, self.sums = (np.array(x) for x in (least, most, sums))
        self.points = points[self.order]

    def assigned(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry of each point, and each entry's count and sums of points."""
        k, width = entries.shape
        code, compared = np.empty(len(self.points), np.int64), np.zeros(len(self.points), bool)
        count, total = np.zeros(k, np.int64), np.zeros((k, width), entries.dtype)
        length = (entries * entries).sum(1)
        nodes, alive = np.zeros(1, np.int64), np.ones((1, k), bool)
        most = max(1, STEP // (k * width))
        while len(nodes):
            for a in range(0, len(nodes), most):
                alive[a : a + most] = self._filtered(nodes[a : a + most], alive[a : a + most], entries, length)
            single, leaf = alive.sum(1) == 1, self.first[nodes] < 0
            winner = alive.argmax(1)
            np.add.at(count, winner[single], (self.high - self.low)[nodes[single]])
            np.add.at(total, winner[single], self.sums[nodes[single]])
            for node, w in zip(nodes[single].tolist(), winner[single].tolist(), strict=True):
                code[self.low[node] : self.high[node]] = w
            for node, left in zip(nodes[leaf & ~single].tolist(), alive[leaf & ~single], strict=True):
                mine, own = np.flatnonzero(left), self.points[self.low[node] : self.high[node]]
                code[self.low[node] : self.high[node]] = mine[(length[mine] - 2 * (own @ entries[mine].T)).argmin(1)]
                compared[self.low[node] : self.high[node]] = True
            split = ~single & ~leaf
            children = self.first[nodes[split]]
            nodes, alive = np.concatenate([children, children + 1]), np.concatenate([alive[split], alive[split]])
        own, points = code[compared], self.points[compared]
        count += np.bincount(own, minlength=k)
        by = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.diff(own[by], prepend=-1))
        if len(first):
            total[own[by][first]] += np.add.reduceat(points[by], first, axis=0)
        back = np.empty_like(code)
        back[self.order] = code
        return back, count, total

    def _filtered(self, nodes: np.ndarray, alive: np.ndarray, entries: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The entries that may be nearest, least in number first, to some place in each node's box."""
        least, most = self.least[nodes], self.most[nodes]
        far = length - (least + most) @ entries.T  # from the middle, but for what is equal in a row
        best = np.where(alive, far, far.max() + 1).argmin(1)
        # How much farther than the best at the corner that favours an entry most: nodes of one best together.
        behind = far - far[np.arange(len(nodes)), best][:, None]
        order = np.argsort(best, kind="stable")
        edge = np.flatnonzero(np.diff(best[order], prepend=-1, append=-1))
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            own = order[i:j]
            behind[own] -= (most[own] - least[own]) @ np.abs(entries - entries[best[own[0]]]).T
        number = np.arange(len(entries))[None]
        return alive & ((behind < 0) | ((behind == 0) & (number <= best[:, None])))


def whole(x: Column) -> Column:
    """An array's components as integers."""
    return F.transform(x, lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("long"))


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of vectors without null or non-finite components."""
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & ~F.coalesce(odd, F.lit(True)))


def planted(kept: DataFrame, width: int, kind: str) -> DataFrame:
    """Blocks (vec_id, label, body): ids, labels and the trees of a bounded number of vectors."""
    rows = max(LEAF, BLOCK_BYTES // (8 * width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def block() -> pa.RecordBatch:
            joined = pa.Table.from_batches(held).combine_chunks()
            values = joined["whole"].combine_chunks().flatten()
            points = np.asarray(values).astype(kind).reshape(-1, width)
            body = packed([Tree(np.ascontiguousarray(p)) for p in np.split(points, PARTS, 1)])
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(joined)], pa.int32()), joined[c].combine_chunks())
            return pa.RecordBatch.from_arrays([one("vec_id"), one("label"), pa.array([body], pa.binary())], names=["vec_id", "label", "body"])

        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, rows - size)
                held.append(some)
                size += some.num_rows
                batch = batch.slice(some.num_rows)
                if size == rows:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    types = dict(kept.dtypes)
    named = kept.select("vec_id", "label", whole(F.col("embedding")).alias("whole"))
    return named.mapInArrow(trimmed(run), f"vec_id array<{types['vec_id']}>, label array<{types['label']}>, body binary")


_ARRAYS = ("order", "low", "high", "first", "least", "most", "sums", "points")


def packed(trees: list[Tree]) -> bytes:
    import io

    out = io.BytesIO()
    np.savez(out, **{f"{i}{a}": getattr(t, a) for i, t in enumerate(trees) for a in _ARRAYS})
    return out.getvalue()


def unpacked(body: pa.Scalar) -> list[Tree]:
    found = np.load(pa.BufferReader(body.as_buffer()), allow_pickle=False)
    trees = []
    for i in range(PARTS):
        tree = Tree.__new__(Tree)
        for a in _ARRAYS:
            setattr(tree, a, found[f"{i}{a}"])
        trees.append(tree)
    return trees


def _round(blocks: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round over all blocks."""
    sent = blocks.sparkSession.sparkContext.broadcast(codebooks)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for body in batch.column("body"):
                for p, tree in enumerate(unpacked(body)):
                    _, n, s = tree.assigned(books[p])
                    counts[p] += n
                    totals[p] += s.astype(np.int64)
        for p, (n, s) in enumerate(zip(counts, totals, strict=True)):
            used, width = np.flatnonzero(n), s.shape[1]
            both = np.concatenate([n[used, None], s[used]], 1)
            columns = [np.full(both.size, p), np.repeat(used, width + 1), np.tile(np.arange(width + 1) - 1, len(used)), both.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "place", "total"])

    summed = blocks.select("body").mapInArrow(trimmed(run), "part long, entry long, place long, total long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))
    rows = np.array([tuple(r) for r in summed.collect()], np.int64).reshape(-1, 4)  # a number for each component of the codebooks
    out = []
    for p, book in enumerate(codebooks):
        own = rows[rows[:, 0] == p]
        count = np.zeros(len(book), np.int64)
        total = np.zeros(book.shape, np.int64)
        first = own[:, 2] < 0
        count[own[first, 1]] = own[first, 3]
        total[own[~first, 1], own[~first, 2]] = own[~first, 3]
        out.append(np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], book.astype(np.int64)).astype(book.dtype))
    return out


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of each kept vector, and the final codebooks of the parts."""
    kept = kept_vectors(vectors)
    types = dict(kept.dtypes)
    schema = f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"
    order = F.col("vec_id").asc_nulls_last(), F.col("embedding")
    found = kept.orderBy(*order).first()
    if found is None or not found["embedding"]:
        return vectors.sparkSession.createDataFrame([], schema), []
    width = len(found["embedding"])
    if width % PARTS:
        raise ValueError(f"vectors of {width} components cannot be cut into {PARTS} equal parts")
    kept = kept.where(F.size("embedding") == width)
    first = kept.orderBy(*order).limit(ENTRIES)
    largest = kept.agg(F.max(F.array_max(F.transform("embedding", lambda c: F.abs(c.cast("double")))))).first()[0] * SCALE + 1
    if 16 * largest * largest * width / PARTS >= 2.0**63:
        raise ValueError("components are too large for errors of 64 bits")
    kind = "float64" if 16 * largest * largest * width / PARTS < 2.0**53 else "int64"
    blocks = written(planted(kept, width, kind), "trees")
    start = np.array([r[0] for r in first.select(whole(F.col("embedding")).alias("whole")).collect()], np.int64).astype(kind)
    codebooks = np.split(start, PARTS, 1)
    for _ in range(rounds):
        codebooks = _round(blocks, codebooks)
    sent = vectors.sparkSession.sparkContext.broadcast(codebooks)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(max(ENTRIES, 1))], object)
        for batch in batches:
            for i, body in enumerate(batch.column("body")):
                text, error = "", 0
                for tree, book in zip(unpacked(body), sent.value, strict=True):
                    code, _, _ = tree.assigned(book)
                    gap = tree.points - book[code[tree.order]]
                    own = np.empty(len(code), np.int64)
                    own[tree.order] = (gap * gap).sum(1)
                    text, error = text + digits[code], error + own
                flat = [batch.column(c).slice(i, 1).flatten() for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*flat, pa.array(text, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(trimmed(run), schema), codebooks


def codebooks_sha256(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for book in codebooks for x in book.ravel()).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codebooks = compress(table(spark, sf_dir, "embeddings"))
    codes = written(codes.select("vec_id", F.coalesce("label", F.lit(0)).alias("label"), F.col("label").isNull().alias("unlabelled"), "code", "error"), "codes")
    errors = codes.groupBy("label", "unlabelled").agg(F.sum("error").alias("label_error"))
    keyed = lambda df: df.withColumn("key", F.struct("label", "unlabelled"))
    joined = looked_up(keyed(codes), keyed(errors).select("key", "label_error"), "key", SALTS, by=["vec_id"])
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(codebooks)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one after another, each entry compared with each part."""
    width = f"(len(embedding) // {PARTS})"
    out = [
        f"""with v as materialized (select row_number() over (order by vec_id nulls last, embedding) r, vec_id, label, embedding from embeddings
where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as materialized (select r, p, list_transform(embedding[p * {width} + 1 : (p + 1) * {width}], lambda x: floor({SCALE} * x::double)) c from v, unnest(range({PARTS})) t(p)),
k0 as materialized (select p, r - 1 e, c from x where r <= {ENTRIES})"""
    ]
    for i in range(ROUNDS + 1):
        out.append(f"""a{i} as materialized (select r, p, any_value(x.c) c, min((list_inner_product(x.c, x.c) - 2 * list_inner_product(x.c, k.c) + list_inner_product(k.c, k.c))::bigint * {ENTRIES} + e) m from x join k{i} k using (p) group by r, p)""")
        if i < ROUNDS:
            out.append(f"""k{i + 1} as materialized (select p, e, coalesce(n.c, k.c) c from k{i} k left join (select p, e, list(f order by i) c from (select p, e, i, floor(sum(c[i]) / count(*)) f from (select p, m % {ENTRIES} e, c, unnest(range(1, len(c) + 1)) i from a{i}) group by p, e, i) group by p, e) n using (p, e))""")
    last = ROUNDS
    out.append(f"""d as (select r, string_agg(format('{{:02x}}', m % {ENTRIES}), '' order by p) code, sum(m // {ENTRIES})::bigint error from a{last} group by r),
h as (select sha256(string_agg(s, ',' order by p, e)) codebooks_sha256 from (select p, e, array_to_string(list_transform(c, lambda x: x::bigint::varchar), ',') s from k{last}))
select vec_id, code, error, sum(error) over (partition by label)::bigint label_error, codebooks_sha256 from d join v using (r), h""")
    return ",\n".join(out)


OP11_SQL = _sql()
