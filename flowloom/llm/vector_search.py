"""Nearest neighbours by randomly rotated one-bit codes.

Index: each vector, less a centre fitted on a bounded sample, is rotated by a
random orthogonal matrix and kept as its signs (packed bits), its length, and the
scalar product of its direction with that of the signs. A query's product with a
vector's direction is estimated as its product with the signs over that scalar;
the estimate errs by at most ``BOUND`` standard errors (for all but a fraction of
about exp(-BOUND^2 / 2)), which bounds the distance from below. The query's side is
``BITS`` planes of bits, so a product is as many counts of bits in common. Only vectors
whose lower bound does not pass the k-th exact distance so far are reranked on the
original vectors, in double precision.

Every row is indexed. Vectors lie in blocks by a hash of their id, each of them once;
a task holds one block of bounded bytes and lets all queries, which go to every block,
stream by. A query's k nearest come from the k of every block.

Vectors that are null, zero, of another dimension than most, or hold null or
non-finite components take no part, and rows with a null id neither. Ties go to
the smaller id. Rows that repeat a query's id repeat its result once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.llm.common import buckets, small_batches, table, trimmed, written

#: Most vectors of a block and their bytes, queries compared at a time, rows that the centre is fitted on, standard errors of the bound.
VECTORS, BLOCK_BYTES, QUERIES, SAMPLE, BOUND = 8192, 32 << 20, 64, 10_000, 4.0
#: Bits that a query's components are rounded to.
BITS = 6
SEED = 7


def usable(rows: DataFrame, column: str) -> DataFrame:
    ok = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(column, lambda x: x != 0)
    return rows.where(F.col(column).isNotNull() & (F.size(column) > 0)).where(ok)


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Coder:
    """The fitted part of the index: centre and rotation."""

    def __init__(self, centre: np.ndarray):
        self.centre, self.dim = centre, len(centre)
        self.turn = rotation(self.dim)

    def rotated(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rotated directions and lengths."""
        x = (x - self.centre) @ self.turn
        length = np.sqrt((x * x).sum(1))
        return x / np.maximum(length, 1e-300)[:, None], length

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs, lengths, and products of the direction with the signs' direction."""
        unit, length = self.rotated(x)
        return np.packbits(unit > 0, axis=1), length, np.abs(unit).sum(1) / np.sqrt(self.dim)

    def bounds(self, codes: np.ndarray, length: np.ndarray, product: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated squared distances and lower bounds, queries by vectors, from packed codes alone."""
        unit, own = self.rotated(queries)
        low = unit.min(1)
        step = np.maximum((unit.max(1) - low) / (2**BITS - 1), 1e-300)
        level = np.rint((unit - low[:, None]) / step[:, None]).astype(np.uint8)
        words = _words(codes)
        ones = np.bitwise_count(words).sum(1, dtype=np.int64)
        common = np.zeros((len(queries), len(codes)), np.int64)
        for j in range(BITS):
            plane = _words(np.packbits((level >> j) & 1, axis=1))
            for w in range(words.shape[1]):
                common += np.bitwise_count(plane[:, w, None] & words[None, :, w]).astype(np.int64) << j
        inner = low[:, None] * ones + step[:, None] * common  # with the set bits
        signs = (2 * inner - unit.sum(1)[:, None]) / np.sqrt(self.dim)
        safe = np.maximum(product, 1e-12)
        about = signs / safe
        rounding = step[:, None] * np.sqrt(ones / 3 / self.dim) / safe  # a standard error: step / sqrt(12) a set bit, twice
        error = BOUND * (np.sqrt(np.maximum(1 - safe**2, 0)) / safe / np.sqrt(max(self.dim - 1, 1)) + rounding) + 1e-5
        scale = 2 * own[:, None] * length[None]
        base = own[:, None] ** 2 + length[None] ** 2
        return base - scale * about, base - scale * np.minimum(about + error, 1.0 + 1e-9)


def _words(codes: np.ndarray) -> np.ndarray:
    """Rows of packed bits as numbers of 64 bits."""
    out = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), np.uint8)
    out[:, : codes.shape[1]] = codes
    return out.view(np.uint64)


def nearest(coder: Coder, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, length: np.ndarray, product: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(query, vector, distance) of the k nearest in a block."""
    about, least = coder.bounds(codes, length, product, queries)
    exact = lambda q, at: np.sqrt(((vectors[at] - q) ** 2).sum(1))
    for i, q in enumerate(queries):
        other = np.flatnonzero(ids != query_ids[i])
        if not len(other):
            continue
        guess = other if len(other) <= k else other[np.argpartition(about[i, other], k - 1)[:k]]
        worst = exact(q, guess).max()
        near = other[least[i, other] <= worst * worst * (1 + 1e-6) + 1e-12] if len(other) > k else other
        near = np.union1d(near, guess)
        d = exact(q, near)
        for j in np.lexsort((ids[near], d))[:k]:
            yield int(query_ids[i]), int(ids[near[j]]), float(d[j])


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows of ``vectors(vec_id, embedding)``.

    ``queries`` has the same columns; a query's own id is no candidate.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    clean = lambda rows: usable(rows.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")), "embedding")
    rows = clean(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    dim, n = sizes[0]
    rows = rows.where(F.size("embedding") == dim)
    asked = clean(queries).where(F.size("embedding") == dim).dropDuplicates(["vec_id"])
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))).select("embedding").toArrow()["embedding"]
    centre = np.stack(sample.to_numpy()).mean(0) if len(sample) else np.zeros(dim)
    coder = Coder(centre)

    def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        return np.asarray(column.flatten()).reshape(len(column), dim)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits, length, product = coder.codes(matrix(batch.column("embedding")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(product)], names=[*batch.schema.names, "code", "length", "product"])

    index = rows.mapInArrow(trimmed(encode), "vec_id long, embedding array<double>, code binary, length double, product double")
    blocks = -(-n // max(1, min(VECTORS, BLOCK_BYTES // (8 * dim))))
    asked = written(asked, "queries")
    block = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = index.withColumn("block", block).withColumn("turn", F.lit(0))
    right = asked.select("vec_id", "embedding", F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("length"), F.lit(0.0).alias("product"), each.alias("block"), F.lit(1).alias("turn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, [], None
        for batch in batches:
            blocks, turn = np.asarray(batch.column("block")), np.asarray(batch.column("turn"))
            edge = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (turn[1:] != turn[:-1]), [True]])) if len(blocks) else np.zeros(1, int)
            out: list[tuple[int, int, float]] = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                part = batch.slice(a, b - a)
                if blocks[a] != at:
                    at, parts, held = blocks[a], [], None
                ids, x = np.asarray(part.column("vec_id")), matrix(part.column("embedding"))
                if turn[a] == 0:
                    codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
                    parts.append((ids, x.copy(), codes, np.array(part.column("length")), np.array(part.column("product"))))
                    continue
                if parts:
                    held, parts = tuple(map(np.concatenate, zip(*parts, strict=True))), []
                for i in range(0, len(ids) if held else 0, QUERIES):
                    out.extend(nearest(coder, *held, ids[i : i + QUERIES], x[i : i + QUERIES], k))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    dealt = left.unionByName(right).repartition(buckets(spark), "block").sortWithinPartitions("block", "turn", "vec_id")
    found = dealt.mapInArrow(trimmed(run), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every row whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 100 = 0"), 10)
