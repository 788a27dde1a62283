"""SimHash near-duplicates by pigeonring filtering.

A text's fingerprint has 64 bits; a bit is set if it is in over half of the text's shingle
hashes (XXH64, seed 42, of four lower-cased words joined by a space). Texts whose
fingerprints differ in at most ``MOST`` bits link; the result is components over links.

The 64 bits lie as a ring of ``RING`` segments. If two fingerprints differ in at most ``MOST``
bits, then some segment starts a chain round the ring in which the first n segments together
differ in at most n * MOST / RING bits, for every n. So that segment is equal and
the next one differs in one bit at most:

1. ``keyed``: each distinct fingerprint goes to a key for every segment and each half of
   the next one, as at least one half is equal too.
2. ``linked``: keys that many share are dealt to pairs of blocks of ``BLOCK`` fingerprints, each a group
   of its own. Within a group candidates pass the budgets of the chain segment by segment, then the
   whole Hamming check. A group of n gives at most n - 1 edges, from each fingerprint to the
   least of its component there, so that no group's pairs are listed.
3. Components over those edges; equal fingerprints are one node throughout.

A text without words, empty or null has fingerprint zero, linked like any other. With fewer than
four words the whole sequence is the only shingle. Very long texts are taken whole, their hashes in
slices. A null doc_id keeps its row and is no component's least id unless there is no other. Repeated
rows each keep a row. An empty table has no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import buckets, looked_up, small_batches, small_enough, table, trimmed, written
from flowloom.llm.graph import components

#: Words of a shingle, the seed of its hash, and the most bits in which linked fingerprints differ.
SHINGLE, SEED, MOST = 4, 42, 4
#: Segments of the ring; one more than MOST, so that a chain's first segment is equal.
RING = 5
#: Fingerprints of a block; a group has two blocks at most.
BLOCK = 1024
#: Hashes, and pairs of fingerprints, that are taken at a time.
SLICE, PAIRS = 1 << 16, 1 << 20
SALTS = 32
_U = np.uint64

#: First bit and width of each segment.
_WIDTH = [64 // RING + (i < 64 % RING) for i in range(RING)]
_FIRST = [sum(_WIDTH[:i]) for i in range(RING)]
_MASK = np.array([((1 << w) - 1) << a for a, w in zip(_FIRST, _WIDTH, strict=True)], np.uint64)
#: Bits of a key that hold the segment and the half.
_VALUE = 20


def fingerprint(text: bytes | None) -> int:
    import xxhash

    words = (text or b"").lower().split()  # of bytes: A-Z alone, parted by space and tab to return
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum(np.array([len(w) + 1 for w in words], np.int64)) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    first, last = start[:n].tolist(), end[-n:].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, SLICE):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[i : i + SLICE], last[i : i + SLICE], strict=True)], _U)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, mark) of each row; ``mark``: the fingerprint as a signed number."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            marks = np.array([fingerprint(t.as_py()) for t in texts], _U)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks.view(np.int64))], names=["doc_id", "mark"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), "doc_id long, mark long")


def _bits(mark: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(mark, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def keyed(marks: DataFrame) -> DataFrame:
    """(key, mark): the key holds a segment's number, which half of the next one, and the bits of both."""
    mark, keys = F.col("mark"), []
    for i in range(RING):
        after = (i + 1) % RING
        half = _WIDTH[after] // 2
        for h, (first, width) in enumerate(((_FIRST[after], half), (_FIRST[after] + half, _WIDTH[after] - half))):
            value = F.shiftleft(_bits(mark, _FIRST[i], _WIDTH[i]), width).bitwiseOR(_bits(mark, first, width))
            keys.append((value + F.lit((2 * i + h) << _VALUE)).cast("int"))
    return marks.select(F.explode(F.array(*keys)).alias("key"), "mark")


def _dealt(keys: DataFrame) -> DataFrame:
    """(key, low, high, mark): groups of two blocks at most, so that each pair of a key meets in one."""
    sizes = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "blocks")
    if sizes.isEmpty():
        return keys.select("key", F.lit(0).alias("low"), F.lit(0).alias("high"), "mark")
    joined = keys.join(F.broadcast(sizes), "key", "left") if small_enough(sizes, 8) else looked_up(keys, sizes, "key", SALTS)
    blocks = F.coalesce("blocks", F.lit(1))
    own = joined.select("key", "mark", blocks.alias("blocks"), F.pmod(F.xxhash64("mark"), blocks).cast("int").alias("own"))
    # With several blocks a block meets each other one, which holds its own pairs as well.
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own")))
    met = own.select("key", "mark", "own", F.explode(others).alias("other"))
    return met.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "mark")


def near(marks: np.ndarray, start: int) -> np.ndarray:
    """Which fingerprints of each group (a row) link, as far as the chain from segment ``start`` on shows."""
    apart = marks[:, :, None] ^ marks[:, None, :]
    out = np.zeros(apart.shape, bool)
    pairs = apart.ravel()
    alive = np.arange(len(pairs))
    differ = np.zeros(len(pairs), np.uint8)
    for n in range(RING):
        differ = differ + np.bitwise_count(pairs & _MASK[(start + n) % RING])
        passes = np.flatnonzero(differ <= (n + 1) * MOST // RING)  # after the last segment: the whole Hamming check
        alive, pairs, differ = alive[passes], pairs[passes], differ[passes]
    out.ravel()[alive] = True
    return out


def roots(links: np.ndarray) -> np.ndarray:
    """The first place that each place of a group reaches by its links."""
    groups, n, _ = links.shape
    label = np.broadcast_to(np.arange(n), (groups, n)).copy()
    while True:
        least = np.where(links, label[:, None, :], n).min(2)
        least = np.minimum(least, label)
        least = np.take_along_axis(least, least, 1)
        if (least == label).all():
            return label
        label = least


def _edges(group: np.ndarray, start: np.ndarray, mark: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges within groups of rows; ``group``: where each begins, and the end."""
    size = np.diff(group)
    for n in np.unique(size[size > 1]).tolist():
        for s in range(RING):
            at = group[:-1][(size == n) & (start[group[:-1]] == s)]
            step = max(1, PAIRS // (n * n))
            for i in range(0, len(at), step):
                own = mark[at[i : i + step, None] + np.arange(n)]
                root = roots(near(own, s))
                moved = root != np.arange(n)
                if moved.any():
                    yield own[moved], np.take_along_axis(own, root, 1)[moved]


def linked(marks: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct ``marks``; their components are those of all links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 4
        for batch in _closed(batches):
            if batch is not None:
                rest = [np.concatenate([r, np.asarray(batch.column(c)).astype(np.int64)]) for r, c in zip(rest, ("key", "low", "high", "mark"), strict=True)]
            key, low, high, mark = rest
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])) if len(key) else np.zeros(0, np.int64)
            if batch is None:
                new = np.append(new, len(key))
            elif len(new) < 2:
                continue
            done = new[-1] if len(new) else 0
            for a, b in _edges(new, key >> (_VALUE + 1), mark[:done].view(_U)) if len(new) > 1 else ():
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
            rest = [r[done:] for r in rest]

    small_batches(marks.sparkSession)
    dealt = _dealt(written(keyed(marks), "keys")).repartition(buckets(marks.sparkSession), "key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt.mapInArrow(trimmed(run), "a long, b long")


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs(doc_id, text)``."""
    rows = written(fingerprints(docs), "fingerprints")
    marks = written(rows.groupBy("mark").agg(F.min("doc_id").alias("least")), "marks")
    edges = written(linked(marks.select("mark")), "links")
    known = marks.select("mark", F.col("least").alias("component_id"))
    if not edges.isEmpty():
        grouped = written(components(edges), "components").withColumnRenamed("node", "mark").join(marks, "mark")
        least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
        found = looked_up(grouped.select("mark", "component"), least, "component", SALTS, "inner").select("mark", "component_id")
        known = written(found.union(marks.join(found, "mark", "left_anti").select("mark", "least")), "known")
    joined = rows.join(known, "mark")  # a mark that very many texts have is split at run time
    return joined.select("doc_id", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
