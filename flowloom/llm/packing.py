"""Best-fit packing planned over a histogram of lengths.

1. Each document is tokenised once; longer ones are cut into pieces of ``SIZE``
   tokens. One small row a piece (no ids) goes to a table in the shared folder.
2. ``plan`` packs the histogram, at most ``SIZE`` counts, not the pieces: lengths
   from long to short, each into the open sequences with the least room that still
   fits. Sequences with equal room are one group, so a step moves whole groups.
   The plan is a list of runs (length, ranks [first, end), sequences, place); its
   size depends on ``SIZE`` alone, not on the data.
3. Pieces get a rank within their length and take the planned slot by joining on
   (length, rank). Ranks are counted in salted buckets, so a length that a third
   of all pieces share is no single task's work.

Nulls: a null text is empty and gets its end token only. Repeated rows are packed
as often as they come. A null doc_id stays null. Lengths beyond the histogram do
not exist, as pieces are cut.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.llm.common import small_batches, table, trimmed, written

SIZE = 4096
#: Token that ends each document.
END = 1
#: Buckets in which ranks of one length are counted.
SALTS = 64
#: Other chunks, and stems, kept with their ids in a worker; beyond, a table starts anew with those of the batch at hand.
KEPT, KEPT_STEMS = 300_000, 300_000
#: Runs of ids gathered at once: bounds what very long texts take.
SLAB = 1 << 16


def _gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``pool`` that ``numbers`` name, one behind the other; and where each begins, with the end of all."""
    edges = np.zeros(len(numbers) + 1, np.int64)
    np.cumsum(lengths[numbers], out=edges[1:])
    out = np.empty(edges[-1], pool.dtype)
    for i in range(0, len(numbers), SLAB):
        own, to = numbers[i : i + SLAB], edges[i : i + SLAB + 1]
        at = np.repeat(starts[own] - to[:-1], lengths[own])
        at += np.arange(to[0], to[-1])
        out[to[0] : to[-1]] = pool[at]
    return out, edges


class Chunks(dict):
    """Ids (little-endian 32-bit) of chunks between spaces and line feeds.

    The tokenizer drops white space and never merges across it, and no rule of its
    normaliser or splitter looks beyond it, so a text's ids are its chunks' ids.
    Likewise a plain chunk, one of letters and then marks of ``TAIL``, is two
    pre-tokens. Stems that are not known yet are encoded many to a text and parted
    at the tokens that end a word, which each pre-token's last one is and no other.

    Arrow parts the texts of a batch and numbers their chunks, stems and tails; only
    different stems and tails, and other chunks, are looked up one by one. Stems and
    tails have their ids in ``stems``, other chunks here.
    """

    TAIL = ".,;:!?*#$%&|"
    #: Latin-1 letters are composed, and their small letters are the library's.
    LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(file)
        self.model.no_truncation()
        self.model.no_padding()
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.stems: dict[str, bytes] = {"": b""}
        self[""] = b""

    def _plain(self, chunks: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Which chunks are plain; the stems of these in small letters, and their tails."""
        tails, stems = pc.utf8_ltrim(chunks, self.LETTERS), pc.ascii_rtrim(chunks, self.TAIL)
        size = pc.utf8_length(stems)
        plain = pc.and_(pc.equal(pc.ascii_rtrim(tails, self.TAIL), ""), pc.and_(pc.greater(size, 0), pc.less(size, 64)))
        return plain, pc.utf8_lower(stems.filter(plain)), tails.filter(plain)

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def _learn_stems(self, words: list[str], run: int = 200) -> None:
        groups = [words[i : i + run] for i in range(0, len(words), run)]
        for group, e in zip(groups, self.model.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) == len(group):
                raw, cuts = ids.tobytes(), cuts.tolist()
                self.stems.update(zip(group, (raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True))
            else:
                self.stems.update(zip(group, self._each(group), strict=True))

    def _looked_up(self, own: list[str], tails: list[str], rest: list[str]) -> list[bytes]:
        """Ids of stems, tails and other chunks, one behind the other; new ones are learnt."""
        if len(self) > KEPT:
            kept = {c: self[c] for c in ("", *rest) if c in self}
            self.clear()
            self.update(kept)
        if len(self.stems) > KEPT_STEMS:
            self.stems = {w: self.stems[w] for w in itertools.chain([""], own, tails) if w in self.stems}
        new = list(itertools.filterfalse(self.__contains__, rest))
        self.update(zip(new, self._each(new), strict=True))
        self._learn_stems(list(itertools.filterfalse(self.stems.__contains__, own)))
        new = list(itertools.filterfalse(self.stems.__contains__, tails))
        self.stems.update(zip(new, self._each(new), strict=True))
        return [*map(self.stems.__getitem__, own), *map(self.stems.__getitem__, tails), *map(self.__getitem__, rest)]

    def _pool(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``chunks``, one behind the other; and where each begins, with the end of all."""
        plain, own, tails = self._plain(chunks)
        own, tails, rest = own.dictionary_encode(), tails.dictionary_encode(), chunks.filter(pc.invert(plain))
        found = [b"", *self._looked_up(*(_strings(x) for x in (own.dictionary, tails.dictionary, rest)))]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        plain = plain.to_numpy(zero_copy_only=False)
        parts = np.zeros((len(chunks), 2), np.int64)  # of each chunk: its stem and tail, or itself and nothing
        first = 1 + len(own.dictionary)
        parts[plain, 0] = own.indices.to_numpy() + 1
        parts[plain, 1] = tails.indices.to_numpy() + first
        parts[~plain, 0] = np.arange(len(rest)) + first + len(tails.dictionary)
        ids, edges = _gathered(np.frombuffer(b"".join(found), "<u4"), np.cumsum(lengths) - lengths, lengths, parts.ravel())
        return ids, edges[::2]

    def ids(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        parts = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        chunks = parts.flatten().dictionary_encode()
        pool, at = self._pool(chunks.dictionary)
        ids, edges = _gathered(pool, at[:-1], np.diff(at), chunks.indices.to_numpy())
        ends = edges[np.cumsum(pc.list_value_length(parts).to_numpy())].tolist()
        for a, b in itertools.pairwise([0, *ends]):
            yield ids[a:b].tobytes()


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist


_held: dict[str, Chunks] = {}


def chunks(file: str) -> Chunks:
    if file not in _held:
        _held[file] = Chunks(file)
    return _held[file]


def pieces(docs: DataFrame, file: str, size: int = SIZE, end: int = END) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    last = np.asarray([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunks(file)
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), known.ids(batch.column("text")), strict=True):
                ids += last
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    out.append((doc, k, k * size, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(trimmed(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, long lengths first, over counts.

    Returns runs (length, first rank, end rank, first sequence, per sequence,
    offset): ranks of the length go to consecutive sequences, ``per sequence`` of
    them into each, from ``offset`` on.
    """
    import heapq

    runs: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: [(first sequence, sequences)]
    rooms: list[int] = []  # sorted keys of room
    made = 0
    import bisect

    def put(free: int, first: int, n: int) -> None:
        if n and free:
            if free not in room:
                room[free] = []
                bisect.insort(rooms, free)
            heapq.heappush(room[free], (first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):  # no open sequence fits: open what is needed
                per = size // length
                put(size, made, n := -(-left // per))
                made += n
                continue
            free = rooms[i]
            first, n = heapq.heappop(room[free])
            if not room[free]:
                del room[free]
                rooms.pop(i)
            per = free // length
            full = min(n, left // per)
            if full:
                runs.append((length, rank, rank + full * per, first, per, size - free))
                put(free - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            elif left:  # fewer than fill one sequence
                runs.append((length, rank, rank + left, first, left, size - free))
                put(free - left * length, first, 1)
                rank, left, full = rank + left, 0, 1
            put(free, first + full, n - full)
    return runs


def ranked(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """``rows`` with ``rank``: from 0 within each length, counted in salted buckets."""
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = rows.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "__salt", (F.sum("n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "start")) - 1
    return rows.withColumn("own", own).join(before, ["length", "__salt"]).withColumn("rank", F.col("before") + F.col("own")).drop("own", "before", "__salt")


def pack(docs: DataFrame, file: str, size: int = SIZE, end: int = END) -> DataFrame:
    """Rows of ``pieces`` with sequence_id and offset."""
    spark = docs.sparkSession
    rows = written(pieces(docs, file, size, end), "pieces")
    histogram = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most `size` rows
    runs = plan(histogram, size)
    slots = spark.createDataFrame(runs or [(0, 0, 0, 0, 1, 0)], "length long, rank_first long, rank_end long, sequence_first long, per_sequence long, offset_first long")
    put = ranked(rows).join(F.broadcast(slots.withColumnRenamed("length", "slot_length")), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("rank_first")) & (F.col("rank") < F.col("rank_end")))
    at = F.col("rank") - F.col("rank_first")
    return put.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.expr("sequence_first + (rank - rank_first) div per_sequence").alias("sequence_id"),
        (F.col("offset_first") + (at % F.col("per_sequence")) * F.col("length")).alias("offset"),
    )


def word_model(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a packed sequence."""
    return pack(table(spark, sf_dir, "documents"), word_model())
