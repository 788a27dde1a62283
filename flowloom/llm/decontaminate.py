"""Benchmark decontamination with one Aho-Corasick automaton over word windows.

Test questions and answers are normalised to words (A-Z lower-cased; every byte
outside ``[0-9a-z\\x80-\\xff]`` parts words). Each word of the benchmark becomes
a letter of the automaton's alphabet, every other word the letter 0, so that a
text is scanned once, a word a step. Hits are mapped back to code points of the
original text.

The automaton is broadcast. Its size is bounded: the benchmark is dealt into
blocks of at most ``BLOCK_BYTES`` of text, one automaton a block; with a single
block (any usual benchmark) each text is scanned exactly once. A longer item lies in
several blocks, which overlap by a window less one word.

Nulls: a null text has no words. Items with a null id or without words take no
part. Repeated rows each get a row of their own. An empty benchmark hits nothing, an
empty table has no rows. Very long texts are scanned whole, a word a step, and so are
items: time and memory grow with their words, not with the square of their hits. Columns may have any names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import columns, fresh, mapped, small_batches, table

#: Consecutive words of an item that make a window.
WINDOW = 13
#: Bytes of benchmark text in one automaton; about 150 MB of states at most.
BLOCK_BYTES = 1_000_000
#: Words from which each is two letters.
FANOUT = 4096
#: Separators become a space, capitals small letters, all other bytes stay.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


class Scanner:
    """An automaton over the windows of some (item_id, text) rows.

    A word is a letter; where there are over ``FANOUT`` words it is two, a first and
    a second one of alphabets of their own, so that no state has many children.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        import ahocorasick

        numbers: dict[bytes, int] = {}
        texts = [(item, [numbers.setdefault(w, len(numbers)) for w in normal_words(text)]) for item, text in items]
        self.width = 1 if len(numbers) <= FANOUT else 2
        base = math.isqrt(len(numbers)) + 1
        code = (lambda i: chr(i + 1)) if self.width == 1 else (lambda i: chr(1 + i // base) + chr(1 + base + i % base))
        codes = [code(i) for i in range(len(numbers))]
        self.letters = dict(zip(numbers, codes, strict=True))
        found: dict[str, set[str]] = {}
        for item, own in texts:
            for i in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault("".join([codes[x] for x in own[i : i + window]]), set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for key, ids in found.items():
            self.automaton.add_word(key, (len(key) // self.width, tuple(ids)))
        self.live = bool(found)
        if self.live:
            self.automaton.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words in the text, the hit runs of words (first, last), and the items."""
        own = normal_words(text)
        runs: list[list[int]] = []
        items: set[str] = set()
        if self.live and own:
            get, other, width = self.letters.get, "\0" * self.width, self.width
            for end, (length, ids) in self.automaton.iter("".join([get(w, other) for w in own])):
                end //= width
                start = end - length + 1
                while runs and start <= runs[-1][1] + 1:
                    start = min(start, runs.pop()[0])
                runs.append([start, end])
                items.update(ids)
        return len(own), [(a, b) for a, b in runs], items


def original_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as spans of code points in the original text."""
    if not runs:
        return []
    import numpy as np

    data = np.frombuffer(text, np.uint8)
    inner = np.zeros(len(data) + 2, np.int8)
    inner[1:-1] = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
    start, end = np.flatnonzero(np.diff(inner) == 1), np.flatnonzero(np.diff(inner) == -1)
    chars = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])  # code points before each byte
    first, last = np.array(runs, np.int64).T
    return list(zip(chars[start[first]].tolist(), chars[end[last]].tolist(), strict=True))


def _parts(text: bytes, window: int) -> Iterator[bytes]:
    """A text in parts of about ``BLOCK_BYTES`` that hold each of its windows."""
    if len(text) <= BLOCK_BYTES:
        yield text
        return
    own = normal_words(text)
    first, size = 0, 0
    for i, word in enumerate(own):
        size += len(word) + 1
        if size >= BLOCK_BYTES and i + 1 < len(own) and i - first >= window:
            yield b" ".join(own[first : i + 1])
            first = i + 2 - window
            size = sum(len(w) + 1 for w in own[first : i + 1])
    yield b" ".join(own[first:])


def _blocks(benchmark: DataFrame, window: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks of bounded size, read partition by partition."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).where("item is not null and text is not null")
    block: list[tuple[str, bytes]] = []
    size = 0
    for item, text in rows.toLocalIterator():
        for part in _parts(bytes(text), window):
            if size and size + len(part) > BLOCK_BYTES:
                yield block
                block, size = [], 0
            block.append((item, part))
            size += len(part)
    yield block


#: What a scan finds in a text.
_FOUND = "struct<n_words:long,hits:array<struct<first:long,last:long>>,items:array<string>,spans:array<struct<start:long,end:long>>>"
_PLACE = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_KIND = pa.struct([("n_words", pa.int64()), ("hits", _PLACE), ("items", pa.list_(pa.string())), ("spans", _SPAN)])


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, prefix: str = "", spans: bool = True) -> DataFrame:
    """All columns of ``docs`` and n_words, n_hit, items, hit_spans, contaminated.

    ``contaminated``: at least one word and a twentieth of the words are hit.
    Without ``spans``, hit_spans are null. ``prefix`` comes before these names; columns of ``docs`` that have them are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    made = [prefix + c for c in ("n_words", "n_hit", "items", "hit_spans", "contaminated")]
    docs = docs.drop(*made)
    name = fresh("__found", docs)
    out = docs
    for block in _blocks(benchmark, window):
        sent = spark.sparkContext.broadcast(block)  # of a bounded size
        held: list[Scanner] = []

        def run(batches: Iterator[pa.RecordBatch], sent=sent, held=held) -> Iterator[pa.RecordBatch]:
            if not held:
                held.append(Scanner(sent.value, window))
            for batch in batches:
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                before = batch.column(name).to_pylist() if name in batch.schema.names else [None] * len(texts)
                found = []
                for text, old in zip(texts, before, strict=True):
                    n, runs, ids = held[0].scan(text)
                    if old:  # a further block: its hits beside those found before
                        runs, ids = _joined([*((x["first"], x["last"]) for x in old["hits"]), *runs]), {*old["items"], *ids}
                    found.append({"n_words": n, "hits": [{"first": a, "last": b} for a, b in runs], "items": sorted(ids), "spans": [{"start": a, "end": b} for a, b in original_spans(text or b"", runs)] if spans else None})
                rest = [c for c in batch.schema.names if c != name]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(found, _KIND)], names=[*rest, name])

        out = mapped(out, run, (name, _FOUND))
    n_hit = F.aggregate(f"{name}.hits", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    n_words = F.col(f"{name}.n_words")
    found = [n_words, n_hit, F.col(f"{name}.items"), F.col(f"{name}.spans"), (n_hit > 0) & (20 * n_hit >= n_words)]
    return out.select(*columns(docs), *(x.alias(c) for x, c in zip(found, made, strict=True)))


def without_spans(text: Column, spans: Column, mark: str = "[REMOVED]") -> Column:
    """``text`` with ``mark`` in place of each span; a word there, so that what is left on either side makes no new window."""
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text).cast("long")))
    return F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))), mark)


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of several scans as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def items_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its words, hit words and items; see the module."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), spans=False)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        "contaminated",
    )
