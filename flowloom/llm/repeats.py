"""Removal of repeated byte strings by depth-limited radix passes.

Every window of ``DEPTH`` bytes is a suffix cut at the threshold; the passes order
windows digit by digit and stop at that depth, so that equal groups are exactly the
repeated windows. The most significant digit is not a window's first bytes but its
least ``DIGIT``-gram by hash (both are functions of the window alone, so equal
windows always meet): neighbouring windows then share their digit, and one record
stands for a run of about fourteen windows.

1. Digits: packed fingerprints of all digits are dealt to buckets; digits that only
   one document holds end here, with most of the text.
2. Runs: for digits that are left, the hash of the run's whole text. A run equal to
   one of a document with a smaller id is repeated as a whole; a digit whose runs
   are all equal ends here.
3. Windows: runs that share a digit but not the text (the ends of repeated passages)
   are split into windows, and whole windows are compared.

Texts are parted into units of about ``UNIT`` bytes. Answers go back to the unit that
asked, so no pass holds more than one unit's texts, and a key that a third of the rows
share costs one record a unit. Units lie in a table in the warehouse, bucketed by unit,
and are read by each pass without a shuffle; it is dropped at the end. Whether windows are
equal is decided by hashes of 64 bits alone, over mixed blocks: of m windows compared one by
one, m^2 / 2^65 are expected to be taken for others.

Nulls: a null text is empty. A text shorter than ``DEPTH`` loses nothing. An empty
table has no rows. Very long texts are hashed in segments. A row with a null doc_id is neither smaller nor larger
than any other: nothing is removed from it or because of it. Rows that repeat an id
remove nothing from one another. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import kernels as k
from flowloom.llm.common import buckets, small_batches, table, tidy, tidy_both, trimmed, written

#: Bytes of a repeated string, and of the digit within it.
DEPTH, DIGIT = 50, 24
#: Most bytes of a text that are hashed at a time.
SEGMENT = 1 << 19
#: Fingerprints that a task holds before it sends them.
HELD = 1_000_000
#: Bytes of text, or rows, of a unit: what a pass holds at a time. A longer text is a unit of its own.
UNIT, UNIT_ROWS = 8 << 20, 50_000
_U = np.uint64
_SHIFT = _U(16)
_MESSAGE = "bucket int, part long, kind int, body binary"


def _segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """First text, bytes, offsets, and the place in the text where the bytes begin."""
    for i, j, slab, at in k.slabs(data, offsets):
        if j - i > 1 or len(slab) <= SEGMENT:
            yield i, slab, at, 0
        else:  # a very long text: parts that overlap by a window less one byte
            for a in range(0, len(slab) - DEPTH + 1, SEGMENT):
                part = slab[a : a + SEGMENT + DEPTH - 1]
                yield i, part, np.array([0, len(part)]), a


class Runs:
    """Runs of windows with one digit: owner text, first window, windows, digit, the digit's place in the run."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n, width = len(data), DEPTH - DIGIT + 1
        self.n = 0
        self.owner = self.start = self.count = self.place = np.zeros(0, np.int64)
        self.digit = np.zeros(0, _U)
        if n < DEPTH:
            return
        at = np.arange(n - DIGIT + 1)
        sums = k.prefix_sums(data)
        gram = k.mix((sums[DIGIT:] - sums[:-DIGIT]) * k._inverses[: n - DIGIT + 1])  # where windows meet, not whether they are equal
        key = (gram & ~_U(0xFFFFF)) | at.astype(_U)
        least, size = key, 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(key) - width + 1], least[width - size :])
        place = (least & _U(0xFFFFF)).astype(np.int64)  # of the digit, for each window
        valid = np.ones(n - DEPTH + 1, bool)
        for end in offsets[1:].tolist():
            valid[max(0, end - DEPTH + 1) : end] = False
        window = np.flatnonzero(valid)
        if not len(window):
            return
        own = place[window]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        self.start, self.count = window[first], np.diff(np.append(first, len(window)))
        self.n = len(first)
        anchor = own[first]
        self.digit = gram[anchor] >> _SHIFT
        self.owner = np.searchsorted(offsets, self.start, "right") - 1
        self.place = anchor - self.start

    def text(self, data: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Hash of the whole text of chosen runs, and of the digit's place in it."""
        start = self.start[chosen]
        return k.range_hash(data, start, start + self.count[chosen] + (DEPTH - 1)) + self.place[chosen].astype(_U) * _U(0x9E3779B97F4A7C15)


def _packed(digits: np.ndarray) -> bytes:
    """48-bit numbers in six bytes each."""
    return (digits >> _SHIFT).astype("<u4").tobytes() + (digits & _U(0xFFFF)).astype("<u2").tobytes()


def _unpacked(raw: bytes | memoryview) -> np.ndarray:
    n = len(raw) // 6
    return (np.frombuffer(raw, "<u4", n).astype(_U) << _SHIFT) | np.frombuffer(raw, "<u2", n, 4 * n).astype(_U)


def _messages(bucket: np.ndarray, part: int, kind: int, body) -> Iterator[tuple[int, int, int, bytes]]:
    """One message for each bucket; ``body`` packs the records at some places."""
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)) if len(bucket) else []
    for a, b in zip(edge[:-1], edge[1:], strict=True) if len(edge) else ():
        yield int(bucket[order[a]]), part, kind, body(order[a:b])


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "part", "kind", "body"])


def _least_by(keys: list[np.ndarray], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys and then id; and where each group of equal keys begins in it."""
    order = np.lexsort((docs, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in keys:
        new[1:] |= x[order[1:]] != x[order[:-1]]
    return order, new


# Pass 1: which digits are in several documents


def digit_messages(texts: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            for part, found in held.items():
                digit, owners = np.unique(np.concatenate(found), return_counts=True)  # once a document
                for kind in (0, 1):  # held by one document, by several
                    own = digit[(owners > 1) == bool(kind)]
                    yield _batch(list(_messages((own % _U(parts)).astype(np.int64), part, kind, lambda x, own=own: _packed(own[x]))))
            held.clear()

        for batch in batches:
            data, offsets = k.texts(batch.column("text"))
            part = np.asarray(batch.column("part"))
            known = ~np.asarray(batch.column("doc_id").is_null())
            for i, slab, at, _ in _segments(data, offsets):
                runs = Runs(slab, at)
                owner = runs.owner + i
                for p in k.distinct(part[owner]) if runs.n else ():
                    own = (part[owner] == p) & known[owner]
                    # A slab has fewer than 2^16 texts with windows, and a digit 48 bits.
                    pair = k.distinct((runs.owner[own].astype(_U) << _U(48)) | runs.digit[own]) & _U((1 << 48) - 1)
                    held.setdefault(int(p), []).append(pair)
                    size += len(pair)
            if size > HELD:
                yield from send()
                size = 0
        yield from send()

    return texts.mapInArrow(trimmed(run), _MESSAGE)


def shared_digits(messages: DataFrame) -> DataFrame:
    """Answers (part, kind, body): the digits of a partition that several documents hold."""

    def run(group: pa.Table) -> pa.Table:
        found = [_unpacked(b.as_buffer()) for b in group["body"]]
        size = [len(x) for x in found]
        digit = np.concatenate(found)
        many = np.repeat(np.asarray(group["kind"]), size)
        source = np.repeat(np.arange(len(found)), size)
        _, back, count = np.unique(digit, return_inverse=True, return_counts=True)
        keep = (count[back] > 1) | (np.bincount(back, many)[back] > 0)
        part = np.asarray(group["part"])
        return pa.Table.from_batches([_batch(_by_source(part, source, keep, lambda x: _packed(digit[x]), 1))])

    return messages.groupBy("bucket").applyInArrow(tidy(run), _MESSAGE).drop("bucket")


def _by_source(part: np.ndarray, source: np.ndarray, keep: np.ndarray, body, kind: int) -> list[tuple[int, int, int, bytes]]:
    """Answers to each message: what ``body`` packs of the kept records."""
    at = np.flatnonzero(keep)
    edge = np.searchsorted(source[at], np.arange(len(part) + 1))
    return [(0, int(part[i]), kind, body(at[edge[i] : edge[i + 1]])) for i in range(len(part)) if edge[i + 1] > edge[i]]


# Passes 2 to 4: a unit's texts with the answers so far


class Shared:
    """The runs of a segment whose digit several documents hold: owner in the unit, first window, windows, digit, text."""

    def __init__(self, first: int, place: int, slab: np.ndarray, runs: Runs, own: np.ndarray):
        self.base, self.slab = place, slab
        self.owner, self.start, self.count = runs.owner[own] + first, runs.start[own], runs.count[own]
        self.digit, self.text = runs.digit[own], runs.text(slab, own)

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each window of the chosen runs."""
        count = self.count[chosen]
        start = np.repeat(self.start[chosen] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return start, k.window_hash(self.slab, start, DEPTH)


class Asked:
    """The runs of one unit, judged as far as the answers go."""

    def __init__(self, texts: pa.Table, answers: pa.Table):
        kinds = np.asarray(answers["kind"]) if len(answers) else np.zeros(0, int)
        bodies = answers["body"]
        listed = lambda kind, read: k.distinct(np.concatenate([np.zeros(0, _U), *(read(bodies[int(i)].as_buffer()) for i in np.flatnonzero(kinds == kind))]))
        self.shared, self.repeated, self.split = (listed(kind, _unpacked) for kind in (1, 2, 3))
        self.windows = listed(4, lambda raw: np.frombuffer(raw, _U))
        self.known = ~np.asarray(texts["doc_id"].is_null())
        self.doc = np.asarray(texts["doc_id"].fill_null(0)).astype(np.int64)
        self.data, self.offsets = k.texts(texts["text"])
        self.segments = list(self._scan()) if len(self.shared) else []
        self._judge()

    @staticmethod
    def within(x: np.ndarray, known: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(x), bool)
        return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x

    def _scan(self) -> Iterator[Shared]:
        for i, slab, at, place in _segments(self.data, self.offsets):
            runs = Runs(slab, at)
            own = np.flatnonzero(self.within(runs.digit, self.shared) & self.known[runs.owner + i]) if runs.n else ()
            if len(own):
                yield Shared(i, int(self.offsets[i]) + place, slab, runs, own)

    def _judge(self) -> None:
        """For all runs with a shared digit: the least id of equal runs here, and whether the digit has other runs here."""
        join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
        digit, text = join((s.digit for s in self.segments), _U), join((s.text for s in self.segments), _U)
        doc = join((self.doc[s.owner] for s in self.segments), np.int64)
        order, new = _least_by([digit, text], doc)
        group = np.cumsum(new) - 1
        first = order[new]
        self.group = np.empty(len(order), np.int64)
        self.group[order] = group
        self.digit, self.text, self.least = digit[first], text[first], doc[first]
        alone = np.ones(len(first), bool)  # groups whose digit has no other group here
        same = self.digit[1:] == self.digit[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        self.alone = alone
        self.larger = doc > self.least[self.group]

    def split_groups(self) -> np.ndarray:
        """Groups whose windows are compared one by one."""
        return ~self.alone | self.within(self.digit, self.split)

    def each(self) -> Iterator[tuple[Shared, slice]]:
        """The segments, and where their runs are in ``group`` and ``larger``."""
        at = 0
        for s in self.segments:
            yield s, slice(at, at + len(s.digit))
            at += len(s.digit)


def _cogrouped(texts: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    return texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(tidy_both(run), schema)


def run_messages(texts: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """Kind 0: a digit with one run text here (digit, text, least id); kind 1: a digit with several."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if len(texts):
            part = texts["part"][0].as_py()
            asked = Asked(texts, answers)
            a = np.flatnonzero(asked.alone)
            rows += _messages((asked.digit[a] % _U(parts)).astype(np.int64), part, 0, lambda x: _packed(asked.digit[a[x]]) + asked.text[a[x]].tobytes() + asked.least[a[x]].tobytes())
            b = np.unique(asked.digit[~asked.alone])
            rows += _messages((b % _U(parts)).astype(np.int64), part, 1, lambda x: _packed(b[x]))
        return pa.Table.from_batches([_batch(rows)])

    return _cogrouped(texts, answers, run, _MESSAGE)


def judged_runs(messages: DataFrame) -> DataFrame:
    """Answers: digits whose run here is repeated as a whole (2) or is to be split (3)."""

    def run(group: pa.Table) -> pa.Table:
        kind, part = np.asarray(group["kind"]), np.asarray(group["part"])
        digit, text, doc, source, many = [], [], [], [], [np.zeros(0, _U)]
        for i, body in enumerate(group["body"]):
            raw = body.as_buffer()
            if kind[i]:
                many.append(_unpacked(raw))
                continue
            n = len(raw) // 22
            digit.append(_unpacked(raw[: 6 * n]))
            text.append(np.frombuffer(raw, _U, n, 6 * n))
            doc.append(np.frombuffer(raw, np.int64, n, 14 * n))
            source.append(np.full(n, i))
        if not digit:
            return pa.Table.from_batches([_batch([])])
        digit, text, doc, source = map(np.concatenate, (digit, text, doc, source))
        order, new = _least_by([digit, text], doc)
        group_of = np.empty(len(order), np.int64)
        group_of[order] = np.cumsum(new) - 1
        least = doc[order[new]]
        # A digit is mixed if it has several texts here, or in some partition.
        own, texts = np.unique(digit[order[new]], return_counts=True)
        mixed = Asked.within(digit, np.unique(np.concatenate([own[texts > 1], *many])))
        repeated = doc > least[group_of]
        rows = _by_source(part, source, repeated, lambda x: _packed(digit[x]), 2) + _by_source(part, source, mixed & ~repeated, lambda x: _packed(digit[x]), 3)
        return pa.Table.from_batches([_batch(rows)])

    return messages.groupBy("bucket").applyInArrow(tidy(run), _MESSAGE).drop("bucket")


def _window_least(asked: Asked) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of split runs here, and the least id of each.

    Of equal runs the one with the least id speaks for all.
    """
    split = asked.split_groups()
    found, docs = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for runs, at in asked.each():
        chosen = np.flatnonzero(split[asked.group[at]] & ~asked.larger[at])
        _, hashes = runs.windows(chosen)
        found.append(hashes)
        docs.append(np.repeat(asked.doc[runs.owner[chosen]], runs.count[chosen]))
    hashes, docs = np.concatenate(found), np.concatenate(docs)
    order, new = _least_by([hashes], docs)
    return hashes[order[new]], docs[order[new]]


def window_messages(texts: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if len(texts):
            asked = Asked(texts, answers)
            hashes, least = _window_least(asked)
            order = np.argsort(least, kind="stable")  # equal ids lie together
            hashes, least = hashes[order], least[order]
            rows += _messages((hashes % _U(parts)).astype(np.int64), texts["part"][0].as_py(), 0, lambda x: hashes[x].tobytes() + least[x].tobytes())
        return pa.Table.from_batches([_batch(rows)])

    return _cogrouped(texts, answers, run, _MESSAGE)


def judged_windows(messages: DataFrame) -> DataFrame:
    """Answers (4): windows that a document with a smaller id than any here holds."""

    def run(group: pa.Table) -> pa.Table:
        part = np.asarray(group["part"])
        raws = [b.as_buffer() for b in group["body"]]
        hashes = np.concatenate([np.frombuffer(r, _U, len(r) // 16) for r in raws])
        doc = np.concatenate([np.frombuffer(r, np.int64, len(r) // 16, len(r) // 2) for r in raws])
        source = np.repeat(np.arange(len(raws)), [len(r) // 16 for r in raws])
        order, new = _least_by([hashes], doc)
        least = np.empty(len(order), np.int64)
        least[order] = doc[order[new]][np.cumsum(new) - 1]
        return pa.Table.from_batches([_batch(_by_source(part, source, doc > least, lambda x: hashes[x].tobytes(), 4))])

    return messages.groupBy("bucket").applyInArrow(tidy(run), _MESSAGE).drop("bucket")


def removals(texts: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of each row."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            return _result([])
        asked = Asked(texts, answers)
        hashes, least = _window_least(asked)
        repeated = asked.within(asked.digit, asked.repeated) & asked.alone  # groups
        split = asked.split_groups()
        removed = np.zeros(len(asked.data), bool)
        for runs, at in asked.each():
            group = asked.group[at]
            whole = np.flatnonzero(repeated[group] | asked.larger[at])
            part = np.flatnonzero(split[group] & ~asked.larger[at] & ~repeated[group])
            start, h = runs.windows(part)
            doc = np.repeat(asked.doc[runs.owner[part]], runs.count[part])
            gone = asked.within(h, asked.windows)
            if len(hashes):
                gone |= doc > least[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)]
            begin = np.concatenate([runs.start[whole], start[gone]])
            end = np.concatenate([runs.start[whole] + runs.count[whole] + DEPTH - 1, start[gone] + DEPTH])
            size = len(runs.slab)
            marks = np.bincount(begin, minlength=size + 1) - np.bincount(end, minlength=size + 1)
            removed[runs.base : runs.base + size] |= np.cumsum(marks[:size]) > 0
        ids = texts["doc_id"].to_pylist()
        rows = []
        for d, a, b in zip(ids, asked.offsets[:-1].tolist(), asked.offsets[1:].tolist(), strict=True):
            own = removed[a:b]
            edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist()
            text = asked.data[a:b]
            kept = text[~own] if edge else text
            rows.append((d, b - a, int(own.sum()), len(edge) // 2, hashlib.sha256(kept.tobytes()).hexdigest(), [{"start": x, "end": y} for x, y in zip(edge[::2], edge[1::2], strict=True)]))
        return _result(rows)

    return _cogrouped(texts, answers, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def _result(rows: list[tuple]) -> pa.Table:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def units(docs: DataFrame) -> DataFrame:
    """(part, doc_id, text): rows of ``docs`` with the number of their unit, texts as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        unit = TaskContext.get().partitionId() << 32
        size = rows = 0
        for batch in batches:
            length = np.diff(k.texts(batch.column("text"))[1])
            part = np.empty(len(length), np.int64)
            for i, n in enumerate(length.tolist()):
                if rows and (size + n > UNIT or rows >= UNIT_ROWS):
                    unit, size, rows = unit + 1, 0, 0
                size, rows = size + n, rows + 1
                part[i] = unit
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column("doc_id"), batch.column("text")], names=["part", "doc_id", "text"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return kept.mapInArrow(trimmed(run), "part long, doc_id long, text binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: what is removed, and the digest of what is kept.

    ``spans`` are the removed runs in bytes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = buckets(spark)
    name = f"flowloom_texts_{uuid.uuid4().hex}"
    # No shuffle, then or later: a task writes its units into their buckets.
    units(docs).write.option("compression", "zstd").bucketBy(parts, "part").saveAsTable(name)
    try:
        texts = spark.table(name)
        answers = written(shared_digits(digit_messages(texts, parts)), "digits")
        answers = answers.union(written(judged_runs(run_messages(texts, answers, parts)), "runs"))
        answers = answers.union(written(judged_windows(window_messages(texts, answers, parts)), "windows"))
        return written(removals(texts, answers), "removals")
    finally:
        spark.sql(f"drop table if exists {name}")


def op10_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
