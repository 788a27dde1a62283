"""Which of many substrings a text holds, by one Aho-Corasick automaton over all of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of patterns in one automaton, which every task builds; more are searched in further passes.
PATTERN_BYTES = 8 << 20


class Patterns:
    """The numbers of the patterns in a text, in time linear in the text and what is found in it."""

    def __init__(self, patterns: list[tuple[int, str]]):
        import ahocorasick

        found: dict[str, list[int]] = {}
        for i, p in patterns:
            found.setdefault(p, []).append(i)
        self.always = found.pop("", [])  # the empty pattern is in every text
        self.automaton = ahocorasick.Automaton()
        for p, ids in found.items():
            self.automaton.add_word(p, ids)
        self.live = bool(found)
        if self.live:
            self.automaton.make_automaton()

    def within(self, text: str) -> set[int]:
        out = set(self.always)
        if self.live:
            for _, ids in self.automaton.iter(text):
                out.update(ids)
        return out


def _groups(patterns: list[str]) -> Iterator[list[tuple[int, str]]]:
    group: list[tuple[int, str]] = []
    size = 0
    for i, p in enumerate(patterns):
        if group and size + len(p) > PATTERN_BYTES:
            yield group
            group, size = [], 0
        group.append((i, p))
        size += len(p)
    yield group


def with_found(texts: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """(text, number): the numbers of the patterns that each text of the column holds; null texts hold none."""
    spark = texts.sparkSession

    def searched(group: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(group)  # of bounded bytes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Patterns(sent.value)
            for batch in batches:
                rows = [(t, i) for t in batch.column(0).to_pylist() for i in own.within(t)]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([i for _, i in rows], pa.int32())], names=["text", "number"])

        return texts.select(F.col(column).alias("text")).where("text is not null").mapInArrow(run, "text string, number int")

    groups = [searched(g) for g in _groups(patterns)]
    out = groups[0]
    for g in groups[1:]:
        out = out.unionByName(g)
    return out
