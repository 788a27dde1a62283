"""Token counts with a whole-token shortcut.

A text as the library sees it is one mark for its start and every space a mark
(U+2581). No vocabulary string has a mark behind another character, so no merge
crosses the place before a run of marks, and a text's tokens are those of its
pre-tokens (a run of marks and what follows). ``Vocabulary`` proves this for the
model at hand and proves, by encoding each vocabulary string alone, which of them
are one token; pre-tokens among those count 1 without a merge. Only the rest is
merged, by the library, and kept in a bounded table. A model for which the proof
fails is encoded text by text.

Nulls: a null text counts as empty (0 bytes, 0 tokens). Each row gets a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import mapped, small_batches, table

#: Pre-tokens kept with their counts in a worker; beyond, the table starts anew.
KEPT = 400_000
LIMIT = 4096
MARK = "▁"


class Vocabulary(dict):
    """Counts of pre-tokens: keys are what follows one mark, or start with a line feed."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        #: No piece has a mark behind another character; normalisation leaves texts as they are.
        probe = "  Aé ﬁ ́b\t\r\n ▁x  "
        self.proven = not any(MARK in p.lstrip(MARK) for p in pieces) and self.model.normalize(probe) == MARK + probe.replace(" ", MARK)
        #: Line feeds stand alone, so pre-tokens can be parted there as well.
        self.lines = not any("\n" in p for p in pieces)
        self.whole = {p[1:]: 1 for p in pieces if p.startswith(MARK) and MARK not in p[1:] and len(p) > 1 and len(self.model.encode(p[1:], num_threads=1)) == 1}
        self.update(self.whole)

    def __missing__(self, key: str) -> int:
        if len(self) >= KEPT + len(self.whole):
            self.clear()
            self.update(self.whole)
        if not key:  # a lone mark
            out = 1
        elif self.lines and "\n" in key[1:]:
            head, *rest = key.split("\n")
            return (self[head] if head or not key.startswith("\n") else 1) + sum(self._line(x) for x in rest)
        else:
            out = len(self.model.encode(key, num_threads=1))
        self[key] = out
        return out

    def _line(self, rest: str) -> int:
        """A line feed and what follows, without the mark that the library puts first."""
        key = "\n" + rest
        if key not in self:
            self.setdefault(key, len(self.model.encode(key, num_threads=1)))
        return self[key] - 1

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.proven:
            return len(self.model.encode(text, num_threads=1))
        text = text.replace(" ", MARK)
        if MARK + MARK not in text and not text.startswith(MARK):
            return sum(map(self.__getitem__, text.split(MARK)))
        return sum(self[part] if part is not None else n for part, n in self._parts(text))

    def _parts(self, text: str) -> Iterator[tuple[str | None, int]]:
        """Pre-tokens with longer runs of marks are merged by the library as they are."""
        import re

        for m in re.finditer(f"({MARK}+)([^{MARK}]*)", MARK + text):
            if len(m[1]) == 1:
                yield m[2], 0
            else:
                yield None, len(self.model.encode(m[0][1:].replace(MARK, " "), num_threads=1))


_held: dict[str, Vocabulary] = {}


def vocabulary(model: str) -> Vocabulary:
    """The worker's vocabulary; made once a process."""
    if model not in _held:
        _held[model] = Vocabulary(model)
    return _held[model]


def count_tokens(docs: DataFrame, model: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with a column of the number of tokens of each whole text."""
    small_batches(docs.sparkSession)
    docs = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(model)
        for batch in batches:
            counts = [known.count(t) if t else 0 for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, out])

    return mapped(docs, run, (out, "long"))


def piece_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, tokens, and whether it passes ``LIMIT`` tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return count_tokens(docs, piece_model()).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
