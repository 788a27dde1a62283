import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from flowloom.llm import packing as p
from tests.llm.helpers import ODD_TEXTS, docs, documents


def direct(rows, size=4096):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(p.word_model())
    out = {}
    for doc, text in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), size):
            part = np.asarray(ids[k : k + size], "<u4")
            out[doc, k // size] = (k, len(part), zlib.crc32(part.tobytes()))
    return out


def check_places(rows, size=4096):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def best_fit_decreasing(lengths, size):
    import bisect

    rooms = []
    n = 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, x)
        if i == len(rooms):
            n += 1
            free = size
        else:
            free = rooms.pop(i)
        if free - x:
            bisect.insort(rooms, free - x)
    return n


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_as_good_as_best_fit_on_pieces(seed):
    rng = random.Random(seed)
    size = 100
    lengths = [rng.choice([rng.randint(1, 100), 7, 51, 30, 100]) for _ in range(rng.randint(1, 3000))]
    histogram = {x: lengths.count(x) for x in set(lengths)}
    used, seen = {}, {}
    for length, first, end, sequence, per, offset in p.plan(histogram, size):
        assert first == seen.get(length, 0)
        seen[length] = end
        for k in range(end - first):
            used.setdefault(sequence + k // per, []).append((offset + k % per * length, length))
    assert seen == histogram
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    assert len(used) == best_fit_decreasing(lengths, size)


def test_query(spark, small):
    rows = p.op3_best_fit_packing(spark, small).collect()
    want = direct([(r["doc_id"], r["text"]) for r in documents(small)])
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    n = check_places(rows)
    assert n == best_fit_decreasing([x[1] for x in want.values()], 4096)


def test_odd_texts_and_repeated_rows(spark):
    frame = docs(spark, ODD_TEXTS)
    rows = p.pack(frame.unionByName(frame), p.word_model()).collect()
    want = direct(enumerate(ODD_TEXTS))
    assert len(rows) == 2 * len(want)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    check_places(rows)


def test_empty_table(spark):
    assert p.pack(docs(spark, []), p.word_model()).count() == 0


def test_null_id(spark):
    frame = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    rows = p.pack(frame, p.word_model()).collect()
    assert len(rows) == 2 and check_places(rows) == 1


def test_full_tables_keep_what_a_batch_needs(monkeypatch):
    known = p.Chunks(p.word_model())
    texts = ["one two, three; ONE (two) three:", "four five! 6 seven?", None]
    learnt = []
    for name in ("_learn_stems", "_each"):
        monkeypatch.setattr(known, name, lambda words, old=getattr(known, name): learnt.extend(words) or old(words))
    first = list(known.ids(texts))
    assert learnt
    monkeypatch.setattr(p, "KEPT", 3)
    monkeypatch.setattr(p, "KEPT_STEMS", 3)
    learnt.clear()
    assert list(known.ids(texts)) == first and not learnt  # the same batch again
    other = list(known.ids(["eight nine, two;"]))
    assert len(known) <= 6 and other == list(p.Chunks(p.word_model()).ids(["eight nine, two;"]))


def test_repeated_chunks_are_looked_up_once_a_batch():
    asked = []

    class Counting(dict):
        def __getitem__(self, key):
            asked.append(key)
            return dict.__getitem__(self, key)

    class Known(p.Chunks):
        __getitem__ = Counting.__getitem__

    texts = ["One two, (three) " * 500, None, "", "two,\nONE one. (three)" * 20]
    known = Known(p.word_model())
    known.stems = Counting(known.stems)
    asked.clear()
    got = [np.frombuffer(x, "<u4").tolist() for x in known.ids(texts)]
    assert got == [known.model.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert 0 < len(asked) < 30  # of 1,560 chunks


@pytest.mark.parametrize("slab", [1, 7, 1 << 16])
def test_chunks_are_gathered_as_the_library_has_them(monkeypatch, slab):
    monkeypatch.setattr(p, "SLAB", slab)
    rng = random.Random(slab)
    parts = [*p.Chunks.LETTERS, *p.Chunks.TAIL, *"  \n\n\t\r\0\xa0\u0301ßŸĀ'-(<>0", "it's", "Wort", "x" * 63, "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(300)]
    known = p.Chunks(p.word_model())
    want = [known.model.encode(t, add_special_tokens=False).ids for t in texts]
    for some in (slice(0, 150), slice(150, None), slice(0, 0), slice(None)):
        assert [np.frombuffer(x, "<u4").tolist() for x in known.ids(pa.array(texts)[some])] == want[some]
    assert list(known.ids([None, ""])) == [b"", b""]
