import hashlib
import re
import time

from flowloom.llm import decontaminate as d
from tests.llm.helpers import ODD_TEXTS, docs, documents

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def norm(text):
    raw = (text or "").encode()
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in raw))


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = norm(text)
        if item is None or not w:
            continue
        for i in range(max(1, len(w) - 12)):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = {}
    for doc, text in rows:
        w = norm(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_query(spark, small):
    import pyarrow.parquet as pq

    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{small}/benchmark.parquet").to_pylist()]
    want = brute([(r["doc_id"], r["text"]) for r in documents(small)], items)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in d.op8_decontaminate(spark, small).collect()}
    assert got == want
    assert any(x[4] for x in want.values())


ITEMS = [
    (1, "Alpha beta, gamma! delta"),
    (2, "beta gamma"),
    (12, None),
    (None, "word"),
    (3, " ".join(f"w{i}" for i in range(20))),
    (4, "!!!"),
    (5, "É a"),
]
TEXTS = [*ODD_TEXTS, "x ALPHA-beta gamma  delta y", "beta gamma beta gamma", " ".join(f"W{i}" for i in range(1, 16)), "é a É A", " ".join(f"w{i}" for i in range(12))]


def brute_equal(spark, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = docs(spark, TEXTS).withColumnRenamed("lang", "n_hit")
    want = brute(enumerate(TEXTS), items)
    rows = d.scan(frame, bench).collect()
    for r in rows:
        w = want[r.doc_id]
        assert (r.n_words, r.n_hit, len(r["items"]), d.items_sha256(r["items"]), r.contaminated) == w
        words = [x for s in r.hit_spans for x in norm((TEXTS[r.doc_id] or "")[s.start : s.end])]
        assert len(words) == r.n_hit
    assert len(rows) == len(TEXTS)


def test_odd_cases(spark):
    brute_equal(spark, ITEMS)


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_BYTES", 10)
    brute_equal(spark, ITEMS)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in d.scan(docs(spark, TEXTS), none).collect()} == {0}
    assert d.scan(docs(spark, []), none).count() == 0


def test_item_of_more_words_than_there_are_characters():
    words = [f"{i:x}" for i in range(1_200_000)]
    began = time.time()
    parts = list(d._parts(" ".join(words).encode(), 13))
    assert max(map(len, parts)) < d.BLOCK_BYTES + 10 and len(parts) > 5
    scanner = d.Scanner([("1", parts[-1]), ("2", b"beta gamma")])
    assert scanner.scan(" ".join(words[-13:]).encode()) == (13, [(0, 12)], {"1"})
    assert scanner.scan(" ".join(["x", *words[-40:], "y", "beta", "gamma"]).encode()) == (44, [(1, 40), (42, 43)], {"1", "2"})
    assert scanner.scan(" ".join(words[-12:]).encode()) == (12, [], set())
    assert time.time() - began < 60


def test_words_of_two_letters(spark, monkeypatch):
    monkeypatch.setattr(d, "FANOUT", 2)
    rows = [(t or "").encode() for t in TEXTS]
    wide = d.Scanner([(str(i), (t or "").encode()) for i, t in ITEMS if i is not None])
    assert wide.width == 2
    monkeypatch.setattr(d, "FANOUT", 4096)
    plain = d.Scanner([(str(i), (t or "").encode()) for i, t in ITEMS if i is not None])
    assert plain.width == 1 and [wide.scan(t) for t in rows] == [plain.scan(t) for t in rows]


def test_parts_of_an_item_hold_each_window(monkeypatch):
    monkeypatch.setattr(d, "BLOCK_BYTES", 100)
    text = " ".join(f"w{i}" for i in range(400)).encode()
    parts = [p.split() for p in d._parts(text, 13)]
    whole = text.split()
    found = {tuple(p[i : i + 13]) for p in parts for i in range(len(p) - 12)}
    assert found == {tuple(whole[i : i + 13]) for i in range(len(whole) - 12)} and len(parts) > 10


def test_many_hits_in_one_text():
    text = "é beta gamma, " * 20_000
    n, runs, items = d.Scanner([("2", b"beta gamma")]).scan(text.encode())
    began = time.time()
    spans = d.original_spans(text.encode(), runs)
    assert time.time() - began < 1
    assert (n, len(spans), items) == (60_000, 20_000, {"2"}) and {text[a:b] for a, b in spans} == {"beta gamma"}
