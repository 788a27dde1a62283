import gzip
import hashlib

import pytest

from flowloom.llm import warc as w

PAGES = "page_id long, url string, html string"
BIG = "<p>" + "é x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n" * 9


def rows(spark, pages):
    return w.round_trip(spark.createDataFrame(pages, PAGES)).collect()


def test_round_trip_of_odd_pages(spark):
    pages = [
        (5, "http://a.com/x?y#z", BIG),
        (3, "http://a.com/w", BIG),
        (9, "http://b.com", BIG),
        (9, "http://b.com", BIG),
        (None, None, BIG),
        (1, "http://c.com/\r\nX: y", None),
        (2, "", ""),
        (4, "no address", "short"),
        (6, "x", "short"),
        (7, "http://d.com", "z" * 100),
        (8, "http://d.com", "z" * 100),
        (10, "http://e.com", "z" * 99),
        (11, "http://e.com", "z" * 99),
    ]
    got = rows(spark, pages)
    assert len(got) == len(pages)
    by = {r.capture_id: r for r in got}
    bodies = sorted(((h or "").encode() for _, _, h in pages), key=lambda b: (len(b), b))
    assert sorted((r.payload_bytes, r.payload_digest) for r in got) == sorted((len(b), hashlib.sha256(b).hexdigest()) for b in bodies)
    page = lambda r: r.metadata.fields.split("page-id: ")[1].split("\r")[0] if "page-id" in r.metadata.fields else None
    for r in got:
        assert r.request.record_id and r.metadata.record_id
        if r.response.warc_type == "revisit":
            first = by[r.response.refers_to_id]
            assert first.response.warc_type == "response" and first.payload_digest == r.payload_digest
            assert page(first) in ("3", "7")
        else:
            assert len(r.response.payload) == r.payload_bytes
    revisits = sorted(str(page(r)) for r in got if r.response.warc_type == "revisit")
    assert revisits == ["5", "8", "9", "9", "None"]


def test_empty_table(spark):
    assert rows(spark, []) == []


def test_parse_plain_and_member_per_record():
    def record(kind, body):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    parts = [record("a", b"x\r\n\r\ny"), record("b", b""), record("c", b"z" * 3_000_000)]
    for raw in (b"".join(parts), b"".join(map(gzip.compress, parts)), gzip.compress(b"".join(parts))):
        assert [(f["warc-type"], len(b)) for f, b in w.parse(raw)] == [("a", 6), ("b", 0), ("c", 3_000_000)]
    assert list(w.parse(b"")) == []
    with pytest.raises(ValueError, match="ends before"):
        list(w.parse(parts[0][:-6]))
    with pytest.raises(ValueError, match="not a WARC"):
        list(w.parse(b"hello\r\n\r\n"))


def test_pages_that_repeat_an_id_revisit_it(spark, tmp_path):
    from tests.oracle import same

    pages = [(1, "http://a.com", BIG), (1, "http://a.com", BIG), (2, "http://b.com", BIG), (3, "http://b.com", "short"), (3, "http://b.com", "short"), (4, "http://c.com", "long " * 400_000), (4, "http://c.com", "long " * 400_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' as payload", "1 as host", "2 as row").write.parquet(f"{tmp_path}/pages.parquet")
    found = w.op2_warc_round_trip(spark, str(tmp_path))
    same(found, w.OP2_SQL, str(tmp_path))
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in found.collect()) == [(1, "response", None), (1, "revisit", 1), (2, "revisit", 1), (3, "response", None), (3, "response", None), (4, "response", None), (4, "revisit", 4)]
