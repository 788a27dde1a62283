"""WARC archives: written from captures, read back, assembled into transactions.

A capture is three records: request, response (or revisit) and metadata. The
request and the metadata name the response or revisit in ``WARC-Concurrent-To``.
``write_archives`` makes the records as text, whose bytes are the archive's, and
writes them with Spark's text sink, record end as line end: any store works, and
commits survive lost executors. ``read_archives`` parses whole files (plain or
gzip, of one member or one a record) as a stream of chunks. ``assemble`` joins the
three records of a capture on concurrent-to and emits one nested row. The archives
are read once; only what the headers and a digest of each payload say is moved.

Of captures with equal payloads of at least ``LEAST_REVISIT`` bytes the one with
the smallest (page_id, row) is the response; the others become revisits that refer
to it. A revisit keeps the HTTP head, and in it the length, of the full payload.

Nulls: null html is an empty payload, a null url an empty address. A null page_id
sorts last and comes back null. Repeated rows are captures of their own. Header
values lose line ends and outer spaces.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.llm.common import looked_up, shared_path, small_batches, small_enough, table, trimmed, written

LEAST_REVISIT = 100
#: Bytes of records that an archive file holds on average, before it is packed.
FILE_BYTES = 64 << 20
SALTS = 32
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = "\r\n"


def _header(*fields: tuple[str, Column | str]) -> Column:
    """Lines of a header; a null value leaves its line out."""
    lines = [F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(_CRLF)) for name, value in fields]
    return F.concat(F.lit(f"WARC/1.1{_CRLF}"), *(F.coalesce(line, F.lit("")) for line in lines), F.lit(_CRLF))


def _uuid(key: Column) -> Column:
    h = F.md5(key)
    return F.concat(F.lit("<urn:uuid:"), *(x for i, (a, n) in enumerate([(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]), F.lit(">"))


def captures(pages: DataFrame) -> DataFrame:
    """Pages as captures: row (unique), page_id, url, html, bytes, digest, refers_row."""
    html = F.coalesce("html", F.lit(""))
    rows = written(
        pages.select(
            F.monotonically_increasing_id().alias("row"),
            "page_id",
            F.trim(F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")).alias("url"),
            html.alias("html"),
            F.octet_length(html).cast("long").alias("bytes"),
            F.sha2(html.cast("binary"), 256).alias("digest"),
        ),
        "captures",
    )
    order = F.struct(F.col("page_id").isNull(), "page_id", "row")
    large = rows.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min_by("row", order).alias("first_row"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first_row")
    first = looked_up(rows.select("row", "digest"), written(large, "payloads"), "digest", SALTS, "inner").where("row <> first_row").select("row", F.col("first_row").alias("refers_row"))
    return rows.join(F.broadcast(first) if small_enough(first, 32) else first, "row", "left")


def records(rows: DataFrame) -> DataFrame:
    """One row a record, in the order request, response or revisit, metadata; column ``value``."""
    size = lambda text: F.octet_length(text).cast("string")
    name = lambda kind, row="row": _uuid(F.concat(F.lit(f"{kind}:"), F.col(row).cast("string")))
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    ask = F.concat(F.lit("GET "), F.regexp_extract("url", "://[^/?#]*([^#]*)", 1), F.lit(f" HTTP/1.1{_CRLF}Host: "), host, F.lit(_CRLF * 2))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(_CRLF * 2))
    meta = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(_CRLF)), F.lit("")), F.lit("via: "), F.col("url"), F.lit(_CRLF))
    again = F.col("refers_row").isNotNull()
    block = F.when(again, head).otherwise(F.concat(head, F.col("html")))
    common = (("WARC-Target-URI", F.col("url")), ("WARC-Date", DATE))
    request = F.concat(_header(("WARC-Type", "request"), ("WARC-Record-ID", name("request")), ("WARC-Concurrent-To", name("response")), *common, ("Content-Type", "application/http; msgtype=request"), ("Content-Length", size(ask))), ask)
    response = F.concat(
        _header(
            ("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", name("response")),
            *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Profile", F.when(again, F.lit(PROFILE))),
            ("WARC-Refers-To", F.when(again, name("response", "refers_row"))),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", size(block)),
        ),
        block,
    )
    metadata = F.concat(_header(("WARC-Type", "metadata"), ("WARC-Record-ID", name("metadata")), ("WARC-Concurrent-To", name("response")), *common, ("Content-Type", "application/warc-fields"), ("Content-Length", size(meta))), meta)
    return rows.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str) -> str:
    """Writes gzip archives of the captures of ``pages(page_id, url, html)`` to a folder."""
    rows = captures(pages)
    mean = rows.agg(F.avg("bytes")).first()[0] or 0
    out = records(rows).write.option("lineSep", _CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", max(3, int(3 * FILE_BYTES / (mean + 1000))))
    out.mode("errorifexists").text(path)
    return path


def _inflated(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Chunks of a file's bytes; gzip members are unpacked one after another."""
    if raw[:2] != b"\x1f\x8b":
        yield from (raw[i : i + size] for i in range(0, len(raw), size))
        return
    at = 0
    unpack = zlib.decompressobj(31)
    pending = b""
    while at < len(raw) or pending:
        if not pending:
            pending, at = raw[at : at + size], at + size
        if out := unpack.decompress(pending, size):
            yield out
        if unpack.eof:
            pending = unpack.unused_data
            unpack = zlib.decompressobj(31)
        else:
            pending = unpack.unconsumed_tail
    if out := unpack.flush():
        yield out


_NO_BREAK = re.compile(rb"[^\r\n]")


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in small letters) and block of each record of an archive."""
    chunks, have = _inflated(raw), bytearray()

    def more() -> bool:
        chunk = next(chunks, None)
        have.extend(chunk or b"")
        return chunk is not None

    while True:
        while not (start := _NO_BREAK.search(have)):
            have.clear()
            if not more():
                return
        del have[: start.start()]
        while (end := have.find(b"\r\n\r\n")) < 0 and more():
            pass
        if end < 0 or not have.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {bytes(have[:40])!r}")
        fields: dict[str, str] = {}
        for line in bytes(have[:end]).split(b"\r\n")[1:]:
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        while len(have) < end + 4 + size and more():
            pass
        if len(have) < end + 4 + size:
            raise ValueError("a WARC record ends before its length")
        yield fields, bytes(have[end + 4 : end + 4 + size])
        del have[: end + 4 + size]


_RECORD = [
    ("record_id", pa.string()),
    ("warc_type", pa.string()),
    ("concurrent_to", pa.string()),
    ("refers_to_id", pa.string()),
    ("target_uri", pa.string()),
    ("warc_date", pa.string()),
    ("payload_digest", pa.string()),
    ("http_head", pa.string()),
    ("payload", pa.binary()),
    ("payload_bytes", pa.int64()),
    ("payload_sha256", pa.string()),
]
_NAMES = {pa.string(): "string", pa.binary(): "binary", pa.int64(): "long"}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row a record of all archives in a folder; without ``payloads``, HTTP payloads are null but counted and digested."""
    small_batches(spark)
    schema = ", ".join(f"{n} {_NAMES[t]}" for n, t in _RECORD)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _RECORD, strict=True)], names=[n for n, _ in _RECORD])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                rows, size = [], 0
                for fields, block in parse(raw.as_py()):
                    head, payload, http = "", block, fields.get("content-type", "").startswith("application/http")
                    if http:
                        first, gap, rest = block.partition(b"\r\n\r\n")
                        head, payload = (first + gap).decode("utf-8", "replace"), rest
                    get = fields.get
                    rows.append((get("warc-record-id"), get("warc-type"), get("warc-concurrent-to"), get("warc-refers-to"), get("warc-target-uri"), get("warc-date"), get("warc-payload-digest"), head, payload if payloads or not http else None, len(payload), hashlib.sha256(payload).hexdigest()))
                    size += len(block) if payloads else len(head)
                    if size > 4 << 20 or len(rows) >= 2000:
                        yield packed(rows)
                        rows, size = [], 0
                if rows:
                    yield packed(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(trimmed(run), schema)


def assemble(rows: DataFrame) -> DataFrame:
    """One nested row a capture: capture_id, request, response, metadata, payload size and digest.

    Joined on concurrent-to; a capture without a request or a metadata record has
    null there. Columns with large content cross the join once.
    """
    main = rows.where("warc_type in ('response', 'revisit')")
    side = lambda kind: rows.where(F.col("warc_type") == kind).groupBy("concurrent_to").agg(F.min(F.struct("record_id", "target_uri", "http_head", F.col("payload").cast("string").alias("fields"))).alias(kind))
    length = F.regexp_extract("http_head", r"(?i)\r\nContent-Length:\s*(\d+)", 1)
    revisit = F.col("warc_type") == "revisit"
    response = main.select(
        F.col("record_id").alias("concurrent_to"),
        F.struct("record_id", "warc_type", "target_uri", "warc_date", "refers_to_id", "http_head", "payload").alias("response"),
        F.when(revisit, length.cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("payload_digest", "^sha256:", "")).otherwise(F.col("payload_sha256")).alias("payload_digest"),
    )
    return response.join(side("request"), "concurrent_to", "left").join(side("metadata"), "concurrent_to", "left").withColumnRenamed("concurrent_to", "capture_id")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives of ``pages``, reads them and assembles the captures."""
    spark = pages.sparkSession
    return assemble(read_archives(spark, write_archives(pages, shared_path(spark, "warc"))))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page what the three records of its capture say; ``n_records`` counts those that were found."""
    page = F.regexp_extract("metadata.fields", r"(?:^|\n)page-id: (-?\d+)\r\n", 1).try_cast("long")
    archives = write_archives(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    captures = assemble(written(read_archives(spark, archives, payloads=False), "records"))
    host = F.regexp_extract("request.http_head", r"\r\nHost: ([^\r]*)", 1)
    n = F.lit(1).cast("long") + F.col("request").isNotNull().cast("long") + F.col("metadata").isNotNull().cast("long")
    rows = captures.select("capture_id", page.alias("page_id"), "payload_bytes", "payload_digest", F.col("response.warc_type").alias("record_type"), F.col("response.refers_to_id").alias("refers_id"), n.alias("n_records"), host.alias("request_host"))
    rows = written(rows, "warc-rows")
    # Only responses that are referred to are looked up, each by the salted copies of its row.
    asked = rows.where("refers_id is not null").select(F.col("refers_id").alias("capture_id")).distinct()
    named = rows.join(asked, "capture_id", "left_semi").select(F.col("capture_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    return looked_up(rows.drop("capture_id"), named, "refers_id", SALTS).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_records", "request_host")


OP2_SQL = f"""with p as (select page_id, coalesce(html, '') h, regexp_extract(trim(regexp_replace(coalesce(url, ''), '[\r\n]+', ' ', 'g')), '://([^/?#]*)', 1) host from pages),
d as (select page_id, strlen(h) n, sha256(h) s, host from p),
f as (select *, min(page_id) over (partition by s) first, n >= {LEAST_REVISIT} and row_number() over (partition by s order by page_id nulls last) > 1 again from d)
select page_id, n::bigint payload_bytes, s payload_digest, case when again then 'revisit' else 'response' end record_type,
  case when again then first end refers_to, 3::bigint n_records, host request_host from f"""
