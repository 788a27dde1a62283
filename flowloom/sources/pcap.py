"""Capture files as tables, in batch and as a stream of files.

Whole files are read by Spark (``binaryFile``), so any store works, and decoded by
Arrow batches. ``PcapSource`` offers the same through ``spark.read.format("pcap")``.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from flowloom.functions.net import dns_filter, traffic_filter
from flowloom.model import DNS, FRAME
from flowloom.sources import columnar, decode

_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
_FRAME = [(n, _KINDS[t]) for n, t in (x.split() for x in FRAME.split(", "))]
#: Frames of one file come in batches of so many.
ROWS = 5000
#: Fields that a filter can be pushed down on.
_HEADER = ("is_ipv4", "ip_payload", "ihl", "proto", "src_port", "dst_port", "seq", "ack", "data_offset", "window")
_FILE = "path string, modificationTime timestamp, length long, content binary"


def _batches(raw: bytes, include_raw: bool, snaplen: int, wanted=None, place: int | None = None) -> Iterator[pa.RecordBatch]:
    """Frames of a file in batches; ``wanted`` picks them by their numbers before the rest is decoded.

    They are numbered, or with ``place`` by where they begin, so many bytes on.
    """
    data = np.frombuffer(raw, np.uint8)
    times, starts, sizes = columnar.records(raw)
    sizes = np.minimum(sizes, snaplen)
    for a in range(0, len(starts), ROWS):
        start, size = starts[a : a + ROWS], sizes[a : a + ROWS]
        low = int(start[0])  # the frames' own part of the file
        kept, fields = columnar.decode(data[low : int(start[-1] + size[-1])], start - low, size, wanted)
        fields["pkt_no"] = pa.array(kept + a if place is None else start[kept] - 16 + place)
        fields["ts_ns"] = pa.array(times[a : a + ROWS][kept])
        bodies = [raw[x : x + n] for x, n in zip(start[kept].tolist(), size[kept].tolist(), strict=True)] if include_raw else [None] * len(kept)
        fields["raw_data"] = pa.array(bodies, pa.binary())
        yield pa.RecordBatch.from_arrays([fields[n].cast(t) for n, t in _FRAME], names=[n for n, _ in _FRAME])


def _decoder(include_raw: bool, snaplen: int, bpf: str | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for found in _batches(raw.as_py(), include_raw, snaplen, WANTED.get(bpf)):
                    yield found.append_column("path", pa.array([path] * found.num_rows, pa.string()))

    return run


def _dns(fields: dict[str, pa.Array]) -> np.ndarray:
    proto, src, dst = (fields[c].fill_null(-1).to_numpy(zero_copy_only=False) for c in ("proto", "src_port", "dst_port"))
    return (proto == 17) & ((src == 53) | (dst == 53))


def _traffic(fields: dict[str, pa.Array]) -> np.ndarray:
    proto, src, dst = (fields[c].fill_null(-1).to_numpy(zero_copy_only=False) for c in ("proto", "src_port", "dst_port"))
    return (proto == 6) | ((proto == 17) & (src != 53) & (dst != 53) & (src >= 0))


#: The packet filters on header fields.
WANTED = {"dns": _dns, "traffic": _traffic}


def _kept(frames: DataFrame, bpf: str | None) -> DataFrame:
    if bpf is None:
        return frames
    ports = F.col("proto"), F.col("src_port"), F.col("dst_port")
    return frames.where({"traffic": traffic_filter, "dns": dns_filter}[bpf](*ports))


def read_frames(spark: SparkSession, path: str, bpf: str | None = None, include_raw: bool = False, snaplen: int = 1500) -> DataFrame:
    """Frames of all capture files in ``path``; ``pkt_no`` counts within a file, named by ``path``."""
    return frames_in(spark.read.format("binaryFile").load(path).select("path", "content"), bpf, include_raw, snaplen)


def frames_in(files: DataFrame, bpf: str | None = None, include_raw: bool = False, snaplen: int = 1500) -> DataFrame:
    """Frames of capture files ``files(path, content)``."""
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return _kept(files.select("path", "content").mapInArrow(_decoder(include_raw, snaplen, bpf), f"{FRAME}, path string"), bpf)


def stream_frames(spark: SparkSession, path: str, bpf: str | None = None, include_raw: bool = False, snaplen: int = 1500, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the frames of capture files that are put into a folder; replays a trace file by file."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("maxFilesPerTrigger", files_per_trigger).load(path).select("path", "content")
    return _kept(files.mapInArrow(_decoder(include_raw, snaplen, bpf), f"{FRAME}, path string"), bpf)


def read_dns(spark: SparkSession, path: str, answered: bool = False) -> DataFrame:
    """DNS messages of capture files (no VLAN); with ``answered`` those with an answer only."""
    return dns_in(spark.read.format("binaryFile").load(path).select("content"), answered)


def dns_in(files: DataFrame, answered: bool = False) -> DataFrame:
    """DNS messages of capture files ``files(content)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        question = pa.list_(pa.struct([("name", pa.string())]))
        answer = pa.list_(pa.struct([("ip", pa.string()), ("ttl", pa.int64())]))
        for batch in batches:
            for raw in batch.column("content"):
                rows = []
                for no, (ts, frame) in enumerate(decode.read_pcap(raw.as_py())):
                    found, body = decode.decode_frame(frame, vlan=False)
                    if 53 not in (found["src_port"], found["dst_port"]) or found["proto"] not in (6, 17):
                        continue
                    message = decode.decode_dns(body[2:] if found["proto"] == 6 else body)
                    if message:
                        rows.append((no, ts, [{"name": n} for n in message[0]], [{"ip": i, "ttl": t} for i, t in message[1]]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), question, answer), strict=True)], names=["dns_no", "ts_ns", "questions", "answers"])

    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    out = files.select("content").mapInArrow(run, DNS)
    return out.where(F.size("answers") >= 1) if answered else out


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.pushed: list[tuple[str, list]] = []

    def partitions(self) -> list[_File]:
        path = self.options["path"].removeprefix("file:")
        return [_File(p) for p in (sorted(glob.glob(f"{path}/*")) if os.path.isdir(path) else sorted(glob.glob(path)))]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of header fields, which decide before addresses are decoded; others come back."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in _HEADER:
                self.pushed.append((f.attribute[0], [f.value] if isinstance(f, EqualTo) else list(f.value)))
            else:
                yield f

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            raw = f.read()
        bpf = WANTED.get(self.options.get("bpf"))

        def wanted(fields: dict[str, pa.Array]) -> np.ndarray:
            keep = bpf(fields) if bpf else np.ones(len(fields["proto"]), bool)
            for name, values in self.pushed:
                keep &= pa.compute.is_in(fields[name], pa.array(values, fields[name].type)).to_numpy(zero_copy_only=False)
            return keep

        yield from _batches(raw, self.options.get("include_raw", "false") == "true", int(self.options.get("snaplen", "1500")), wanted)


class _Range(InputPartition):
    """Records of a file from byte ``start`` to ``end``, or to its last whole one."""

    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


class _StreamReader(DataSourceStreamReader):
    """Files of a folder in order of their names; the last one may still grow.

    An offset is the name of a file and the byte behind its last whole record; all files before it
    are done. So a restart loses no record and repeats none, and a record that is half written waits.
    """

    def __init__(self, options: dict):
        self.options = options
        self.folder = options["path"].removeprefix("file:")
        self.seen = ("", 0)

    def _files(self) -> list[str]:
        return sorted(os.path.basename(p) for p in glob.glob(f"{self.folder}/*"))

    def initialOffset(self) -> dict:
        return {"name": "", "at": 0}

    def latestOffset(self) -> dict:
        files = self._files()
        if files:
            name, at = self.seen if self.seen[0] == files[-1] else (files[-1], 0)
            self.seen = name, columnar.whole_until(f"{self.folder}/{name}", at)
        return {"name": self.seen[0], "at": self.seen[1]}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        own = [f for f in self._files() if start["name"] <= f <= end["name"]]
        ranges = [_Range(f"{self.folder}/{f}", start["at"] if f == start["name"] else 0, end["at"] if f == end["name"] else None) for f in own]
        return [r for r in ranges if r.end is None or r.end > r.start]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            head = f.read(24)
            start = max(partition.start, 24)
            f.seek(start)
            raw = f.read() if partition.end is None else f.read(max(partition.end - start, 0))
        if raw:
            bpf = WANTED.get(self.options.get("bpf"))
            yield from _batches(head + raw, self.options.get("include_raw", "false") == "true", int(self.options.get("snaplen", "1500")), bpf, start - 24)


class PcapSource(DataSource):
    """``spark.read.format("pcap")`` and ``readStream`` for files that all executors can open; a task a file.

    In a stream ``pkt_no`` is a record's place in its file, in bytes, and grows like the number.

    Options: ``bpf`` (traffic or dns), ``include_raw``, ``snaplen``. Comparisons
    of header fields (=, in) are taken by the source, before addresses are decoded.
    """

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes ``format("pcap")`` known; it takes filters, which the session must allow."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PcapSource)
