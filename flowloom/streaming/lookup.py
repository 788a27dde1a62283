"""Services of a stream's packets: DNS answers as event-time state, prefixes by static joins.

Packets and DNS answers meet by address. A packet waits until the watermark has passed the end of
its ``SLOT_NS``, so that every answer before it is there, and then takes the address's latest binding at its
time, if that has not expired: the same as ``classify.asof_binding`` on all of both, whatever
the order of files. Bindings that no later packet can take go.

Packets go through the state in blocks, each in Arrow's form: those of an address and a slot that lie near each other in
the source. An address that most packets have is dealt to ``SALTS`` keys by block; answers, which are few, go to each.
"""

from __future__ import annotations

import ipaddress
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from flowloom.config import Config
from flowloom.functions.net import ip_bits
from flowloom.model import SECOND
from flowloom.operators.classify import dns_names
from flowloom.operators.scan import BUCKET_NS

MS, AHEAD_MS = 1_000_000, 1000
#: Keys of an address.
SALTS = 16
#: Blocks that go to the state at once, and bytes of theirs after which fewer go.
CHUNK, CHUNK_BYTES = 1000, 4_000_000
#: The time of a block, packets of a block, and packets that are dealt to blocks at once.
SLOT_NS, BLOCK, HELD = BUCKET_NS, 500, 100_000
#: What comes in: the clock alone, a binding, a block of packets.
CLOCK, BINDING, PACKET = -1, 0, 1


def first_pattern(name: Column, config: Config) -> Column:
    """struct(service_id, service) of the first pattern found in a name; substrings come before expressions."""
    found = [F.when(name.contains(p), F.struct(F.lit(i).alias("service_id"), F.lit(s.name).alias("service"))) for i, s in enumerate(config.services) for p in s.domains]
    found += [F.when(name.rlike(p), F.struct(F.lit(i).alias("service_id"), F.lit(s.name).alias("service"))) for i, s in enumerate(config.services) for p in s.regexes]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<service_id:int,service:string>")


def with_prefix(spark: SparkSession, packets: DataFrame, config: Config) -> DataFrame:
    """Adds ``cidr_id`` and ``cidr`` of the first prefix that holds ``service_ip``: a static join for each length."""
    tables: dict[tuple[int, int], dict[str, tuple]] = {}
    pos = 0
    for i, s in enumerate(config.services):
        for p in s.prefixes:
            net = ipaddress.ip_network(p)
            bits = f"{int(net.network_address):0{net.max_prefixlen}b}"[: net.prefixlen]
            tables.setdefault((net.version, net.prefixlen), {}).setdefault(bits, (bits, pos, i, s.name))
            pos += 1
    rows, found = packets.withColumn("__bits", ip_bits(F.col("service_ip"))), []
    for k, ((version, length), nets) in enumerate(sorted(tables.items())):
        table = local(spark, list(nets.values()), ("net", "pos", "service_id", "service")).select(F.col("net").alias(f"__n{k}"), F.struct("pos", "service_id", "service").alias(f"__p{k}"))
        on = (F.length("__bits") == (32 if version == 4 else 128)) & (F.substring("__bits", 1, length) == F.col(f"__n{k}"))
        rows = rows.join(table, on, "left").drop(f"__n{k}")
        found.append(F.col(f"__p{k}"))
    first = F.array_min(F.array_compact(F.array(*found))) if found else F.lit(None).cast("struct<pos:int,service_id:int,service:string>")
    return rows.withColumn("__first", first).select(*packets.columns, F.col("__first.service_id").alias("cidr_id"), F.col("__first.service").alias("cidr"))


def local(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """Rows of the configuration as a relation of the plan itself, so that no micro-batch computes them anew."""
    word = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return spark.sql(f"select * from values {', '.join('(' + ', '.join(map(word, r)) + ')' for r in rows)} as t({', '.join(names)})")


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def _unpacked(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


_BLOCK = "address string, salt int, kind int, ts_ns long, no long, body binary"


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of packets of one address and slot, as ``_BLOCK``; a block's time is its slot's last nanosecond."""

    def dealt(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        slots = table["ts_ns"].combine_chunks().to_numpy() // SLOT_NS
        address = table["service_ip"].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = address.indices.to_numpy()
        order = np.lexsort((slots, codes))
        slots, codes, table = slots[order], codes[order], table.take(pa.array(order))
        groups = np.flatnonzero(np.r_[True, (np.diff(slots) != 0) | (np.diff(codes) != 0), True])
        names, rows = address.dictionary.to_pylist(), []
        for at, end in zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True):
            slot = int(slots[at])
            for k, first in enumerate(range(at, end, BLOCK)):
                part = table.slice(first, min(BLOCK, end - first))
                rows.append((names[codes[at]], (slot + k) % SALTS, PACKET, (slot + 1) * SLOT_NS - 1, part["pkt_no"][0].as_py(), _packed(part)))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= HELD:
            yield dealt(held)
            held, n = [], 0
    if held:
        yield dealt(held)


def packets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packets of blocks; those without a binding's service take that of the block's prefix."""
    for batch in batches:
        for body, cidr_id, cidr in zip(*(batch[c].to_pylist() for c in ("body", "cidr_id", "cidr")), strict=True):
            table = _unpacked(body)
            for name, value in (("service_id", cidr_id), ("service", cidr)):
                if value is not None:
                    at = table.schema.get_field_index(name)
                    table = table.set_column(at, table.schema.field(at), pc.fill_null(table[name], value))
            yield from table.to_batches()


class Bindings(StatefulProcessor):
    """State of an address: blocks of packets that wait, bindings in time, and when to look again.

    No more than ``CHUNK`` blocks that came, or the blocks that go on waiting, are held at once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bound = handle.getListState("bound", "bound_at long, no long, expires_s long, service_id int, service string")
        self.waiting = handle.getListState("waiting", "ts_ns long, no long, body binary")
        self.due = handle.getValueState("due", "at long")

    def _wake(self, ts_ns: int) -> None:
        """Looks again when the watermark has passed ``ts_ns``."""
        at, known = timer_ms(ts_ns), self.due.get()
        if known is not None and known[0] <= at:
            return
        if known is not None:
            self.handle.deleteTimer(known[0])
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        bound, waiting, size, first = [], [], 0, None
        for r in rows:
            if r.kind == BINDING:
                bound.append((r.ts_ns, r.no, r.expires_s, r.service_id, r.service))
            elif r.kind == PACKET:
                waiting.append((r.ts_ns, r.no, r.body))
                size += len(r.body)
                first = r.ts_ns if first is None else min(first, r.ts_ns)
                if len(waiting) == CHUNK or size > CHUNK_BYTES:
                    self.waiting.appendList(waiting)
                    waiting, size = [], 0
        if bound:
            self.bound.appendList(bound)
            self._wake((min(b[2] for b in bound) + 1) * SECOND + SLOT_NS)  # to forget what has expired
        if waiting:
            self.waiting.appendList(waiting)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = passed_ns(timerValues)
        self.due.clear()
        bound = sorted(tuple(b) for b in self.bound.get())
        times, rest = [b[0] for b in bound], []
        # The last place is that of packets before all bindings.
        starts, expires = np.array(times, "int64"), np.array([*(b[2] for b in bound), -1], "int64")
        ids, names = pa.array([*(b[3] for b in bound), None], pa.int32()), pa.array([*(b[4] for b in bound), None], pa.string())
        for ts, no, body in self.waiting.get():
            if ts >= passed:
                rest.append((ts, no, body))
                continue
            table = _unpacked(body)
            own = table["ts_ns"].to_numpy()
            at = np.searchsorted(starts, own, "right") - 1
            held = pa.array(np.where(own // SECOND <= expires[at], at, -1) % len(expires))
            yield Row(service_ip=key[0], body=_packed(table.append_column("service_id", ids.take(held)).append_column("service", names.take(held))))
        # What comes from now on is of a slot that has not passed. The latest binding before that may still hold; those before it cannot.
        begin = passed - SLOT_NS
        last = bisect_right(times, begin) - 1
        kept = [b for i, b in enumerate(bound) if i > last or (i == last and b[2] >= begin // SECOND)]
        for state, rows in ((self.bound, kept), (self.waiting, rest)):
            state.put(rows) if rows else state.clear()
        after = [w[0] for w in rest] + [(b[2] + 1) * SECOND + SLOT_NS for b in kept]
        if after:
            self._wake(max(min(after), passed))

    def close(self) -> None:
        pass


def event_time(rows: DataFrame) -> DataFrame:
    """Adds the event time, ``AHEAD_MS`` ahead: what is not above the first watermark, which is 0, would be late."""
    return rows.withColumn("ts", F.timestamp_micros(F.expr(f"ts_ns div 1000 + {1000 * AHEAD_MS}")))


def passed_ns(timer_values) -> int:
    """The time before which nothing comes any more."""
    return (timer_values.getCurrentWatermarkInMs() - AHEAD_MS) * MS


def timer_ms(ts_ns: int) -> int:
    """When the watermark has passed a time."""
    return ts_ns // MS + 1 + AHEAD_MS


def with_service(packets: DataFrame, messages: DataFrame, config: Config, clock: DataFrame, late: str = "30 seconds") -> DataFrame:
    """A stream's ``packets`` with ``service_id`` and ``service``, from a stream of DNS ``messages``.

    ``clock(ts_ns)`` tells the time where nothing else comes; without it the last packets wait.
    DNS messages that come more than ``late`` behind the slower of both are dropped, and packets whose slot has ended
    by so much and one slot more; both are counted among the query's rows dropped by the watermark, packets by block.
    """
    spark = packets.sparkSession
    none = lambda kind: F.lit(None).cast(kind)
    names = dns_names(messages).withColumn("best", first_pattern(F.col("name"), config)).where("best is not null")
    second = F.expr(f"ts_ns div {SECOND}")
    expires = F.when(F.col("ttl") == 0, second + config.dns_evict_ns // SECOND).otherwise(second + F.col("ttl"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    bindings = names.select(F.col("ip").alias("address"), salts.alias("salt"), F.lit(BINDING).alias("kind"), "ts_ns", F.col("dns_no").alias("no"), expires.alias("expires_s"), F.col("best.service_id").alias("service_id"), F.col("best.service").alias("service"), none("binary").alias("body"))
    seen = packets.mapInArrow(blocks, _BLOCK).select("address", "salt", "kind", "ts_ns", "no", none("long").alias("expires_s"), none("int").alias("service_id"), none("string").alias("service"), "body")
    ticks = clock.select(F.lit("").alias("address"), F.lit(0).alias("salt"), F.lit(CLOCK).alias("kind"), "ts_ns", F.lit(0).cast("long").alias("no"), none("long").alias("expires_s"), none("int").alias("service_id"), none("string").alias("service"), none("binary").alias("body"))
    sides = ((bindings, late), (seen, f"{late} {SLOT_NS // SECOND} seconds"))
    both = reduce(DataFrame.union, (event_time(side.union(ticks)).withWatermark("ts", behind) for side, behind in sides))
    made = both.groupBy("address", "salt").transformWithState(Bindings(), "service_ip string, body binary", "append", "EventTime")
    schema = StructType([*packets.schema.fields, StructField("service_id", IntegerType()), StructField("service", StringType())])
    return with_prefix(spark, made, config).mapInArrow(packets_of, schema)
