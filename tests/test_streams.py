"""Event-time state of streams against the same work on whole tables."""

import random
from dataclasses import dataclass
from typing import ClassVar

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from flowloom import config as c
from flowloom.operators import classify, flows, packets, registry
from flowloom.plans import batch
from flowloom.sources import tables
from flowloom.streaming import lookup, records, runs
from flowloom.streaming.state import Latency, Packets, TcpState, Video

SECOND = 1_000_000_000
CONFIG = c.parse("""{"Services": [
  {"Name": "One", "Filter": {"DomainsString": ["one."], "Prefixes": ["198.51.100.0/24", "10.0.0.0/8"]}, "Collect": ["PacketCounters", "Longest"]},
  {"Name": "Two's", "Filter": {"DomainsRegex": ["^two[.]"], "Prefixes": ["198.51.0.0/16"]}, "Collect": ["PacketCounters", "VideoCounters"]}],
 "FlowCache": {"EvictTime": 15000000000}, "DNSCache": {"EvictTime": 20000000000}}""")


@registry.stateful("Longest", carry=("Longest",))
@dataclass
class Longest:
    """A user's feature: a tick's longest packet, and that of the flow's life."""

    tick: int = 0
    life: int = 0
    schema: ClassVar[str] = "tick long, life long"
    emits: ClassVar[str] = "LongestInTick long, Longest long"

    def add(self, p):
        self.tick, self.life = max(self.tick, int(p.length)), max(self.life, int(p.length))

    def emit(self):
        return {"LongestInTick": self.tick, "Longest": self.life}

    def clear(self):
        self.tick = 0

    def save(self):
        return self.tick, self.life

    @classmethod
    def load(cls, saved):
        return cls(*saved)


def made(spark, n=400, seed=1):
    """Packets of a few flows with gaps longer than the eviction, and DNS messages for their addresses."""
    rng = random.Random(seed)
    rows, ts = [], 0
    for i in range(n):
        ts += rng.choice([0, 1, 50, 700, 700, 4000]) * 1_000_000
        u = rng.randrange(7)
        rows.append((i, ts, u, rng.choice(["view", "click", "signup", "error"]), float(rng.randrange(9))))
    events = spark.createDataFrame(rows, "event_id long, ts_ns long, user_id long, event_type string, value double")
    frames = tables.frames_of(events).drop("ts_ns").join(events.selectExpr("event_id as pkt_no", "ts_ns"), "pkt_no")
    seen = packets.project(frames, "host", tables.HWADDR, "192.168.0.0/16").drop("raw_data")
    names = [(i, rng.randrange(ts), [(rng.choice(["a.one.net", "two.net", "else.net"]),)], [(rng.choice(tables.SERVICE_IPS[:7]), rng.choice([0, 3, 60]))]) for i in range(60)]
    messages = spark.createDataFrame(names, "dns_no long, ts_ns long, questions array<struct<name:string>>, answers array<struct<ip:string,ttl:long>>")
    return seen, messages, ts


def as_stream(df, path, order, files):
    """A table as a stream of files, one a micro-batch, nearly in order."""
    rows = sorted(df.collect(), key=order)
    size = -(-len(rows) // files)
    for k in range(files):
        df.sparkSession.createDataFrame(rows[k * size : (k + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def jittered(by):
    """Order of arrival: by time, up to 8 seconds early or late."""
    return lambda r: r.ts_ns + random.Random(r[by]).randrange(-8, 9) * SECOND


def rows_of(df, columns=None):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_services_in_any_order_of_arrival(spark, tmp_path):
    seen, messages, end = made(spark)
    place = str(tmp_path)
    clock = runs.Clock(spark, f"{place}/clock")
    stream = lookup.with_service(as_stream(seen, f"{place}/packets", jittered("pkt_no"), 2), as_stream(messages, f"{place}/dns", jittered("dns_no"), 2), CONFIG, clock.stream())
    late = []
    got = runs.drained(stream, place, clock, end + 1000 * SECOND, pause=True, late=late)
    want = classify.with_service(spark, seen, CONFIG, messages)
    columns = [*seen.columns, "service_id", "service"]
    assert rows_of(got, columns) == rows_of(want, columns) and sum(late) == 0
    assert len({r.service for r in got.select("service").distinct().collect()}) == 3


def test_packets_go_through_the_state_in_blocks(spark):
    ips = ["a", "b", None]
    rows = [(i, (i % 29) * SECOND + i, ips[0 if i % 5 else i % 3]) for i in range(6000)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("pkt_no", "ts_ns", "service_ip"), r, strict=True)) for r in rows])
    found = [r for part in lookup.blocks(iter([batch.slice(0, 2500), batch.slice(2500, 0), batch.slice(2500)])) for r in part.to_pylist()]
    assert len(found) < 30  # not one for each packet
    assert len({r["salt"] for r in found if r["address"] == "a"}) > 3  # nor one task for an address
    back = []
    for r in found:
        own = lookup._unpacked(r["body"]).to_pylist()
        assert len(own) <= lookup.BLOCK and r["ts_ns"] % lookup.SLOT_NS == lookup.SLOT_NS - 1
        assert {(p["service_ip"], p["ts_ns"] // lookup.SLOT_NS) for p in own} == {(r["address"], r["ts_ns"] // lookup.SLOT_NS)}
        back += [(p["pkt_no"], p["ts_ns"], p["service_ip"]) for p in own]
    assert sorted(back) == rows


def test_bindings_stay_for_packets_of_a_slot_that_has_not_passed():
    class Listed(list):
        get, put, clear, appendList = list.copy, lambda self, rows: self.__setitem__(slice(None), rows), list.clear, list.extend

    state = lookup.Bindings()
    state.bound, state.waiting, state.due, state._wake = Listed(), Listed(), Listed(), lambda at: None

    def passed(ts_ns):
        now = type("Now", (), {"getCurrentWatermarkInMs": lambda self: ts_ns // 1_000_000 + lookup.AHEAD_MS})()
        return [p for r in state.handleExpiredTimer(("a", 0), now, None) for p in lookup._unpacked(r.body).to_pylist()]

    bound = [Row(kind=lookup.BINDING, ts_ns=at * SECOND, no=at, expires_s=until, service_id=at, service=f"s{at}") for at, until in ((2, 99), (5, 6))]
    list(state.handleInputRows(("a", 0), iter(bound), None))
    assert passed(7 * SECOND) == []
    batch = pa.RecordBatch.from_pylist([{"pkt_no": i, "ts_ns": t * SECOND, "service_ip": "a"} for i, t in enumerate((1, 3, 6, 8, 12))])
    list(state.handleInputRows(("a", 0), (Row(**r) for part in lookup.blocks(iter([batch])) for r in part.to_pylist()), None))
    assert [(p["pkt_no"], p["service_id"], p["service"]) for p in passed(11 * SECOND)] == [(0, None, None), (1, 2, "s2"), (2, 5, "s5"), (3, None, None)]
    assert [p["service"] for p in passed(20 * SECOND)] == [None] and not state.waiting


def test_records_in_any_order_of_arrival(spark, tmp_path):
    seen, messages, end = made(spark, 300, 2)
    classified = classify.with_service(spark, seen, CONFIG, messages)
    place = str(tmp_path)
    clock = runs.Clock(spark, f"{place}/clock")
    stream = records.records(as_stream(classified, f"{place}/packets", jittered("pkt_no"), 2), clock.stream(), CONFIG)
    got = runs.drained(stream, place, clock, end + 1000 * SECOND, pause=True)
    whole = packets.with_tick(flows.flow_packets(classified, CONFIG.evict_ns), 0)
    want = batch.flow_json(spark, whole, CONFIG)
    columns = ["flow_id", "instance", "tick", "json"]
    assert rows_of(got, columns) == rows_of(want, columns)
    text = " ".join(r.json for r in got.collect())
    assert '"VideoSegments":[{' in text and '"Longest":' in text and "Two's" in text and len({r.instance for r in got.collect()}) > 1


def test_late_packets_are_dropped_and_counted(spark, tmp_path):
    seen, messages, end = made(spark, 200, 3)
    classified = classify.with_service(spark, seen, CONFIG, messages)
    place = str(tmp_path)
    clock = runs.Clock(spark, f"{place}/clock")
    first = classified.agg({"ts_ns": "min"}).first()[0]
    # The earliest packet comes last, far behind the watermark.
    order = lambda r: 2**62 if r.ts_ns == first else r.ts_ns
    stream = records.records(as_stream(classified, f"{place}/late", order, 3), clock.stream(), CONFIG, late="1 second")
    late = []
    got = runs.drained(stream, place, clock, end + 1000 * SECOND, pause=True, late=late)
    kept = classified.where(f"ts_ns > {first}")
    want = batch.flow_json(spark, packets.with_tick(flows.flow_packets(kept, CONFIG.evict_ns), 0), CONFIG)
    columns = ["flow_id", "instance", "tick", "json"]
    assert rows_of(got, columns) == rows_of(want, columns)
    assert sum(late) == classified.where(f"ts_ns = {first}").count()


@pytest.mark.parametrize("kind", [Packets, Video, TcpState, Latency, Longest])
def test_states_go_on_from_what_they_save(spark, kind):
    seen, _, _ = made(spark, 120, 4)
    own, again = kind(), kind()
    for i, p in enumerate(sorted(seen.collect(), key=lambda p: p.ts_ns)):
        own.add(p)
        again.add(p)
        again = kind.load(again.save())
        if i % 17 == 0:
            assert own.emit() == again.emit()
            own.clear()
            again.clear()
    assert own.emit() == again.emit()


def test_features_without_a_state_are_named(spark):
    with pytest.raises(ValueError, match="ByteCopyCounters"):
        registry.states(("PacketCounters", "ByteCopyCounters"))


def test_patterns_and_prefixes_of_a_message(spark):
    names = [(n,) for n in ("a.one.net", "two.one.", "two.net", "x.two.net", "", None)]
    got = [r.s for r in spark.createDataFrame(names, "name string").select(lookup.first_pattern(F.col("name"), CONFIG)["service"].alias("s")).collect()]
    assert got == ["One", "One", "Two's", None, None, None]
    ips = [("198.51.100.3",), ("198.51.7.1",), ("10.2.3.4",), ("11.0.0.1",), ("2001:db8::1",)]
    rows = lookup.with_prefix(spark, spark.createDataFrame(ips, "service_ip string"), CONFIG).collect()
    assert {r.service_ip: r.cidr for r in rows} == {"198.51.100.3": "One", "198.51.7.1": "Two's", "10.2.3.4": "One", "11.0.0.1": None, "2001:db8::1": None}
