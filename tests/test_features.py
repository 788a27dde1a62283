"""The windows against state that takes one packet at a time, on random traces."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import features
from flowloom.streaming.state import Latency, Moments, Packets, Tcp, Video

PACKET = "pkt_no long, ts_ns long, flow_id string, tick long, dir int, is_tcp boolean, length long, data_length long, seq long, ack long, data_offset int, window int, f_ack boolean, f_syn boolean, f_rst boolean, f_psh boolean, f_urg boolean"


def trace(seed, wrap=0):
    rng = random.Random(seed)
    rows, ts = [], 0
    for i in range(400):
        ts += rng.choice([0, 1, 5, 900]) * 10**7
        tcp = rng.random() < 0.85
        data = rng.choice([0, 0, 100, 100, 101, 200])
        seq, ack = ((wrap + rng.randrange(8) * 100) % 2**32 if tcp else 0), (wrap + rng.randrange(10) * 100) % 2**32
        rows.append((i, ts, f"f{rng.randrange(4)}", ts // (3 * 10**9), rng.randrange(2), tcp, data + (20 if tcp else 8), data, seq, ack if tcp else 0, 5 if tcp else 0, rng.randrange(1000), tcp and rng.random() < 0.7, False, False, False, False))
    return rows


def by_flow(rows, ticks):
    out = {}
    for r in rows:
        out.setdefault((r.flow_id, r.tick) if ticks else (r.flow_id,), []).append(r)
    return out


@pytest.fixture(scope="module", params=[(0, 0), (1, 0), (2, 2**32 - 400)])
def packets(request, spark):
    frame = spark.createDataFrame(trace(*request.param), PACKET).repartition(3).cache()
    return frame, sorted(frame.collect(), key=lambda r: (r.ts_ns, r.pkt_no))


@pytest.mark.parametrize("ticks", [False, True])
def test_tcp_rows(packets, ticks):
    frame, rows = packets
    keys = ["flow_id", "tick"] if ticks else ["flow_id"]
    got = {r.pkt_no: (r.in_flight, r.ooo, r.retr, r.rtt) for r in features.tcp_rows(frame, keys).collect()}
    want = {}
    for own in by_flow(rows, ticks).values():
        state = Tcp()
        for p in own:
            if p.is_tcp:
                x = state.add(p)
                want[p.pkt_no] = (x["in_flight"], x["ooo"], x["retr"], x["rtt"])
    assert got == want


def test_packet_counters(packets):
    frame, rows = packets
    for r in features.packet_counters(frame, ["flow_id", "tick"]).collect():
        state = Packets()
        for p in by_flow(rows, True)[r.flow_id, r.tick]:
            state.add(p)
        assert state.values() == {k: r[k] for k in state.values()}


def test_video_segments(packets):
    frame, rows = packets
    got = {}
    for r in features.video_segments(frame, ["flow_id"]).orderBy("flow_id", "seg").collect():
        got.setdefault(r.flow_id, []).append({k: v for k, v in r.asDict().items() if k != "flow_id"})
    for (flow,), own in by_flow(rows, False).items():
        state = Video()
        for p in own:
            state.add(p)
        assert got.get(flow, []) == state.values()


def test_video_segments_by_tick(packets):
    frame, rows = packets
    got = {}
    for r in features.video_segments_tick(frame, ["flow_id"]).orderBy("flow_id", "tick", "seg").collect():
        got.setdefault((r.flow_id, r.tick), []).append({k: v for k, v in r.asDict().items() if k not in ("flow_id", "tick")})
    for (flow,), own in by_flow(rows, False).items():
        state, i, last = Video(), 0, max((p.tick for p in own), default=0)
        for tick in range(last + 1):
            while i < len(own) and own[i].tick == tick:
                state.add(own[i])
                i += 1
            if tick <= max((p.tick for p in own if state.seg), default=-1):
                assert got.get((flow, tick), []) == state.values(), (flow, tick)
            state.clear()


def test_latency_and_jitter(packets):
    frame, rows = packets
    got = {(r.flow_id, r.tick): r for r in features.latency_jitter(frame, ["flow_id"], "tick").collect()}
    for (flow,), own in by_flow(rows, False).items():
        state, tick = Latency(), None
        for p in [*own, None]:
            if tick is not None and (p is None or p.tick != tick):
                if (flow, tick) in got:
                    for k, v in state.values().items():
                        assert got[flow, tick][k] == pytest.approx(v, rel=1e-9), k
                state.clear()
            if p is not None:
                state.add(p)
                tick = p.tick


def test_moments(spark):
    from flowloom.functions import welford

    rng = random.Random(5)
    values = [rng.gauss(0, 3) for _ in range(50)]
    state = Moments()
    for v in values:
        state.add(v)
    row = spark.createDataFrame([(v,) for v in values], "v double").agg(welford.mean(F.col("v")), welford.variance(F.col("v"))).first()
    assert tuple(row) == pytest.approx((state.avg, state.var))
    one = spark.createDataFrame([(4.0,)], "v double").agg(welford.mean(F.col("v")), welford.variance(F.col("v"))).first()
    none = spark.createDataFrame([], "v double").agg(welford.mean(F.col("v")), welford.variance(F.col("v"))).first()
    assert (tuple(one), tuple(none)) == ((4.0, 0.0), (0.0, 0.0))


@pytest.mark.parametrize("carry", [True, False])
def test_checked_moments(spark, carry):
    from flowloom.functions import welford

    values = [1.0, 2.0, 3.0, 50.0, 2.5, 60.0, 0.0]
    n, avg, m2, var = 0, 0.0, 0.0, 0.0
    for v in values:
        if n == 0:
            n, avg = 1, v
            continue
        delta = v - avg
        mean = avg + delta / (n + 1)
        new = m2 + delta * (v - mean)
        if v > 1.0 * (new / n) ** 0.5 and v > 10:
            continue
        var, n, avg, m2 = new / n, n + 1, mean, new if carry else 0.0
    got = spark.createDataFrame([(values,)], "v array<double>").select(welford.checked(F.col("v"), 1.0, 10.0, carry).alias("w")).first().w
    assert (got.n, got.avg, got["var"]) == pytest.approx((n, avg, var))


def test_byte_copy_and_image(spark):
    import struct
    import zlib

    frames = [(i, i, "f", True, 5, 40, 20, bytes([i]) * 74) for i in range(12)] + [(99, 1, "g", True, 5, 40, 20, b"z" * 74)]
    rows = spark.createDataFrame(frames, "pkt_no long, ts_ns long, flow_id string, is_ipv4 boolean, ihl int, length long, data_length long, raw_data binary")
    for layers, size in ((0, 54), (1, 74), (2, 20)):
        got = {r.flow_id: bytes(r.Data) for r in features.byte_copy(rows, ["flow_id"], layers).collect()}
        assert got["f"] == b"".join(bytes([i]) * size for i in range(12))[:400]
        assert got["g"] == b"z" * size
    images = {r.flow_id: r.Data for r in features.png_copy(rows, ["flow_id"]).collect()}
    assert images["g"] is None
    body = bytes(images["f"])
    at = body.index(b"IDAT")
    lines = zlib.decompress(body[at + 4 : at + 4 + struct.unpack(">I", body[at - 4 : at])[0]])
    assert b"".join(lines[i * 21 + 1 : i * 21 + 21] for i in range(20)) == b"".join(bytes([i]) * 74 for i in range(12))[:400]


def test_raw_frames_hold_whole_texts(spark):
    from flowloom.operators import features
    from flowloom.sources import tables

    sf = "/root/testdata/sf0.01"
    frames = tables.raw_frames(spark, sf)
    texts = spark.read.parquet(f"{sf}/documents.parquet")
    joined = frames.join(texts, frames.pkt_no == texts.doc_id)
    assert joined.where("octet_length(text) > 1500").count() > 0
    assert joined.where("raw_data <> cast(text as binary)").count() == 0
    # A limit above 1500 gets the text's bytes; shorter than the limit only if the flow has no more.
    got = features.byte_copy(frames, ["pkt_no"], 1, 5000)
    want = texts.selectExpr("doc_id", "substr(cast(text as binary), 1, 5000) as first").where("octet_length(first) > 0")
    assert got.join(want, got.pkt_no == want.doc_id).where("Data = first").count() == want.count()


def test_running_values_of_one_flow_are_many_tasks(spark):
    from flowloom.operators.scan import Running, running

    rng = random.Random(9)
    rows = [(i, i * 10**8 + rng.randrange(10**8), "f", rng.choice([None, *range(50)])) for i in range(3000)]
    frame = spark.createDataFrame(rows, "pkt_no long, ts_ns long, flow_id string, x int").repartition(3)
    wanted = {f"{kind}_{own}": Running(kind, F.col("x"), own) for kind in ("sum", "max", "last", "first") for own in (False, True)}
    got = running(frame, ["flow_id"], wanted)
    plain = running(frame, ["flow_id"], wanted, None)
    columns = sorted(got.columns)
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=repr) == sorted((tuple(r) for r in plain.select(columns).collect()), key=repr)
    # The windows over packets have the bucket among their keys; the only one by flow alone is over the buckets' sums.
    shown = got._jdf.queryExecution().optimizedPlan().toString()
    over = [line for line in shown.splitlines() if line.strip(" :+-").startswith("Window")]
    assert sum("__bucket" in line.rsplit("], [", 2)[1] for line in over) >= 1 and len(over) == 2
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
