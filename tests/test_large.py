"""What must hold on tables much larger than the ones at hand: plans, and numbers beyond 16 bits."""

import ipaddress
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from flowloom.functions import net
from flowloom.operators import classify, features, scan
from flowloom.plans.oracles import ORACLES
from flowloom.plans.queries import QUERIES, seen
from tests.oracle import same


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def behind_explode(df):
    """The lines of the plan above the last rows that are made of ticks."""
    lines = plan(df).splitlines()
    first = next(i for i, line in enumerate(lines) if "Generate explode(sequence(" in line)
    return "\n".join(lines[:first])


@pytest.fixture(scope="module")
def many_users(spark, tmp_path_factory):
    """sf0.001 with users whose ports pass 16 bits."""
    place = tmp_path_factory.mktemp("large")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.withColumn("user_id", F.col("user_id") * 4001).coalesce(1).write.parquet(f"{place}/events.parquet")
    spark.read.parquet("/root/testdata/sf0.001/pages.parquet").coalesce(1).write.parquet(f"{place}/pages.parquet")
    return str(place)


@pytest.mark.parametrize("name", ["video_segments_tick", "idle_emit", "flow_json"])
def test_idle_ticks_are_made_behind_all_shuffles(spark, small, name):
    assert not any(x in behind_explode(QUERIES[name](spark, small)) for x in ("Exchange", "Sort", "Window"))


@pytest.mark.parametrize("name", ["decode_frames", "decode_frames_dns_only"])
def test_ports_beyond_16_bits_come_back(spark, many_users, name):
    rows = QUERIES[name](spark, many_users)
    assert rows.where("src_port > 65535 or dst_port > 65535").count() > 0
    same(rows, ORACLES[name], many_users)


def test_flows_are_written_once(spark, small, monkeypatch):
    made = []
    monkeypatch.setattr(scan, "written", lambda df, what, put=scan.written: made.append(what) or put(df, what))
    QUERIES["flow_create"](spark, small)
    assert made.count("scan") == 1


@pytest.mark.parametrize("name", ["flow_expiry", "video_segments_tick", "flow_json", "tcp_retransmit", "latency_jitter"])
def test_flows_with_very_many_packets_go_in_two_levels(spark, small, monkeypatch, name):
    monkeypatch.setattr(scan, "HEAVY", 60)
    made = []
    monkeypatch.setattr(scan, "written", lambda df, what, put=scan.written: made.append(what) or put(df, what))
    same(QUERIES[name](spark, small), ORACLES[name], small)
    assert made.count("scan") >= 2


def test_packets_that_are_no_segments_are_neither_written_nor_shuffled(spark, small, monkeypatch):
    made = []
    for module in (scan, features):
        monkeypatch.setattr(module, "written", lambda df, what, put=scan.written: made.append(what) or put(df, what))
    same(QUERIES["video_segments_tick"](spark, small), ORACLES["video_segments_tick"], small)
    assert "scan" not in made
    # A request, data, and packets that are neither: the last of these still says how long the segment runs.
    at = lambda no, tick, way, size: (no, no * 10**9, tick, "f", way, True, 20 + size, size, 7)
    rows = [at(1, 0, 0, 300), at(2, 1, 1, 100), at(3, 1, 0, 50), at(4, 2, 1, 0), at(5, 4, 0, 0), at(6, 4, 1, 0)]
    frame = spark.createDataFrame(rows, "pkt_no long, ts_ns long, tick long, flow_id string, dir int, is_tcp boolean, length long, data_length long, seq long")
    shuffled = features._segments(frame, ["flow_id"])
    assert sorted((r.ts_ns // 10**9, r.tick) for r in shuffled.collect()) == [(2, 1), (3, 1), (6, 4)]
    assert sorted((r.tick, r.seg, r.Len, r.DownPkts, r.DonwBytes, r.TsEnd) for r in features.video_segments_tick(frame, ["flow_id"]).collect()) == [(t, 1, 120, 1, 50, 0) for t in (1, 2, 3, 4)]


@pytest.mark.parametrize("name", ["service_lookup", "dns_asof_ttl", "known_service_filter"])
def test_packets_of_an_address_are_dealt_by_time(spark, small, name):
    shown = plan(QUERIES[name](spark, small))
    assert "bound_at" not in "".join(line for line in shown.splitlines() if "Join" in line)  # no packet meets all bindings of its address
    assert any("hashpartitioning(__ip" in line and "__bucket" in line for line in shown.splitlines())


def test_latest_binding_against_brute_force(spark):
    rng, s = random.Random(4), 10**9
    bound = {(rng.choice("abc"), rng.randrange(0, 90) * s // 2) for _ in range(60)}
    bindings = [(ip, at, at // s + rng.choice([0, 3, 40]), i, f"s{i}") for i, (ip, at) in enumerate(sorted(bound))]
    rows = [(i, rng.randrange(0, 400) * s // 4, rng.choice(["a", "b", "c", "d", None])) for i in range(500)]
    frame = spark.createDataFrame(rows, "pkt_no long, ts_ns long, service_ip string").repartition(3)
    table = spark.createDataFrame(bindings, "ip string, bound_at long, expires_s long, service_id int, service string")
    got = {r.pkt_no: r.dns_service for r in classify.asof_binding(frame, table).collect()}
    want = {}
    for no, ts, ip in rows:
        last = max((b for b in bindings if b[0] == ip and b[1] <= ts), key=lambda b: b[1], default=None)
        want[no] = last[4] if last and ts // s <= last[2] else None
    assert got == want and len(set(got.values())) > 5


def test_networks_of_odd_addresses(spark):
    texts = ["10.0.0.1", "10.0.0.256", "010.0.0.1", "10.0.0", "10.0.0.1.1", "127.0.0.1", "128.0.0.1", "169.254.3.4", "169.255.3.4", "172.15.0.1", "172.16.0.1", "172.31.255.255", "172.32.0.0", "192.168.1.1", "192.169.1.1", "", "x"]
    texts += ["::", "::1", "0:0:0:0:0:0:0:1", "::0001", "::00001", "0::1", "::1:1", "1::1", "::0.0.0.1", "fe80::1", "FE80::1", "fec0::1", "febf:1::", "fe8::1", "fc00::", "fd12:3456::7", "f::1", "fd00:1:2:3:4:5:6:7", "fd00:1:2:3:4:5:6", "fd00:1:2:3:4:5:6:7:8"]
    texts += ["fd00::1::2", "fd00:::1", ":fd00::1", "fd00::1:", "fd00::1:2:3:4:5:6", "fd00::1:2:3:4:5:6:7", "fd00::12345", "fd00::g", "2001:db8::1", "2001:dc0::1", "::ffff:10.0.0.1", "fd00::1.2.3.4"]
    own = [ipaddress.ip_network(x) for x in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "::1/128", "fe80::/10", "fc00::/7")]

    def within(text, nets):
        try:
            return any(ipaddress.ip_address(text) in n for n in nets)
        except ValueError:
            return False

    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", net.is_private(F.col("t")).alias("own"), net.is_rfc1918(F.col("t")).alias("rfc"), *(net.in_net(F.col("t"), n).alias(f"n{i}") for i, n in enumerate(("172.16.0.0/13", "2001:db8::/43", "fd00::/8"))))
    for r in rows.collect():
        t = r.t or ""
        assert (r.own, r.rfc) == (within(t, own), within(t, own[:3])), t
        assert [r.n0, r.n1, r.n2] == [within(t, [ipaddress.ip_network(n)]) for n in ("172.16.0.0/13", "2001:db8::/43", "fd00::/8")], t


def test_an_address_is_looked_at_a_few_times(spark, small):
    shown = QUERIES["local_private"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("RLIKE") + shown.count("split(") < 60


def test_streams_make_only_what_features_read(spark, small):
    from flowloom.streaming import lookup, runs

    made = runs.flow_values(seen(spark, small).withColumn("flow_id", F.lit("f")), False)
    assert "hw_addr" not in made._jdf.queryExecution().optimizedPlan().toString()

    class Kept:
        def appendList(self, rows):
            sizes.append(len(rows))

    sizes: list[int] = []
    state = lookup.Bindings()
    state.waiting, state._wake = Kept(), lambda at: None
    packet = Row(kind=lookup.PACKET, ts_ns=1, no=1, body="{}")
    list(state.handleInputRows(("a", 0), iter([packet] * 2500), None))
    assert max(sizes) <= lookup.CHUNK and sum(sizes) == 2500
