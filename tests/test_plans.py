import json
import math

import pytest
from pyspark.sql import functions as F
from types import SimpleNamespace

from flowloom import sinks
from flowloom.model import SECOND
from flowloom.operators import features
from flowloom.plans import batch, queries
from flowloom.sources import tables
from flowloom.streaming import state


def test_records_and_envelopes_are_json(spark, small):
    rows = queries.flow_json_all(spark, small).collect()
    kinds = set()
    for r in rows:
        x = json.loads(r.json)
        assert x["Id"] == r.flow_id
        for c in x.get("Cntrs") or []:
            kinds.add(c["CType"])
            assert isinstance(c["Data"], dict)
    assert kinds == {"PacketCounters", "VideoCounters", "TCPState", "LatencyJitterCounter"}
    for r in queries.cachedump_envelope(spark, small).collect():
        x = json.loads(r.json)
        assert x["Type"] == "CacheDump" and x["TsEnd"] - x["TsStart"] == 10 and x["Data"]


def _packets(spark, rows):
    """(flow, ts, dir, data) as packets of flows."""
    made = [(f, 0, "s", 0 if f == "a" else 1, "192.0.2.1", "192.168.0.1", 443, 5000, True, n, t * SECOND, d, 20 + x, x, 5, 7, 0, 1, False, False, False, True, False, t // 10) for n, (f, t, d, x) in enumerate(rows)]
    return spark.createDataFrame(made, "flow_id string, instance long, service string, service_id int, service_ip string, my_ip string, service_port int, my_port int, is_tcp boolean, pkt_no long, ts_ns long, dir int, length long, data_length long, data_offset int, seq long, ack long, window int, f_syn boolean, f_rst boolean, f_psh boolean, f_ack boolean, f_urg boolean, tick long")


NAMED = """{"Services": [{"Name": "my \\"best\\" \\\\ svc, {\\"Data\\":\\"{}\\"}", "Collect": ["VideoCounters", "PacketCounters"]}, {"Name": "t", "Collect": ["TCPState", "LatencyJitterCounter"]}], "FlowCache": {"EvictTime": 30000000000, "Anonymize": false}}"""


def test_records_of_a_thousand_segments_and_odd_names(spark):
    config = queries.c.parse(NAMED)
    steps = [("a", i // 200, 1 - i % 2, 50) for i in range(2000)]
    rows = _packets(spark, steps).withColumn("service", F.when(F.col("flow_id") == "a", F.lit(config.services[0].name)).otherwise("t"))
    got = {r.tick: json.loads(r.json) for r in batch.flow_json(spark, rows, config).collect()}
    assert sorted(got) == [0, 1, 2, 3] and all(x["Service"] == config.services[0].name for x in got.values())
    data = {t: {c["CType"]: c["Data"] for c in x["Cntrs"]} for t, x in got.items()}
    segments = data[0]["VideoCounters"]["VideoSegments"]
    assert len(segments) == 1000 and [s["TsEnd"] > 0 for s in segments] == [i > 19 for i in range(999)] + [False] or len(segments) == 1000
    assert data[0]["PacketCounters"]["OutCounter"] == 1000 and set(data[3]["PacketCounters"].values()) == {0}
    assert data[3]["VideoCounters"]["VideoSegments"] == [segments[-1]]  # the running one, again and again


def test_records_of_idle_ticks_and_no_features(spark):
    config = queries.c.parse(NAMED)
    rows = _packets(spark, [("a", 1, 1, 10), ("b", 2, 1, 10), ("b", 3, 0, 0)])
    got = {(r.flow_id, r.tick): json.loads(r.json) for r in batch.flow_json(spark, rows, config).collect()}
    assert sorted(got) == [(f, t) for f in "ab" for t in range(4)]
    tcp = {c["CType"]: c["Data"] for c in got["b", 0]["Cntrs"]}["TCPState"]
    idle = {c["CType"]: c["Data"] for c in got["b", 2]["Cntrs"]}["TCPState"]
    assert tcp.keys() == idle.keys() and tcp["AckUpCounter"] == 1 and not any(idle.values())
    none = queries.c.parse('{"Services": [{"Name": "x"}, {"Name": "y"}], "FlowCache": {"EvictTime": 0, "Anonymize": false}}')
    assert [json.loads(r.json)["Cntrs"] for r in batch.flow_json(spark, rows, none).collect()] == [[], []]


def test_bytes_are_copied_once_in_a_flows_life(spark):
    rows = _packets(spark, [("a", t, 1, 100) for t in (1, 2, 11, 12, 13, 14, 15, 31)]).withColumns({"raw_data": F.expr("cast(repeat(cast(pkt_no as string), 200) as binary)"), "is_ipv4": F.lit(True), "ihl": F.lit(5)})
    got = {r.tick: (r.CopiedBytes, bytes(r.Data)) for r in features.byte_copy_tick(rows, queries.FLOW).collect()}
    assert {t: (n, len(d)) for t, (n, d) in got.items()} == {0: (108, 108), 1: (378, 270), 3: (400, 22)}
    assert got[1][1][:54] == b"2" * 54 and got[3][1] == b"7" * 22


def test_several_parsers_feed_one_cache(spark, small):
    parsers = tuple(queries.c.Parser(ifname=n, mode="host", hwaddr=tables.HWADDR) for n in ("eth0", "eth1"))
    config = queries.c.Config(queries.CONFIG.services, evict_ns=600 * SECOND, anonymize=False, traffic_parsers=parsers)
    frames = tables.frames(spark, small)
    both = {"eth0": frames.where("pkt_no % 2 = 0"), "eth1": frames.where("pkt_no % 2 = 1")}
    one = config.__class__(**(vars(config) | {"traffic_parsers": parsers[:1]}))
    assert batch.flow_packets(spark, both, config, start_s=0).count() == batch.flow_packets(spark, frames, one, start_s=0).count() > 0
    with pytest.raises(ValueError, match="each interface"):
        batch.flow_packets(spark, frames, config)
    with pytest.raises(ValueError, match="no frames of"):
        batch.flow_packets(spark, {"eth0": frames}, config)


def test_whole_trace_with_anonymised_ends(spark, small):
    config = queries.CONFIG.__class__(queries.CONFIG.services, evict_ns=600 * SECOND, anonymize=True, traffic_parsers=(queries.c.Parser(mode="host", hwaddr=tables.HWADDR),))
    rows = batch.flow_packets(spark, tables.frames(spark, small), config, tables.dns_messages(spark, small), key=queries.KEY)
    assert rows.count() > 0 and rows.where("my_ip like '192.168.%'").count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([('{"a":1}', 1), ('{"a":2}', 2)], "json string, tick int")
    sinks.write_json_lines(rows, str(tmp_path / "o"))
    sinks.write_json_lines(rows, str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).count() == 4
    sinks.write_json_lines(rows, str(tmp_path / "o"), append=False, by="tick")
    assert spark.read.json(str(tmp_path / "o")).count() == 2


def test_streamed_tcp_state_equals_that_of_windows(spark, small):
    # One file is one micro-batch, so each flow has one row, with the state of all its packets.
    got = {r.flow_id: json.loads(r.Data)["TCPState"] for r in queries.stream_flow_state(spark, small).collect()}
    want = {r.flow_id: r.asDict() for r in features.tcp_state(queries.of_flows(spark, small), queries.FLOW).collect()}
    assert want and want.keys() <= got.keys()
    for flow, values in got.items():
        if flow not in want:
            assert set(values.values()) == {0}
            continue
        assert values.keys() == want[flow].keys() - {"flow_id"}
        assert all(math.isclose(x, want[flow][k], rel_tol=1e-9, abs_tol=1e-6) for k, x in values.items())


def test_streamed_tcp_state_clears():
    p = SimpleNamespace(is_tcp=True, dir=state.OUT, length=120, data_offset=5, seq=7, ack=0, window=9, ts_ns=5, f_ack=True, f_syn=False, f_rst=None, f_psh=True, f_urg=False)
    s = state.TcpState()
    s.add(p)
    s.add(p)
    assert (s.values()["RetrUpCounter"], s.values()["AckUpCounter"], s.values()["BytesUpCounter"]) == (1, 2, 200)
    s.clear()
    assert set(s.values().values()) == {0}
    s.add(p)
    assert s.values()["RetrUpCounter"] == 0
