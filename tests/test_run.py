"""A configuration from capture files to records."""

import json

import pytest

from flowloom import run
from flowloom.sources import decode
from tests.test_network import TRACE, dns, frame, tcp, udp

CONFIG = {
    "Services": [{"Name": "Named", "Filter": {"DomainsString": ["example"]}, "Collect": ["PacketCounters"]}, {"Name": "Net", "Filter": {"Prefixes": ["23.246.0.0/16"]}, "Collect": ["PacketCounters", "VideoCounters"]}],
    "Parsers": {"TrafficParsers": [{"Ifname": "eth0", "Mode": "host", "HwAddr": "02:00:00:00:00:01"}]},
    "FlowCache": {"EvictTime": 15_000_000_000, "Anonymize": False},
    "Stats": {"Run": True, "Append": False},
}


def test_command(spark, tmp_path):
    for name in ("eth0", "dns"):
        (tmp_path / name).mkdir()
    more = [(12_000_000_000, frame("192.168.0.5", "1.1.1.9", 6, tcp(5001, 443, 10, 0, 2))), (13_000_000_000, frame("192.168.0.5", "9.9.9.9", 17, udp(1, 2)))]
    (tmp_path / "eth0" / "a.pcap").write_bytes(decode.write_pcap([*TRACE, *more]))
    (tmp_path / "dns" / "a.pcap").write_bytes(decode.write_pcap([(2_500_000_000, frame("8.8.8.8", "192.168.0.5", 17, udp(53, 4001, dns("api.example.net", [(1, 60, bytes([1, 1, 1, 9]))]))))]))
    (tmp_path / "c.json").write_text(json.dumps(CONFIG))
    for _ in range(2):  # the second run takes the first one's place
        run.main(["--conf", str(tmp_path / "c.json"), "--captures", f"eth0={tmp_path}/eth0", "--dns", f"{tmp_path}/dns", "--out", f"{tmp_path}/out"])
    dumped = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out/dump").collect()]
    flows = {(d["TsStart"], f["Service"]): {x["CType"]: x["Data"] for x in f["Cntrs"]} for d in dumped for f in d["Data"]}
    assert flows[1, "Net"]["PacketCounters"] == {"InCounter": 1, "OutCounter": 1, "InBytes": 23, "OutBytes": 20}
    assert flows[11, "Named"]["PacketCounters"]["OutCounter"] == 1
    assert set(flows) == {(1, "Net"), (11, "Net"), (11, "Named"), (21, "Named")}
    stats = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out/ifstats").collect()]
    assert {s["TsStart"]: s["Data"][0]["PktRecv"] for s in stats} == {1: len(TRACE), 11: 2}
    with pytest.raises(ValueError, match="no frames of"):
        run.main(["--conf", str(tmp_path / "c.json"), "--captures", f"eth1={tmp_path}/eth0"])


def test_profiles(spark, tmp_path):
    from flowloom import config, profiles

    for i in range(2):
        (tmp_path / f"{i}.pcap").write_bytes(decode.write_pcap(TRACE))
    rows = profiles.folder(spark, str(tmp_path), config.parse(json.dumps(CONFIG)), "02:00:00:00:00:01", 1).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.feature, r.packets) for r in rows) == [(f"{i}.pcap", n, 3) for i in range(2) for n in ("PacketCounters", "VideoCounters")]
    assert all(r.ns_per_packet > 0 and r.median_ns_per_packet >= r.ns_per_packet for r in rows)
    sized = spark.createDataFrame([(0, "é"), (0, "abc"), (1, "")], "tick long, json string")
    assert sorted(tuple(r) for r in profiles.storage(sized).collect()) == [(0, 2, 5, 3), (1, 1, 0, 0)]


def test_collectors_rotate_in_periods_of_their_own(spark, tmp_path):
    from flowloom import sinks

    def put(times):
        spark.createDataFrame([(t, f'{{"t":{t}}}') for t in times], "ts_s long, json string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run_all():
        source = spark.readStream.schema("ts_s long, json string").parquet(f"{tmp_path}/in")
        kinds = {"flows": sinks.Collector(source, None, 60), "stats": sinks.Collector(source.where("ts_s % 2 = 0"), None)}
        for q in sinks.collect(kinds, f"{tmp_path}/out", f"{tmp_path}/c").values():
            q.awaitTermination()

    put([0, 59, 60])
    run_all()
    put([61, 7200])
    run_all()  # a restart repeats nothing
    flows = spark.read.text(f"{tmp_path}/out/flows").collect()
    assert sorted((r.period, r.value) for r in flows) == [("1970-01-01T00-00-00", '{"t":0}'), ("1970-01-01T00-00-00", '{"t":59}'), ("1970-01-01T00-01-00", '{"t":60}'), ("1970-01-01T00-01-00", '{"t":61}'), ("1970-01-01T02-00-00", '{"t":7200}')]
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out/stats").collect()) == ['{"t":0}', '{"t":60}', '{"t":7200}']
    with pytest.raises(ValueError, match="folders"):
        sinks.collect({"a/b": sinks.Collector(spark.range(1))}, "x", "y")
