"""Addresses, anonymisation, captures, configuration."""

import ipaddress
import random
import struct

import pytest
from pyspark.sql import functions as F

from flowloom import config
from flowloom.functions import net
from flowloom.functions.anonymize import Anonymizer
from flowloom.operators import classify, flows, packets, registry
from flowloom.sources import decode, generate, pcap

# The key and addresses of the published sample trace.
KEY = bytes([21, 34, 23, 141, 51, 164, 207, 128, 19, 10, 91, 22, 73, 144, 125, 16, 216, 152, 143, 131, 121, 121, 101, 39, 98, 87, 76, 45, 42, 132, 34, 2])
SAMPLE = {
    "4.3.88.225": "124.60.155.63",
    "10.185.25.118": "117.161.29.118",
    "24.0.250.221": "100.15.198.226",
    "24.5.0.80": "100.9.15.210",
    "24.7.198.88": "100.10.6.25",
    "24.13.62.231": "100.2.192.247",
    "24.14.213.138": "100.1.42.141",
    "24.94.26.44": "100.88.228.35",
    "38.15.67.68": "64.3.66.187",
    "63.14.55.111": "95.9.215.7",
    "63.97.7.140": "95.97.9.123",
    "63.195.241.44": "95.179.238.44",
    "64.14.118.196": "0.255.183.58",
    "64.34.154.117": "0.221.154.117",
    "64.39.15.238": "0.219.7.41",
    "128.11.68.132": "135.242.180.132",
    "129.118.74.4": "134.136.186.123",
    "130.132.252.244": "133.68.164.234",
    "141.223.7.43": "141.167.8.160",
    "141.233.145.108": "141.129.237.235",
    "152.163.225.39": "151.140.114.167",
    "156.29.3.236": "147.225.12.42",
    "165.247.96.84": "162.9.99.234",
    "166.107.77.190": "160.132.178.185",
    "192.41.57.43": "252.222.221.184",
    "192.102.249.13": "252.138.62.131",
    "192.215.32.125": "252.43.47.189",
    "192.233.80.103": "252.25.108.8",
    "193.150.244.223": "253.169.52.216",
    "195.205.63.100": "255.186.223.5",
    "198.26.132.101": "249.36.123.202",
    "198.36.213.5": "249.7.21.132",
    "198.51.77.238": "249.18.186.254",
    "198.200.171.101": "249.199.68.213",
    "199.217.79.101": "248.38.184.213",
    "202.49.198.20": "245.206.7.234",
    "203.12.160.252": "244.248.163.4",
    "204.29.20.4": "243.33.20.123",
    "204.184.162.189": "243.192.77.90",
    "204.202.136.230": "243.178.4.198",
    "205.178.38.67": "242.108.198.51",
    "205.188.147.153": "242.96.16.101",
    "205.188.248.25": "242.96.88.27",
    "205.245.121.43": "242.21.121.163",
    "207.25.71.27": "241.33.119.156",
    "207.33.151.131": "241.1.233.131",
    "207.105.49.5": "241.118.205.138",
    "207.135.65.238": "241.202.129.222",
    "207.155.9.214": "241.220.250.22",
    "207.188.7.45": "241.255.249.220",
    "208.28.185.184": "227.39.94.90",
    "208.52.56.122": "227.8.63.165",
    "208.147.89.59": "227.237.98.191",
    "208.234.120.210": "227.154.67.17",
    "209.12.231.7": "226.243.167.8",
    "209.68.60.238": "226.184.220.233",
    "209.85.249.6": "226.170.70.6",
    "209.238.72.3": "226.6.119.243",
    "209.246.74.109": "226.22.124.76",
    "212.120.124.31": "228.135.163.231",
    "212.146.8.236": "228.19.4.234",
    "212.186.227.154": "228.59.98.98",
    "212.204.172.118": "228.71.195.169",
    "212.206.130.201": "228.69.242.193",
    "216.32.132.250": "235.192.139.38",
    "216.35.217.178": "235.195.157.81",
    "216.148.237.145": "235.84.194.111",
    "216.157.30.252": "235.89.31.26",
    "216.184.159.48": "235.96.225.78",
    "216.227.10.221": "235.28.253.36",
    "216.254.18.172": "235.7.16.162",
    "::1": "78ff:f001:9fc0:20df:8380:b1f1:704:ed",
    "::2": "78ff:f001:9fc0:20df:8380:b1f1:704:ef",
    "::ffff": "78ff:f001:9fc0:20df:8380:b1f1:704:f838",
    "2001:db8::1": "4401:2bc:603f:d91d:27f:ff8e:e6f1:dc1e",
    "2001:db8::2": "4401:2bc:603f:d91d:27f:ff8e:e6f1:dc1c",
}


def test_anonymizer_gives_published_addresses(spark):
    rows = spark.createDataFrame([(k, k) for k in [*SAMPLE, *SAMPLE]] + [("x", "x"), (None, None)], "plain string, ip string")
    got = {r.plain: r.ip for r in Anonymizer(spark, KEY).apply(rows, "ip").collect()}
    assert got == SAMPLE | {"x": "x", None: None}
    alone = spark.createDataFrame([(k,) for k in SAMPLE], "plain string")
    assert {r.plain: r.ip for r in alone.select("plain", Anonymizer(spark, KEY).ip(F.col("plain")).alias("ip")).collect()} == SAMPLE
    with pytest.raises(ValueError, match="32 bytes"):
        Anonymizer(spark, b"short")


def test_prefixes_are_enciphered_once(spark):
    rng = random.Random(7)
    some = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(20)] + [f"10.1.{i}.{i}" for i in range(20)] + [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(4)] + ["0.0.0.0", "255.255.255.255", "::"]
    rows = spark.createDataFrame([(x, x) for x in some], "plain string, ip string")
    own = Anonymizer(spark, bytes(range(40, 72)))
    want = {r.plain: r.ip for r in rows.select("plain", own.ip(F.col("ip")).alias("ip")).collect()}
    assert {r.plain: r.ip for r in own.apply(rows, "ip").collect()} == want


def test_addresses(spark):
    rng = random.Random(1)
    six = [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(20)] + ["::", "::1", "1::", "1:2::8", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8"]
    bad = ["", "1.2.3", "1.2.3.256", "1:2", ":::", "1::2::3", "12345::", None, "g::"]
    rows = spark.createDataFrame([(x,) for x in [*six, *bad, "1.2.3.4", "255.255.255.255"]], "ip string").select("ip", net.ip_bits(F.col("ip")).alias("bits")).collect()
    got = {r.ip: r.bits for r in rows}
    for x in six:
        assert got[x] == bin(int(ipaddress.IPv6Address(x)))[2:].zfill(128), x
    assert all(got[x] is None for x in bad), {x: got[x] for x in bad}
    assert got["1.2.3.4"] == "00000001000000100000001100000100"


def test_private_and_hashes(spark):
    row = spark.createDataFrame([("172.31.0.1", "172.32.0.1", "127.0.0.1", "fe80::1", "8.8.8.8", "foo")], "a string, b string, c string, d string, e string, t string")
    got = row.select(net.is_rfc1918(F.col("a")), net.is_rfc1918(F.col("b")), net.is_private(F.col("c")), net.is_private(F.col("d")), net.is_private(F.col("e")), net.fnv32(F.col("t")), net.tuple_hash(F.col("a"), F.col("b")) == net.tuple_hash(F.col("b"), F.col("a"))).first()
    want = 2166136261
    for b in b"foo":
        want = (want * 16777619 % 2**32) ^ b
    assert tuple(got) == (True, False, True, True, False, want, True)
    with pytest.raises(ValueError, match="no such mode"):
        net.direction("replay", F.col("a"), F.col("b"), "x")


def frame(src, dst, proto, body, vlan=False, macs=("02:00:00:00:00:01", "02:00:00:00:00:02")):
    mac = lambda m: bytes.fromhex(m.replace(":", ""))
    a, b = ipaddress.ip_address(src), ipaddress.ip_address(dst)
    tag = struct.pack(">HH", 0x8100, 5) if vlan else b""
    if a.version == 4:
        ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0, a.packed, b.packed)
    else:
        ip = struct.pack(">IHBB16s16s", 6 << 28, len(body), proto, 64, a.packed, b.packed)
    return mac(macs[1]) + mac(macs[0]) + tag + struct.pack(">H", 0x0800 if a.version == 4 else 0x86DD) + ip + body


def tcp(sport, dport, seq, ack, flags, data=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, seq, ack, 5 << 4, flags, 500, 0, 0) + data


def udp(sport, dport, data=b""):
    return struct.pack(">HHHH", sport, dport, 8 + len(data), 0) + data


def dns(name, answers):
    encoded = b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\0"
    out = struct.pack(">HHHHHH", 1, 0x8180, 1, len(answers), 0, 0) + encoded + struct.pack(">HH", 1, 1)
    for kind, ttl, data in answers:
        out += b"\xc0\x0c" + struct.pack(">HHIH", kind, 1, ttl, len(data)) + data
    return out


TRACE = [
    (1_000_000_001, frame("192.168.0.5", "23.246.1.1", 6, tcp(5000, 443, 10, 0, 2))),
    (1_000_000_500, frame("23.246.1.1", "192.168.0.5", 6, tcp(443, 5000, 7, 11, 18, b"abc"), vlan=True, macs=("02:00:00:00:00:02", "02:00:00:00:00:01"))),
    (2_000_000_000, frame("2001:db8::1", "2620:10c:7000::9", 17, udp(4000, 443, b"x" * 120))),
    (2_500_000_000, frame("8.8.8.8", "192.168.0.5", 17, udp(53, 4001, dns("api.example.net", [(5, 9, b"\xc0\x0c"), (1, 60, bytes([1, 1, 1, 9]))])))),
    (2_600_000_000, frame("192.168.0.5", "8.8.8.8", 17, udp(4001, 53, dns("q.example.net", [])))),
    (3_000_000_000, b"\0" * 10),
    (3_100_000_000, frame("192.168.0.5", "23.246.1.1", 6, b"short")),
    (3_200_000_000, frame("192.168.0.5", "23.246.1.1", 47, b"gre")),
]


@pytest.mark.parametrize("ns", [True, False])
def test_capture_files(spark, tmp_path, ns):
    for i in range(2):
        (tmp_path / f"t{i}.pcap").write_bytes(decode.write_pcap(TRACE, ns))
    (tmp_path / "empty.pcap").write_bytes(b"")
    rows = [r for r in pcap.read_frames(spark, str(tmp_path), include_raw=True).collect() if r.path.endswith("t0.pcap")]
    assert len(rows) == len(TRACE) and [bytes(r.raw_data) for r in sorted(rows, key=lambda r: r.pkt_no)] == [f for _, f in TRACE]
    assert {r.pkt_no: r.ts_ns for r in rows} == {i: t if ns else t // 1000 * 1000 for i, (t, _) in enumerate(TRACE)}
    first = pcap.read_frames(spark, str(tmp_path / "t0.pcap"), "traffic")
    got = packets.project(first, "host", "02:00:00:00:00:01").orderBy("pkt_no").collect()
    assert [(r.dir, r.service_ip, r.service_port, r.length, r.data_length, r.is_tcp) for r in got] == [(1, "23.246.1.1", 443, 20, 0, True), (0, "23.246.1.1", 443, 23, 3, True), (1, "2620:10c:7000::9", 443, 128, 120, False)]
    assert got[0].f_syn and got[1].f_ack and got[1].seq == 7 and got[2].seq == 0
    assert pcap.read_frames(spark, str(tmp_path / "t0.pcap"), "dns").count() == 2
    messages = pcap.read_dns(spark, str(tmp_path / "t0.pcap"))
    assert messages.count() == 2 and pcap.read_dns(spark, str(tmp_path / "t0.pcap"), answered=True).count() == 1
    names = classify.dns_names(messages).collect()
    assert [(r.name, r.ip, r.ttl) for r in names] == [("api.example.net", "1.1.1.9", 60)]
    pcap.register(spark)
    assert spark.read.format("pcap").option("bpf", "traffic").load(str(tmp_path / "t0.pcap")).count() == first.count()


def test_capture_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"t{i}.pcap").write_bytes(decode.write_pcap(TRACE))
    run = pcap.stream_frames(spark, str(tmp_path / "in"), "traffic").select("pkt_no").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert run.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12  # a TCP frame that ends early passes the filter


def test_bad_captures():
    with pytest.raises(ValueError, match="not a capture"):
        list(decode.read_pcap(b"hello, this is no capture file"))
    whole = decode.write_pcap(TRACE)
    assert len(list(decode.read_pcap(whole[:-3]))) == len(TRACE) - 1
    assert decode.decode_dns(b"\0\1") is None
    assert decode.decode_dns(struct.pack(">HHHHHH", 1, 0, 1, 0, 0, 0) + b"\xc0\x0c") is None


CONFIG = '{"Services": [{"Name": "A", "Filter": {"DomainsString": ["mazon.com"], "Prefixes": ["10.0.0.0/8", "10.1.0.0/16"]}, "Features": ["PacketCounters"]}, {"Name": "B", "Filter": {"DomainsRegex": ["^x.*y$"], "Prefixes": ["10.1.0.0/16", "2001:db8::/32"]}}]}'


def test_configuration(spark, tmp_path):
    c = config.parse(CONFIG).validate(registry.names())
    assert c.anonymize and c.evict_ns == 600 * 10**9 and c.services[0].collect == ("PacketCounters",)
    for bad, message in (('{"Services": [{"Name": "A"}, {"Name": "A"}]}', "unique"), ('{"Services": [{"Name": "A", "Collect": ["Nope"]}]}', "no such feature"), ('{"Services": [{"Name": "A", "Filter": {"Prefixes": ["1.2.3.4/8"]}}]}', "host bits"), ('{"Stats": {"Mode": "x"}}', "Stats.Mode")):
        with pytest.raises(ValueError, match=message):
            config.parse(bad).validate(registry.names())
    with pytest.raises(ValueError, match="no such feature"):
        registry.get("Nope")
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "none.json"))
    (tmp_path / "c.json").write_text(CONFIG)
    assert config.load(str(tmp_path / "c.json")) == config.parse(CONFIG)


def test_every_prefix_matches_and_the_first_wins(spark):
    c = config.parse(CONFIG)
    ips = spark.createDataFrame([("10.1.2.3",), ("10.2.0.1",), ("2001:db8::7",), ("11.0.0.1",), (None,), ("?",)], "ip string")
    assert {(r.ip, r.service, r.prefix) for r in classify.cidr_first_match(spark, ips, c).collect()} == {("10.1.2.3", "A", "10.0.0.0/8"), ("10.2.0.1", "A", "10.0.0.0/8"), ("2001:db8::7", "B", "2001:db8::/32")}
    assert classify.cidr_matches(spark, ips, c).where("ip = '10.1.2.3'").count() == 3


def message(spark, rows):
    return spark.createDataFrame([(n, t, [{"name": q}], [{"ip": i, "ttl": x}]) for n, t, q, i, x in rows], "dns_no long, ts_ns long, questions array<struct<name:string>>, answers array<struct<ip:string,ttl:long>>")


def test_bindings_in_time(spark):
    c = config.parse(CONFIG)
    s = 10**9
    seen = message(spark, [(1, 10 * s, "amamazon.com", "9.9.9.9", 100), (2, 20 * s, "x1y", "9.9.9.9", 5), (3, 50 * s, "mazon.com", "8.8.8.8", 0), (4, 60 * s, "other", "9.9.9.9", 100)])
    bound = classify.dns_bindings(classify.dns_first_match(spark, seen, c), 30 * s)
    asked = [(1, 9 * s, "9.9.9.9", None), (2, 10 * s, "9.9.9.9", "A"), (3, 20 * s, "9.9.9.9", "B"), (4, 25 * s + 5, "9.9.9.9", "B"), (5, 26 * s, "9.9.9.9", None), (6, 80 * s, "8.8.8.8", "A"), (7, 81 * s, "8.8.8.8", None), (8, 5, None, None)]
    rows = spark.createDataFrame(asked, "pkt_no long, ts_ns long, service_ip string, want string")
    got = classify.asof_binding(rows, bound).collect()
    assert {r.pkt_no: r.dns_service for r in got} == {a[0]: a[3] for a in asked}


def test_flows_start_classified_and_split_when_idle(spark):
    rows = [(1, 0, None), (2, 10, 1), (3, 20, 2), (4, 200, None), (5, 210, 2), (6, 215, None)]
    frame = spark.createDataFrame([(n, t, s, s and f"s{s}", "1.1.1.1", "2.2.2.2", 1, 2, True) for n, t, s in rows], "pkt_no long, ts_ns long, service_id int, service string, service_ip string, my_ip string, service_port int, my_port int, is_tcp boolean")
    got = flows.flow_packets(frame, 100).orderBy("pkt_no").collect()
    assert [(r.pkt_no, r.instance, r.service) for r in got] == [(2, 0, "s1"), (3, 0, "s1"), (5, 1, "s2"), (6, 1, "s2")]
    assert flows.flows(flows.flow_packets(frame, 100)).count() == 2


def test_random_trace_and_lines(spark, tmp_path):
    rows = generate.random_trace(spark, 200, 3).collect()
    assert all(int(r.hw_addr[:2], 16) & 3 == 2 and r.data_length == r.length - 20 for r in rows)
    (tmp_path / "l.txt").write_text("a\nb\n")
    assert [r.value for r in generate.text_lines(spark, str(tmp_path / "l.txt")).collect()] == ["a", "b"]
    assert generate.text_lines(spark, str(tmp_path / "none")).count() == 0


def test_columns_of_frames_are_those_of_each_frame():
    """Random, damaged and cut frames through both decoders."""
    import numpy as np

    from flowloom.sources import columnar

    rng = random.Random(11)
    frames = []
    for _ in range(4000):
        raw = bytearray(rng.choice(TRACE)[1])
        if rng.random() < 0.3:  # stacked tags
            raw[12:12] = b"\x81\x00\x00\x01" * rng.randrange(1, 3)
        if rng.random() < 0.3 and len(raw) > 54 and raw[12:14] == b"\x86\xdd":  # an extension header
            raw[20:21] = b"\x00"
            raw[54:54] = bytes([rng.choice([17, 6, 43, 60]), rng.randrange(2)]) + bytes(6)
        for _ in range(rng.choice([0, 0, 1, 3])):
            if raw:
                raw[rng.randrange(min(len(raw), 60))] = rng.randrange(256)
        frames.append(bytes(raw[: rng.choice([len(raw), len(raw), rng.randrange(len(raw) + 1)])]))
    size = np.array([len(f) for f in frames])
    start = np.cumsum(size) - size
    kept, got = columnar.decode(np.frombuffer(b"".join(frames), np.uint8), start, size)
    got = {n: c.to_pylist() for n, c in got.items()}
    for i, f in enumerate(frames):
        assert {n: got[n][i] for n in decode.FIELDS} == decode.decode_frame(f)[0], f
    assert len(kept) == len(frames)
    only, some = columnar.decode(np.frombuffer(b"".join(frames), np.uint8), start, size, pcap.WANTED["dns"])
    assert only.tolist() == [i for i in range(len(frames)) if got["proto"][i] == 17 and 53 in (got["src_port"][i], got["dst_port"][i])]
    assert some["src_ip"].to_pylist() == [got["src_ip"][i] for i in only.tolist()]


@pytest.mark.parametrize("order", ["<", ">"])
def test_records_of_a_file(order):
    from flowloom.sources import columnar

    whole = decode.write_pcap(TRACE)
    if order == ">":
        body = b"".join(struct.pack(">IIII", t // 10**9, t % 10**9, len(f), len(f)) + f for t, f in TRACE)
        whole = struct.pack(">IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 1) + body
    for cut in (0, 1, 3, 17, 40):
        raw = whole[: len(whole) - cut]
        times, start, size = columnar.records(raw)
        assert [(t, raw[a : a + n]) for t, a, n in zip(times.tolist(), start.tolist(), size.tolist(), strict=True)] == list(decode.read_pcap(raw))
    assert [len(x) for x in columnar.records(whole[:24])] == [0, 0, 0] == [len(x) for x in columnar.records(b"")]
    with pytest.raises(ValueError, match="no|not"):
        columnar.records(b"hello, this is no capture file")


def test_filters_are_pushed_into_the_source(spark, tmp_path):
    (tmp_path / "t.pcap").write_bytes(decode.write_pcap(TRACE))
    pcap.register(spark)
    rows = spark.read.format("pcap").load(str(tmp_path / "t.pcap")).where("proto = 17 and dst_port in (53, 443) and ts_ns > 0")
    assert sorted(r.pkt_no for r in rows.collect()) == [2, 4]
    reader = pcap.PcapSource({"path": str(tmp_path / "t.pcap")}).reader(None)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    other = GreaterThan(("ts_ns",), 5)
    assert list(reader.pushFilters([EqualTo(("proto",), 6), other])) == [other] and reader.pushed == [("proto", [6])]


def test_names_against_very_many_patterns(spark, monkeypatch):
    from flowloom.functions import patterns as own

    rng = random.Random(5)
    many = [f"{rng.getrandbits(40):x}." for _ in range(100_000)] + ["example", "ample.n", "", "a", "example"]
    texts = ["x.example.net", "nothing", many[7] + many[9] + "org", "", "éa"]
    services = [config.Service("A", tuple(many[:60_000])), config.Service("B", tuple(many[60_000:]), (r"^x[.].*net$", "é"))]
    names = spark.createDataFrame([(t,) for t in [*texts, texts[0], None]], "name string")
    found = classify.name_matches(spark, names.where("name is not null"), config.Config(tuple(services)))
    got = sorted((r.name, r.kind, r.service, r.pos) for r in found.collect())
    want = [(t, 0, s.name, j) for t in texts for s in services for j, d in enumerate(s.domains) if d in t]
    assert got == sorted([*want, ("x.example.net", 1, "B", 0), ("éa", 1, "B", 1)])
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(own, "PATTERN_BYTES", 9)
    few = own.with_found(names, "name", ["example", "ample.n", "", "a", "x."])
    assert sorted((r.text, r.number) for r in few.collect()) == sorted((t, i) for t in [*texts, texts[0]] for i, p in enumerate(["example", "ample.n", "", "a", "x."]) if p in t)


def test_stream_of_a_growing_capture(spark, tmp_path):
    pcap.register(spark)
    (tmp_path / "in").mkdir()
    whole = decode.write_pcap(TRACE)
    ends = [24]
    for _, f in TRACE:
        ends.append(ends[-1] + 16 + len(f))

    def more(name, raw):
        with open(tmp_path / "in" / name, "ab") as f:
            f.write(raw)
        run = spark.readStream.format("pcap").load(f"{tmp_path}/in").select("ts_ns", "pkt_no", "dst_port").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        run.awaitTermination()
        return sorted((r.ts_ns, r.pkt_no) for r in spark.read.schema("ts_ns long, pkt_no long").parquet(f"{tmp_path}/out").collect())

    times = [t for t, _ in TRACE]
    assert more("a.pcap", whole[: ends[2] + 5]) == [(times[i], ends[i]) for i in range(2)]  # the third record is half written
    assert more("a.pcap", whole[ends[2] + 5 : ends[4]]) == [(times[i], ends[i]) for i in range(4)]
    got = more("b.pcap", decode.write_pcap(TRACE[:1])[:-1])  # nothing whole yet
    assert got == [(times[i], ends[i]) for i in range(4)]
    got = more("b.pcap", decode.write_pcap(TRACE[:1])[-1:])
    assert got == sorted([(times[i], ends[i]) for i in range(4)] + [(times[0], 24)])
