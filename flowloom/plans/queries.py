"""One query for each operator, over frames, packets and DNS messages derived from the test tables.

Results are flat; fractions are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom import config as c
from flowloom import profiles
from flowloom.functions import net, welford
from flowloom.functions.anonymize import Anonymizer
from flowloom.model import SECOND
from flowloom.operators import classify, features, flows, packets, registry
from flowloom.plans import batch
from flowloom.sources import generate, pcap, tables

#: Services of the test queries, of ranges for documentation. The second service's first prefix lies within the first one's.
CONFIG = c.parse(
    """{"Services": [
  {"Name": "Stream", "Filter": {"DomainsString": ["example.net", "th.example"], "Prefixes": ["198.51.100.0/24", "203.0.113.0/25", "2001:db8::/44"]}, "Collect": ["PacketCounters", "VideoCounters"]},
  {"Name": "Blog", "Filter": {"DomainsString": ["blog."], "DomainsRegex": ["^m[.].*[.]org$", "ing[.]example[.]com"], "Prefixes": ["198.51.100.0/25", "192.0.2.0/25", "2001:db8:1::/48"]}, "Collect": ["PacketCounters", "TCPState", "LatencyJitterCounter"]},
  {"Name": "Rest", "Filter": {"DomainsRegex": ["example[.]com$"], "Prefixes": ["192.0.2.0/24", "10.0.0.0/8"]}, "Collect": ["PacketCounters"]}],
 "FlowCache": {"EvictTime": 20000000000, "Anonymize": false}, "DNSCache": {"EvictTime": 30000000000}}"""
).validate(registry.names())
FLOW = ["flow_id"]
TICK = ["flow_id", "tick"]
#: Key of the anonymisation query.
KEY = bytes(range(32))
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.project(tables.frames(spark, sf_dir), "host", tables.HWADDR, "192.168.0.0/16")


def of_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with flow and tick; the clock starts at 0."""
    return packets.with_tick(packets.with_flow_id(seen(spark, sf_dir)), 0)


@query
def filter_traffic_bpf(spark, sf_dir):
    rows = tables.frames(spark, sf_dir)
    return rows.where(net.traffic_filter(F.col("proto"), F.col("src_port"), F.col("dst_port"))).select("pkt_no", "proto", "src_port", "dst_port")


@query
def filter_dns_bpf(spark, sf_dir):
    rows = tables.frames(spark, sf_dir)
    return rows.where(net.dns_filter(F.col("proto"), F.col("src_port"), F.col("dst_port"))).select("pkt_no", "src_port", "dst_port")


def _direction(spark, sf_dir, mode):
    way = net.direction(mode, F.col("src_mac"), F.col("dst_mac"), tables.HWADDR)
    return tables.frames(spark, sf_dir).select("pkt_no", way.alias("dir"), F.when(way == 1, F.col("src_mac")).otherwise(F.col("dst_mac")).alias("hw_addr"))


@query
def direction_router(spark, sf_dir):
    return _direction(spark, sf_dir, "router")


@query
def direction_host(spark, sf_dir):
    return _direction(spark, sf_dir, "host")


@query
def local_rfc1918(spark, sf_dir):
    rows = tables.frames(spark, sf_dir)
    return rows.select("pkt_no", net.is_rfc1918(F.col("src_ip")).alias("src_private"), net.is_rfc1918(F.col("dst_ip")).alias("dst_private"))


@query
def local_private(spark, sf_dir):
    """Private, loopback and link-local ends of either version."""
    rows = tables.frames(spark, sf_dir)
    return rows.select("pkt_no", net.is_private(F.col("src_ip")).alias("src_private"), net.is_private(F.col("dst_ip")).alias("dst_private"))


@query
def project_offline(spark, sf_dir):
    """An offline trace's packets: incoming where the destination is private."""
    return packets.project_offline(tables.frames(spark, sf_dir)).select("pkt_no", "dir", "service_ip", "my_ip", "service_port", "my_port", "length", "data_length", "seq")


@query
def decode_frames(spark, sf_dir):
    """Frames read from the capture files that hold them; a frame's time names it."""
    found = tables.whole_ports(pcap.frames_in(tables.frame_captures(tables.frames(spark, sf_dir)), include_raw=True))
    return found.select("ts_ns", "src_mac", "dst_mac", "is_ipv4", "src_ip", "dst_ip", "ip_payload", "ihl", "proto", "src_port", "dst_port", "seq", "ack", "data_offset", "window", *(f"f_{x}" for x in ("fin", "syn", "rst", "psh", "ack", "urg")))


@query
def decode_frames_dns_only(spark, sf_dir):
    """The same with the filter for DNS put into the source."""
    found = tables.whole_ports(pcap.frames_in(tables.frame_captures(tables.frames(spark, sf_dir)), "dns", include_raw=True))
    return found.where(net.dns_filter(F.col("proto"), F.col("src_port"), F.col("dst_port"))).select("ts_ns", "src_port", "dst_port")


@query
def decode_dns(spark, sf_dir):
    """Names and first addresses of DNS messages read from the capture files that hold them."""
    found = pcap.dns_in(tables.dns_captures(tables.dns_messages(spark, sf_dir)), answered=True)
    return classify.dns_names(found).select("ts_ns", "name", "ip", "ttl")


@query
def fnv32_flow(spark, sf_dir):
    return packets.with_flow_id(seen(spark, sf_dir)).select("flow_id").distinct().select("flow_id", net.fnv32(F.col("flow_id")).alias("fnv32"))


@query
def project_ports_ips(spark, sf_dir):
    return seen(spark, sf_dir).select("pkt_no", "dir", "hw_addr", "is_local", "is_tcp", "service_ip", "my_ip", "service_port", "my_port", "length", "data_length", "seq")


@query
def flow_id(spark, sf_dir):
    return packets.with_flow_id(seen(spark, sf_dir)).select("pkt_no", "flow_id")


@query
def anonymize_ip(spark, sf_dir):
    rows = seen(spark, sf_dir).select("pkt_no", "my_ip", F.col("my_ip").alias("anonymous_ip"))
    return Anonymizer(spark, KEY).apply(rows, "anonymous_ip")


@query
def dns_substring_match(spark, sf_dir):
    names = classify.dns_names(tables.dns_messages(spark, sf_dir))
    return classify.name_matches(spark, names, CONFIG).where("kind = 0").select("name", "service", "pattern")


@query
def dns_regex_match(spark, sf_dir):
    names = classify.dns_names(tables.dns_messages(spark, sf_dir))
    return classify.name_matches(spark, names, CONFIG).where("kind = 1").select("name", "service", "pattern")


@query
def dns_first_match(spark, sf_dir):
    return classify.dns_first_match(spark, tables.dns_messages(spark, sf_dir), CONFIG).select("dns_no", "ip", "ttl", "service", "pattern")


@query
def dns_all_match(spark, sf_dir):
    return classify.dns_all_matches(spark, tables.dns_messages(spark, sf_dir), CONFIG).select("dns_no", "ip", "service", "kind")


@query
def cidr_first_match(spark, sf_dir):
    return classify.cidr_first_match(spark, seen(spark, sf_dir), CONFIG, "service_ip").select("ip", "service", "prefix")


@query
def cidr_all_match(spark, sf_dir):
    return classify.cidr_matches(spark, seen(spark, sf_dir), CONFIG, "service_ip").select("ip", "service", "prefix")


@query
def dns_asof_ttl(spark, sf_dir):
    bound = classify.dns_bindings(classify.dns_first_match(spark, tables.dns_messages(spark, sf_dir), CONFIG), CONFIG.dns_evict_ns)
    return classify.asof_binding(seen(spark, sf_dir).select("pkt_no", "ts_ns", "service_ip"), bound).select("pkt_no", F.col("dns_service").alias("service"))


def classified(spark, sf_dir):
    return classify.with_service(spark, seen(spark, sf_dir), CONFIG, tables.dns_messages(spark, sf_dir))


@query
def service_lookup(spark, sf_dir):
    return classified(spark, sf_dir).select("pkt_no", "service_ip", "service")


@query
def known_service_filter(spark, sf_dir):
    return classify.known_service_only(classified(spark, sf_dir)).select("pkt_no", "service")


def flowing(spark, sf_dir):
    rows = classified(spark, sf_dir).select(*registry.SEEN, "service_ip", "my_ip", "service_port", "my_port", "service_id", "service")
    return flows.flow_packets(rows, CONFIG.evict_ns)


@query
def flow_create(spark, sf_dir):
    """One row for each time that a flow is created, anew after an eviction as well."""
    return flows.flows(flowing(spark, sf_dir)).select("flow_id", "instance", "service", "service_ip", "local_ip", "protocol", "local_port", "service_port")


@query
def flow_expiry(spark, sf_dir):
    return flows.flows(flowing(spark, sf_dir)).select("flow_id", "instance", "service", "ts_first", "ts_last", "packets")


@query
def packet_counters(spark, sf_dir):
    return features.packet_counters(of_flows(spark, sf_dir), FLOW)


@query
def packet_counters_tick(spark, sf_dir):
    return features.packet_counters(of_flows(spark, sf_dir), TICK)


@query
def packet_counters_service(spark, sf_dir):
    """The whole chain: counters of each service's flows by tick, where the service collects them."""
    rows = packets.with_tick(flowing(spark, sf_dir), 0)
    own = classify.collecting(spark, rows, CONFIG, "PacketCounters")
    return features.packet_counters(own, ["service", "tick"])


@query
def video_segments(spark, sf_dir):
    return features.video_segments(of_flows(spark, sf_dir), FLOW)


@query
def video_segments_tick(spark, sf_dir):
    return features.video_segments_tick(of_flows(spark, sf_dir), FLOW)


@query
def tcp_flags(spark, sf_dir):
    return features.tcp_flags(features.tcp_rows(of_flows(spark, sf_dir), TICK), TICK)


def rounded(df: DataFrame, scale: dict[str, int] | None = None) -> DataFrame:
    """Fractions with so many digits; times in milliseconds, bytes in flight in units of 2^20."""
    fix = {}
    for name, kind in df.dtypes:
        if kind == "double":
            x = F.col(name) / 2**40 if name.endswith("BytesInFlightVar") else F.col(name) / 1e12 if name.startswith(("RTTVar", "JitterVar")) else F.col(name) / 1e6 if name.startswith(("RTTAvg", "JitterAvg")) else F.col(name) / 2**20 if name.endswith("BytesInFlightAvg") else F.col(name)
            fix[name] = F.round(x, 5)
    return df.withColumns(fix)


@query
def tcp_bytes_moments(spark, sf_dir):
    rows = features.tcp_state(of_flows(spark, sf_dir), TICK)
    return rounded(rows.select(*TICK, "BytesUpCounter", "BytesDownCounter", *(f"{s}{n}{m}" for s in ("Up", "Down") for n in ("RecWindow", "BytesPerPkt") for m in ("Avg", "Var"))))


@query
def tcp_inflight(spark, sf_dir):
    return features.tcp_rows(of_flows(spark, sf_dir), TICK).select("pkt_no", "in_flight")


@query
def tcp_ooo(spark, sf_dir):
    return features.tcp_rows(of_flows(spark, sf_dir), TICK).groupBy(*TICK).agg(F.count_if(F.col("ooo") & (F.col("dir") == 1)).alias("OOOUpCounter"), F.count_if(F.col("ooo") & (F.col("dir") == 0)).alias("OOODownCounter"))


@query
def tcp_retransmit(spark, sf_dir):
    return features.tcp_rows(of_flows(spark, sf_dir), FLOW).where("retr").select("pkt_no", "flow_id", "dir")


@query
def tcp_rtt(spark, sf_dir):
    return features.tcp_rows(of_flows(spark, sf_dir), FLOW).where("rtt is not null").select("pkt_no", "flow_id", "rtt")


@query
def tcp_state(spark, sf_dir):
    return rounded(features.tcp_state(of_flows(spark, sf_dir), TICK))


@query
def latency_jitter(spark, sf_dir):
    return rounded(features.latency_jitter(of_flows(spark, sf_dir), FLOW, "tick"))


@query
def byte_copy(spark, sf_dir):
    rows = features.byte_copy(tables.raw_frames(spark, sf_dir), FLOW, 1)
    return rows.select("flow_id", F.col("CopiedBytes").cast("long").alias("copied_bytes"), F.md5("Data").alias("data_md5"))


@query
def byte_copy_tick(spark, sf_dir):
    """What each tick copies of a flow's first bytes, of headers alone."""
    rows = packets.with_tick(tables.raw_frames(spark, sf_dir).withColumn("ts_ns", F.col("pkt_no") * 1_000_000_000), 0)
    return features.byte_copy_tick(rows, FLOW).select("flow_id", "tick", F.col("CopiedBytes").alias("copied_bytes"), F.md5("Data").alias("data_md5"))


@query
def png_copy(spark, sf_dir):
    """The pixels that a flow's image holds."""

    @F.pandas_udf("binary")
    def pixels(images: pd.Series) -> pd.Series:
        return images.map(lambda x: None if x is None else features.png_pixels(bytes(x)))

    rows = features.png_copy(tables.raw_frames(spark, sf_dir), FLOW, 1)
    return rows.select("flow_id", F.md5(pixels("Data")).alias("pixels_md5"))


@query
def welford_moments(spark, sf_dir):
    x = F.col("value")
    rows = tables.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("value").alias("n"), welford.mean(x).alias("avg_value"), welford.variance(x).alias("var_value"), welford.deviation(x).alias("std_value"))
    return rows.select("user_id", "n", *(F.round(v, 4).alias(v) for v in ("avg_value", "var_value", "std_value")))


@query
def welford_checked(spark, sf_dir):
    listed = tables.table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("v"))
    return listed.select("user_id", welford.checked(F.col("v"), 1.5, 10.0).alias("w")).select("user_id", F.col("w.n").alias("n"), F.round("w.avg", 6).alias("avg_value"))


@query
def idle_emit(spark, sf_dir):
    """Counters of every tick from a flow's start to its eviction, zeros where it was idle."""
    rows = packets.with_tick(flowing(spark, sf_dir), 0)
    keys = [*batch.FLOW, "tick"]
    counters = features.packet_counters(rows, keys)
    last = F.expr(f"(max(ts_ns) + {CONFIG.evict_ns}) div {10 * SECOND}")
    ticks = rows.groupBy(*batch.FLOW).agg(F.min("tick").alias("first_tick"), last.alias("last_tick"))
    return flows.with_idle_ticks(counters, ticks, ["InCounter", "OutCounter", "InBytes", "OutBytes"])


def counted_config() -> c.Config:
    """The test configuration with the features of whole numbers alone."""
    counted = lambda s: tuple(x for x in s.collect if x in ("PacketCounters", "VideoCounters"))
    return c.Config((*(s.__class__(s.name, s.domains, s.regexes, s.prefixes, counted(s)) for s in CONFIG.services),), evict_ns=CONFIG.evict_ns, dns_evict_ns=CONFIG.dns_evict_ns, anonymize=False)


@query
def flow_json(spark, sf_dir):
    """Records with the features of whole numbers, of every tick of a flow's life."""
    rows = packets.with_tick(flowing(spark, sf_dir), 0)
    return batch.flow_json(spark, rows, counted_config()).select("flow_id", "instance", "tick", "json")


@query
def flow_json_all(spark, sf_dir):
    """Records with all features that the configuration asks for."""
    rows = packets.with_tick(flowing(spark, sf_dir), 0)
    return batch.flow_json(spark, rows, CONFIG).select("flow_id", "instance", "tick", "json")


@query
def cachedump_envelope(spark, sf_dir):
    dumped = batch.cache_dump(flow_json(spark, sf_dir), 0, digits=1)
    return dumped.select("tick", "part", "json")


@query
def ifstats(spark, sf_dir):
    return batch.interface_stats(tables.frames(spark, sf_dir), 0).select("tick", "PktRecv", "PktDrop", "json")


@query
def storage_profile(spark, sf_dir):
    """Flows and bytes of records by tick."""
    return profiles.storage(flow_json(spark, sf_dir))


@query
def random_trace(spark, sf_dir):
    """A random packet at the time of each event."""
    return generate.random_packets(tables.frames(spark, sf_dir).select(F.col("pkt_no").alias("id"), "ts_ns"), 1)


@query
def stream_packet_counters(spark, sf_dir):
    from flowloom.streaming import runs

    return runs.counters_by_tick(spark, sf_dir)


@query
def stream_flow_state(spark, sf_dir):
    from flowloom.streaming import runs

    return runs.flow_state(spark, sf_dir)


@query
def stream_service_lookup(spark, sf_dir):
    """Services as a stream of packets and one of DNS messages give them: the same as ``service_lookup``."""
    from flowloom.streaming import runs

    return runs.service_lookup(spark, sf_dir).select("pkt_no", "service_ip", "service")


@query
def stream_flow_json(spark, sf_dir):
    """Records of every tick of a flow's life from a stream: the same as ``flow_json``."""
    from flowloom.streaming import runs

    return runs.flow_records(spark, sf_dir, counted_config())
