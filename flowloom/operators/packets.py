"""From decoded frames to packets: direction, local and remote end, lengths, and the packets that count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions import net
from flowloom.model import OUT, TCP, UDP


def project(frames: DataFrame, mode: str, hwaddr: str, localnet: str | None = None) -> DataFrame:
    """Packets of the frames that are IP, TCP or UDP, and of known direction.

    ``length`` is the IP payload; ``data_length`` the transport layer's. A UDP packet
    has the sequence number 0 and no flags.
    """
    tcp = F.col("proto") == TCP
    zero = lambda name, kind: F.when(tcp, F.col(name)).otherwise(F.lit(0)).cast(kind).alias(name)
    flag = lambda name: F.coalesce(tcp & F.col(name), F.lit(False)).alias(name)
    way = net.direction(mode, F.col("src_mac"), F.col("dst_mac"), hwaddr)
    out = F.col("dir") == OUT
    pick = lambda a, b: F.when(out, F.col(a)).otherwise(F.col(b))
    service, mine = pick("dst_ip", "src_ip"), pick("src_ip", "dst_ip")
    data = F.when(tcp, F.col("ip_payload") - 4 * F.col("data_offset")).otherwise(net.uint16(F.col("ip_payload") - 8))
    counted = frames.where(F.col("is_ipv4").isNotNull() & F.col("proto").isin(TCP, UDP) & F.col("src_port").isNotNull())
    return (
        counted.withColumn("dir", way)
        .where("dir >= 0")
        .select(
            "pkt_no",
            "ts_ns",
            "dir",
            pick("src_mac", "dst_mac").alias("hw_addr"),
            "is_ipv4",
            (net.in_net(service, localnet) | (F.col("is_ipv4") & net.is_rfc1918(service) & net.is_rfc1918(mine))).alias("is_local"),
            tcp.alias("is_tcp"),
            service.alias("service_ip"),
            mine.alias("my_ip"),
            pick("dst_port", "src_port").alias("service_port"),
            pick("src_port", "dst_port").alias("my_port"),
            F.col("ip_payload").alias("length"),
            data.alias("data_length"),
            zero("seq", "long"),
            zero("ack", "long"),
            zero("data_offset", "int"),
            zero("window", "int"),
            *(flag(f"f_{x}") for x in ("syn", "rst", "psh", "ack", "urg")),
            "ihl",
            "raw_data",
        )
    )


def project_offline(frames: DataFrame) -> DataFrame:
    """Packets of an offline trace: IPv4 and TCP only, incoming where the destination is private."""
    marked = frames.where("is_ipv4 and proto = 6").withColumns({"dst_mac": F.when(net.is_private(F.col("dst_ip")), "in").otherwise("x"), "src_mac": F.when(net.is_private(F.col("dst_ip")), "x").otherwise("in")})
    return project(marked, "host", "in")


def with_flow_id(packets: DataFrame) -> DataFrame:
    return packets.withColumn("flow_id", net.flow_id(F.col("service_ip"), F.col("my_ip"), F.col("service_port"), F.col("my_port")))


def with_tick(packets: DataFrame, start_s: int, seconds: int = 10) -> DataFrame:
    """Adds ``tick``: half-open intervals of ``seconds`` since ``start_s``."""
    return packets.withColumn("tick", F.expr(f"(ts_ns div 1000000000 - {int(start_s)}) div {int(seconds)}"))


def start_second(packets: DataFrame) -> int:
    """The second of the first packet; 0 without one."""
    first = packets.agg(F.min("ts_ns")).first()[0]
    return 0 if first is None else first // 1_000_000_000
