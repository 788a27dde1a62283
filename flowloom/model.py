"""Schemas: decoded frames, packets, DNS messages, flows."""

from __future__ import annotations

#: A frame as decoded from a capture: nothing depends on where it was taken.
FRAME = (
    "pkt_no long, ts_ns long, src_mac string, dst_mac string, is_ipv4 boolean, src_ip string, dst_ip string, "
    "ip_payload long, ihl int, proto int, src_port int, dst_port int, seq long, ack long, data_offset int, window int, "
    "f_fin boolean, f_syn boolean, f_rst boolean, f_psh boolean, f_ack boolean, f_urg boolean, raw_data binary"
)
#: A DNS message; ``ip`` is null in answers that hold no address.
DNS = "dns_no long, ts_ns long, questions array<struct<name:string>>, answers array<struct<ip:string,ttl:long>>"

IN, OUT, UNKNOWN = 0, 1, -1
TCP, UDP = 6, 17
U16, U32 = 1 << 16, 1 << 32
SECOND = 1_000_000_000
