"""Frames of a capture as columns: offsets of the layers over one buffer, a step a layer for all frames.

Only the chain of record lengths is followed packet by packet. A frame that ends early keeps
the layers found so far, as in ``decode.decode_frame``.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from ipaddress import IPv4Address, IPv6Address

import numpy as np
import pyarrow as pa
import pyarrow.compute

from flowloom.sources.decode import ETHERNET, MAGIC

_EXTENSIONS = np.isin(np.arange(256), (0, 43, 60))
_FLAGS = ("fin", "syn", "rst", "psh", "ack", "urg")


def records(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time in ns, first byte and size of each packet; one that is cut off at the file's end is left out."""
    none = np.zeros(0, np.int64)
    if not raw:
        return none, none, none
    if raw[:4] not in MAGIC or len(raw) < 24:
        raise ValueError("not a capture file")
    order, unit = MAGIC[raw[:4]]
    if (link := struct.unpack_from(order + "I", raw, 20)[0] & 0xFFFF) != ETHERNET:
        raise ValueError(f"link type {link} is not Ethernet")
    sizes, at, end = struct.Struct(order + "I").unpack_from, 24, len(raw)
    heads = []
    while at + 16 <= end:
        heads.append(at)
        at += 16 + sizes(raw, at + 8)[0]
    if at > end:
        heads.pop()
    head = np.array(heads, np.int64)
    fields = np.frombuffer(raw, np.uint8)[head[:, None] + np.arange(16)].reshape(-1, 16).copy().view(order + "u4").astype(np.int64) if len(head) else np.zeros((0, 4), np.int64)
    return fields[:, 0] * 1_000_000_000 + fields[:, 1] * unit, head + 16, fields[:, 2]


def whole_until(path: str, at: int = 0) -> int:
    """The byte behind the last whole record of a file, looking from the record at ``at`` on; only lengths are read."""
    with open(path, "rb") as f:
        head, end = f.read(24), f.seek(0, 2)
        if end < 24:
            return 0
        if head[:4] not in MAGIC:
            raise ValueError(f"{path} is not a capture file")
        size, at = struct.Struct(MAGIC[head[:4]][0] + "I"), max(at, 24)
        while at + 16 <= end:
            f.seek(at + 8)
            after = at + 16 + size.unpack(f.read(4))[0]
            if after > end:
                break
            at = after
        return at


def _named(codes: np.ndarray, known: np.ndarray, name: Callable) -> pa.Array:
    """Each distinct code is put into words once; null where it is not known."""
    own, back = np.unique(codes[known], axis=0, return_inverse=True)
    words = pa.array([name(x) for x in own.tolist()], pa.string())
    place = np.zeros(len(known), np.int64)
    place[known] = back.ravel()
    return words.take(pa.array(place, mask=~known)) if len(own) else pa.nulls(len(known), pa.string())


def decode(data: np.ndarray, start: np.ndarray, size: np.ndarray, wanted: Callable[[dict[str, pa.Array]], np.ndarray] | None = None) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The frames that ``wanted`` picks by their numbers, and their fields; addresses are put into words for these alone."""
    data = np.concatenate([data, np.zeros(64, np.uint8)])
    last = len(data) - 64
    end = start + size
    byte = lambda at: data[np.minimum(at, last)].astype(np.int64)
    number = lambda at, n: sum(byte(at + i) << (8 * (n - 1 - i)) for i in range(n))
    whole = size >= 14
    kind, at = number(start + 12, 2), start + 14
    tagged = np.flatnonzero(whole & (kind == 0x8100) & (end >= at + 4))
    while len(tagged):
        kind[tagged] = number(at[tagged] + 2, 2)
        at[tagged] += 4
        tagged = tagged[(kind[tagged] == 0x8100) & (end[tagged] >= at[tagged] + 4)]
    first = byte(at)
    ihl = first & 15
    four = whole & (kind == 0x0800) & (end >= at + 20) & (first >> 4 == 4) & (ihl >= 5) & (end >= at + 4 * ihl)
    six = whole & (kind == 0x86DD) & (end >= at + 40) & (first >> 4 == 6)
    total, size6 = number(at + 2, 2), number(at + 4, 2)
    whole_packet = four & (number(at + 6, 2) & 0x1FFF == 0)  # a later fragment has no transport header
    stop = np.where(four, np.where(total > 0, np.minimum(end, at + total), end), np.minimum(end, at + 40 + size6))
    proto, body = np.where(four, byte(at + 9), byte(at + 6)), at + np.where(four, 4 * ihl, 40)
    extended = np.flatnonzero(six & _EXTENSIONS[proto] & (end >= body + 8))
    while len(extended):
        here = body[extended]
        proto[extended] = byte(here)
        body[extended] = here + 8 + 8 * byte(here + 1)
        extended = extended[_EXTENSIONS[proto[extended]] & (end[extended] >= body[extended] + 8)]
    found = four | six
    carried = (whole_packet | six) & (stop > body)
    tcp = carried & (proto == 6) & (stop - body >= 20)
    udp = carried & (proto == 17) & (stop - body >= 8)
    flags = byte(body + 13)
    one = lambda x, known, t=pa.int32(): pa.array(x, mask=~known).cast(t)
    fields = {
        "is_ipv4": pa.array(four, mask=~found),
        "ip_payload": one(np.where(four, (total - 4 * ihl) % 65536, size6), found, pa.int64()),
        "ihl": one(ihl, four),
        "proto": one(proto, found),
        "src_port": one(number(body, 2), tcp | udp),
        "dst_port": one(number(body + 2, 2), tcp | udp),
        "seq": one(number(body + 4, 4), tcp, pa.int64()),
        "ack": one(number(body + 8, 4), tcp, pa.int64()),
        "data_offset": one(byte(body + 12) >> 4, tcp),
        "window": one(number(body + 14, 2), tcp),
        **{f"f_{n}": pa.array(flags >> i & 1 == 1, mask=~tcp) for i, n in enumerate(_FLAGS)},
    }
    kept = np.arange(len(start))
    if wanted is not None:
        kept = np.flatnonzero(wanted(fields))
        fields = {n: c.take(pa.array(kept)) for n, c in fields.items()}
        start, at, whole, four, six = start[kept], at[kept], whole[kept], four[kept], six[kept]
    mac = lambda x: ":".join(f"{x:012x}"[i : i + 2] for i in range(0, 12, 2))
    fields["dst_mac"], fields["src_mac"] = (_named(number(start + i, 6), whole, mac) for i in (0, 6))
    for name, in4, in6 in (("src_ip", 12, 8), ("dst_ip", 16, 24)):
        short = _named(number(at + in4, 4), four, lambda x: str(IPv4Address(x)))
        # Halves of an address as signed numbers: equal ones stay equal.
        halves = np.stack([number(at + in6, 8), number(at + in6 + 8, 8)], 1) if len(at) else np.zeros((0, 2), np.int64)
        long = _named(halves, six, lambda x: str(IPv6Address((x[0] % 2**64) << 64 | x[1] % 2**64)))
        fields[name] = pa.compute.coalesce(short, long)
    return kept, fields
