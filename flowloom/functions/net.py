"""Addresses, directions and packet filters as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.model import IN, OUT, TCP, U16, U32, UDP, UNKNOWN

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def ip4_num(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    part = F.split(ip, r"\.")
    num = sum((part[i].cast("long") * (256 ** (3 - i)) for i in range(1, 4)), part[0].cast("long") * 256**3)
    return F.when(ip.rlike(_IP4), num)


def ip4_string(num: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(num, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))


def _with(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def ip6_hex(ip: Column) -> Column:
    """An IPv6 address as 32 hex digits; null for anything else. Embedded dotted addresses are understood."""
    groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")

    def undotted(x: Column) -> Column:
        dotted = F.regexp_extract(x, r"(\d+\.\d+\.\d+\.\d+)$", 1)
        tail = lambda t: F.concat(F.regexp_replace(x, r"\d+\.\d+\.\d+\.\d+$", ""), F.substring(t, 1, 4), F.lit(":"), F.substring(t, 5, 4))
        return F.when(x.contains("."), _with(F.lpad(F.lower(F.hex(ip4_num(dotted))), 8, "0"), tail)).otherwise(x)

    def of_sides(plain: Column, head: Column, rest: Column) -> Column:
        gap = F.lit(8) - F.size(head) - F.size(rest)
        full = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0)).cast("int")), rest)
        valid = plain.rlike("^[0-9a-f:]+$") & plain.contains(":") & ~plain.rlike(":::|::.*::|^:[^:]|[^:]:$") & F.when(plain.contains("::"), gap >= 1).otherwise(gap == 0)
        return F.when(valid, _with(full, lambda g: F.when(F.forall(g, lambda x: F.length(x) <= 4), F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), ""))))

    def of_plain(plain: Column) -> Column:
        both = F.split(plain, "::", 2)
        rest = F.when(plain.contains("::"), groups(F.element_at(both, 2))).otherwise(F.array().cast("array<string>"))
        return _with(F.struct(groups(both[0]).alias("head"), rest.alias("rest")), lambda s: of_sides(plain, s["head"], s["rest"]))

    return F.when(ip.contains(":"), _with(F.lower(undotted(ip)), of_plain))


def ip_bits(ip: Column) -> Column:
    """The bits of an IPv4 (32) or IPv6 (128) address as a string of 0 and 1."""
    four = F.lpad(F.bin(ip4_num(ip)), 32, "0")
    digits = F.split(ip6_hex(ip), "")
    six = F.array_join(F.transform(digits, lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")
    return F.coalesce(four, six)


#: Whether a text is an address of those networks, in one look: numbers of private, and of loopback and link-local networks.
_RFC1918 = rf"10\.{_OCTET}|192\.168|172\.(1[6-9]|2\d|3[01])"
_OWN4 = rf"{_RFC1918}|127\.{_OCTET}|169\.254"
_GROUP = "[0-9a-f]{1,4}"
#: Eight groups, or fewer on both sides of a pair of colons.
_IP6 = rf"^(({_GROUP}:){{7}}{_GROUP}|(?!([^0-9a-f]*{_GROUP}(?![0-9a-f])){{8}})({_GROUP}(:{_GROUP})*)?::({_GROUP}(:{_GROUP})*)?)$"
_OWN6 = "^(f(e[89ab]|[cd][0-9a-f])[0-9a-f]:|[0:]*:0{0,3}1$)"


def _in_four(ip: Column, nets: str) -> Column:
    return ip.rlike(rf"^({nets})\.{_OCTET}\.{_OCTET}$")


def is_rfc1918(ip: Column) -> Column:
    return F.coalesce(_in_four(ip, _RFC1918), F.lit(False))


def is_private(ip: Column) -> Column:
    """Private, loopback or link-local, of either version."""
    low = F.lower(ip)
    six = F.when(ip.contains("."), ip6_hex(ip).rlike("^(0{31}1$|fe[89ab]|f[cd])")).otherwise(low.rlike(_OWN6) & low.rlike(_IP6))
    return F.coalesce(F.when(ip.contains(":"), six).otherwise(_in_four(ip, _OWN4)), F.lit(False))


def in_net(ip: Column, net: str | None) -> Column:
    """Whether an address lies in a network like ``192.168.0.0/16``."""
    import ipaddress

    if not net:
        return F.lit(False)
    n = ipaddress.ip_network(net)
    number, rest = int(n.network_address), n.max_prefixlen - n.prefixlen
    if n.version == 4:
        return F.coalesce(F.shiftright(ip4_num(ip), rest) == number >> rest, F.lit(False))
    digits, bits = divmod(n.prefixlen, 4)
    words = f"{number:032x}"
    last = [f"{x:x}" for x in range(16) if bits and x >> (4 - bits) == int(words[digits], 16) >> (4 - bits)]
    return F.coalesce(F.when(ip.contains(":"), ip6_hex(ip).rlike(f"^{words[:digits]}" + (f"[{''.join(last)}]" if bits else ""))), F.lit(False))


def direction(mode: str, src_mac: Column, dst_mac: Column, hwaddr: str) -> Column:
    """1 out, 0 in, -1 unknown, seen from the capturing device in ``mode``."""
    to, by = dst_mac == hwaddr, src_mac == hwaddr
    if mode in ("router", "mirror"):
        return F.when(to, OUT).when(by, IN).otherwise(UNKNOWN)
    if mode == "host":
        return F.when(by, OUT).when(to, IN).otherwise(UNKNOWN)
    raise ValueError(f"no such mode: {mode}")


def dns_filter(proto: Column, src_port: Column, dst_port: Column) -> Column:
    """``udp and port 53``"""
    return (proto == UDP) & ((src_port == 53) | (dst_port == 53))


def traffic_filter(proto: Column, src_port: Column, dst_port: Column) -> Column:
    """``tcp or (udp and not port 53)``"""
    return (proto == TCP) | ((proto == UDP) & (src_port != 53) & (dst_port != 53))


def flow_id(service_ip: Column, my_ip: Column, service_port: Column, my_port: Column) -> Column:
    return F.md5(F.concat_ws("-", service_ip, my_ip, service_port.cast("string"), my_port.cast("string")).cast("binary"))


def tuple_hash(a: Column, b: Column) -> Column:
    """A hash of two endpoints that does not depend on their order."""
    return F.xxhash64(F.least(a, b), F.greatest(a, b))


def uint32(x: Column) -> Column:
    return F.pmod(x, F.lit(U32))


def uint16(x: Column) -> Column:
    return F.pmod(x, F.lit(U16))


def fnv32(text: Column) -> Column:
    """The 32-bit FNV-1 hash of a text's bytes: multiply, then xor."""
    codes = F.transform(F.regexp_extract_all(F.hex(text.cast("binary")), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long"))
    start, prime = F.lit(2166136261).cast("long"), 16777619
    return F.aggregate(codes, start, lambda acc, b: F.pmod(acc * prime, F.lit(U32)).bitwiseXOR(b))
