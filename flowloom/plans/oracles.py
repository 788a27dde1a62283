"""DuckDB SQL for the queries: the same results, stated another way where there is one."""

from __future__ import annotations

import ipaddress

from flowloom.plans.queries import CONFIG
from flowloom.sources.tables import HWADDR, OTHER, REMOTE, SERVICE_IPS

_IPS = "[" + ", ".join(f"'{x}'" for x in SERVICE_IPS) + "]"


def _values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return f"(select * from (values {body}) t({names}))"


_DOMAINS = _values([(i, s.name, j, d) for i, s in enumerate(CONFIG.services) for j, d in enumerate(s.domains)], "service_id, service, pos, pattern")
_REGEXES = _values([(i, s.name, j, d) for i, s in enumerate(CONFIG.services) for j, d in enumerate(s.regexes)], "service_id, service, pos, pattern")
_NETS = [(i, s.name, ipaddress.ip_network(p)) for i, s in enumerate(CONFIG.services) for p in s.prefixes]
_PREFIXES = _values([(i, n, k, str(p), int(p[0]), int(p[-1])) for k, (i, n, p) in enumerate(_NETS) if p.version == 4], "service_id, service, pos, prefix, lo, hi")
_SIX = _values([(i, n, k, str(p), format(int(p.network_address), "032x")[: p.prefixlen // 4]) for k, (i, n, p) in enumerate(_NETS) if p.version == 6], "service_id, service, pos, prefix, digits")
_SIX_IPS = _values([(x, format(int(ipaddress.ip_address(x)), "032x")) for x in SERVICE_IPS if ":" in x], "ip, hex")
_FOUR, _ALL_IPS = len([x for x in SERVICE_IPS if "." in x]), len(SERVICE_IPS)
_COLLECTS = _values([(s.name,) for s in CONFIG.services if "PacketCounters" in s.collect], "service")

FRAMES = f"""fr as (
  select event_id pkt_no, event_id * 20000000 ts_ns, case when event_type in ('view', 'purchase') then 0 when event_type in ('click', 'signup') then 1 else -1 end way,
    user_id % 4 <> 0 is_tcp, case when user_id % 4 <> 0 then 6 else 17 end proto,
    user_id % {_ALL_IPS} < {_FOUR} is_ipv4, case when user_id % {_ALL_IPS} < {_FOUR} then '192.168.' || ((user_id // 256) % 256) || '.' || (user_id % 256) else 'fd00::' || lower(to_hex(user_id % 65535 + 1)) end my_ip,
    {_IPS}[user_id % {_ALL_IPS} + 1] service_ip, (40000 + user_id)::int my_port, case when user_id % 10 in (8, 9) then 53 else 443 end service_port,
    (floor(value)::bigint % 4) * 100 + case when user_id % 4 <> 0 then 20 else 8 end length, (floor(value)::bigint % 4) * 100 data_length,
    case when user_id % 4 <> 0 then (case when user_id % 3 = 0 then 4294966796 else 0 end + (event_id % 11) * 100) % 4294967296 else 0 end seq,
    (case when user_id % 3 = 0 then 4294966796 else 0 end + (event_id % 13) * 100) % 4294967296 ack, (1000 + event_id % 512)::int win,
    event_id % 5 <> 0 f_ack, event_id % 17 = 0 f_syn, event_id % 19 = 0 f_rst, event_id % 3 = 0 f_psh, event_id % 23 = 0 f_urg
  from events),
fm as (select *, case when way = 1 then my_ip else service_ip end src_ip, case when way = 1 then service_ip else my_ip end dst_ip, case when way = 1 then my_port else service_port end src_port, case when way = 1 then service_port else my_port end dst_port,
    case way when 1 then '{HWADDR}' when 0 then '{REMOTE}' else '{OTHER}' end src_mac, case way when 1 then '{REMOTE}' when 0 then '{HWADDR}' else '{OTHER}' end dst_mac from fr),
pk as (select *, way dir, md5(service_ip || '-' || my_ip || '-' || service_port || '-' || my_port) flow_id, ts_ns // 10000000000 tick from fr where way >= 0)"""

_HOST = "regexp_extract(url, '://([^/?#]*)', 1)"
DNS = f"""nm as (select page_id dns_no, page_id * 700000000 ts_ns, {_HOST} "name", {_IPS}[page_id % {_ALL_IPS} + 1] ip, (page_id % 4) * 7 ttl from pages where page_id % 11 <> 10 or page_id % 7 = 0),
hits as (select dns_no, ts_ns, ip, ttl, "name", 0 kind, service_id, service, pos, pattern from nm, {_DOMAINS} d where contains("name", pattern)
  union all select dns_no, ts_ns, ip, ttl, "name", 1, service_id, service, pos, pattern from nm, {_REGEXES} d where regexp_matches("name", pattern)),
fst as (select * from hits qualify row_number() over (partition by dns_no order by kind, service_id, pos) = 1)"""

CIDR = f"""ips as (select distinct service_ip ip, list_sum(list_transform(string_split(service_ip, '.'), lambda x, i: x::bigint * (256 ** (4 - i))::bigint))::bigint num from fr where way >= 0 and is_ipv4),
cid as (select ip, pos, service_id, service, prefix from ips, {_PREFIXES} x where num between lo and hi
  union all select distinct s.ip, pos, service_id, service, prefix from fr join {_SIX_IPS} s on s.ip = service_ip, {_SIX} x where way >= 0 and starts_with(hex, digits))"""

_DNS_EVICT = CONFIG.dns_evict_ns // 1_000_000_000
SERVICE = f"""asf as (select p.pkt_no, case when p.ts_ns // 1000000000 <= b.ts_ns // 1000000000 + case when b.ttl = 0 then {_DNS_EVICT} else b.ttl end then b.service end dns_service
  from pk p asof left join fst b on p.service_ip = b.ip and p.ts_ns >= b.ts_ns),
svc as (select p.*, coalesce(a.dns_service, c.service) service from pk p join asf a using (pkt_no) left join (select ip, arg_min(service, pos) service from cid group by ip) c on c.ip = p.service_ip)"""

FLOWS = f"""gap as (select *, sum(case when ts_ns - prev > {CONFIG.evict_ns} then 1 else 0 end) over (partition by flow_id order by ts_ns) instance from (select *, lag(ts_ns) over (partition by flow_id order by ts_ns) prev from svc)),
beg as (select flow_id, instance, min(ts_ns) began, arg_min(service, ts_ns) bound from gap where service is not null group by all),
fl as (select g.* exclude (service, instance), g.instance::bigint instance, b.bound service from gap g join beg b on g.flow_id = b.flow_id and g.instance = b.instance and g.ts_ns >= b.began)"""


def _counters(keys: str, source: str = "pk") -> str:
    return f"""select {keys}, count(*) filter (dir = 0) "InCounter", count(*) filter (dir = 1) "OutCounter", coalesce(sum(length) filter (dir = 0), 0)::bigint "InBytes", coalesce(sum(length) filter (dir = 1), 0)::bigint "OutBytes" from {source} group by {keys}"""


_PRIVATE = r"regexp_matches({0}, '^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)')"
_REQUEST = "(dir = 1 and case when is_tcp then data_length > 0 else data_length > 100 end)"


def _segments(keys: str, source: str) -> str:
    return f"""sg as (select *, sum(case when {_REQUEST} then 1 else 0 end) over (partition by {keys} order by ts_ns)::bigint seg, {_REQUEST} req, dir = 0 and data_length > 0 dat from {source}),
so as (select {keys}, seg, max(length) filter (req) len_, max(seq) filter (req) seq_, max(ts_ns) filter (req) start_, coalesce(max(ts_ns) filter (dat), 0) last_, count(*) filter (dat) pkts_, coalesce(sum(data_length) filter (dat), 0)::bigint bytes_, coalesce(max(seq) filter (dat), 0) max_,
    min(tick) filter (req) start_tick from sg where seg > 0 group by {keys}, seg)"""


SEGMENTS = _segments("flow_id", "pk")


def _segment_ticks(keys: str, last: str) -> str:
    """What each tick emits of each segment, up to the last tick of its flow."""
    return f"""n as (select *, lead(start_tick) over (partition by {keys} order by seg) next_tick from so),
l as ({last}),
e as (select n.*, unnest(range(start_tick, coalesce(next_tick, last_tick) + 1)) tick from n join l using ({keys})),
m as (select {", ".join("e." + k.strip() for k in keys.split(","))}, e.tick, e.seg, e.len_, e.seq_, e.start_, e.next_tick, coalesce(max(d.ts_ns), 0) last_, count(d.ts_ns) pkts_, coalesce(sum(d.data_length), 0)::bigint bytes_, coalesce(max(d.seq), 0) max_
  from e left join (select * from sg where dat) d on {" and ".join(f"d.{k.strip()} = e.{k.strip()}" for k in keys.split(","))} and d.seg = e.seg and d.tick <= e.tick group by all),
vt as (select {keys}, tick, seg, len_ "Len", seq_ "Seq", start_ "TsStart", case when tick = next_tick then last_ else 0 end "TsEnd", last_ "LastPkt", pkts_ "DownPkts", bytes_ "DonwBytes", max_ "MaxDSeq" from m where next_tick is null or tick <> next_tick or pkts_ > 0)"""



def _tcp(keys: str) -> str:
    """State of each TCP packet: the outstanding keys by a join of packets with earlier ones."""
    return f"""t0 as (select *, length - 20 bytes, row_number() over (partition by {keys} order by ts_ns) i from pk where is_tcp),
t1 as (select *, (seq + bytes) % 4294967296 k, coalesce(max(case when dir = 0 and f_ack then ack end) over w, 0) lab_d, coalesce(max(case when dir = 1 and f_ack then ack end) over w, 0) lab_u,
    coalesce(max(case when dir = 0 and bytes > 0 then seq end) over w, 0) ls_d, coalesce(max(case when dir = 1 and bytes > 0 then seq end) over w, 0) ls_u from t0 window w as (partition by {keys} order by ts_ns rows between unbounded preceding and 1 preceding)),
t2 as (select *, max(case when dir = 0 and f_ack and ack > lab_d then i end) over w inc_d, max(case when dir = 1 and f_ack and ack > lab_u then i end) over w inc_u from t1 window w as (partition by {keys} order by ts_ns rows between unbounded preceding and 1 preceding)),
rt as (select r.pkt_no, r.ts_ns - arg_min(u.ts_ns, u.i) rtt from t2 r join t2 u using ({keys}) where r.dir = 0 and r.f_ack and u.dir = 1 and u.bytes > 0 and u.k = r.ack and u.i < r.i and u.i > case when r.lab_d > r.ack then r.inc_d else -1 end group by r.pkt_no, r.ts_ns),
re as (select distinct r.pkt_no from t2 r join t2 u using ({keys}, dir, k) where r.bytes > 0 and u.bytes > 0 and u.i < r.i and u.i > case when case when r.dir = 1 then r.lab_d else r.lab_u end > r.k then case when r.dir = 1 then r.inc_d else r.inc_u end else -1 end),
tc as (select t2.*, rt.rtt, re.pkt_no is not null retr, case when dir = 0 then ((seq + bytes - lab_u) % 4294967296 + 4294967296) % 4294967296 else ((seq + bytes - lab_d) % 4294967296 + 4294967296) % 4294967296 end in_flight,
    bytes > 0 and seq < case when dir = 0 then ls_d else ls_u end ooo from t2 left join rt using (pkt_no) left join re using (pkt_no))"""


def _moment(expression: str, name: str, large: bool) -> str:
    avg, var = f"coalesce(avg({expression}), 0)", f"coalesce(case when count({expression}) > 1 then var_samp({expression}) end, 0)"
    return f"""round({avg}{" / 2**20" if large else ""}, 5) "{name}Avg", round({var}{" / 2**40" if large else ""}, 5) "{name}Var\""""


_FLAGS = ", ".join(f"""count(*) filter (dir = {d} and {c}) "{n}{s}Counter\"""" for n, c in (("Ack", "f_ack"), ("Syn", "f_syn"), ("Rst", "f_rst"), ("Push", "f_psh"), ("Urg", "f_urg")) for s, d in (("Up", 1), ("Down", 0)))
_BYTES = ", ".join(f"""coalesce(sum(bytes) filter (dir = {d}), 0)::bigint "Bytes{s}Counter\"""" for s, d in (("Up", 1), ("Down", 0)))
_OOO = ", ".join(f"""count(*) filter (dir = {d} and ooo) "OOO{s}Counter\"""" for s, d in (("Up", 1), ("Down", 0)))
_RETR = ", ".join(f"""count(*) filter (dir = {d} and retr) "Retr{s}Counter\"""" for s, d in (("Up", 1), ("Down", 0)))


def _ways(name: str, column: str) -> str:
    return ", ".join(_moment(f"case when dir = {d} then {column} end", f"{s}{name}", name == "BytesInFlight") for s, d in (("Up", 1), ("Down", 0)))


_RTT = """round(coalesce(avg(rtt), 0) / 1e6, 5) "RTTAvg", round(coalesce(case when count(rtt) > 1 then var_samp(rtt) end, 0) / 1e12, 5) "RTTVar\""""

_RAW = """rw as (select doc_id, 'flow-' || (doc_id // 8) flow_id, encode(coalesce(text, '')) raw from documents),
pt as (select doc_id, flow_id, raw, greatest(octet_length(raw) - 34, 20) len_, greatest(octet_length(raw) - 54, 0) dat_ from rw),
hx as (select doc_id, flow_id, hex(raw)[1 : 2 * (14 + 20 + len_ - dat_)] || hex(raw)[2 * (14 + 20 + len_ - dat_) + 1 : 2 * (14 + 20 + len_)] part from pt)"""

_ALL = ", ".join((FRAMES, DNS, CIDR, SERVICE, FLOWS))
_ONE = """'{"Len":' || "Len" || ',"Seq":' || "Seq" || ',"TsStart":' || "TsStart" || ',"TsEnd":' || "TsEnd" || ',"LastPkt":' || "LastPkt" || ',"DownPkts":' || "DownPkts" || ',"DonwBytes":' || "DonwBytes" || ',"MaxDSeq":' || "MaxDSeq" || '}'"""
_VIDEO = ", ".join(f"'{s.name}'" for s in CONFIG.services if "VideoCounters" in s.collect)
_LIVES = f"select flow_id, instance, min(tick) first_tick, (max(ts_ns) + {CONFIG.evict_ns}) // 10000000000 last_tick from fl group by flow_id, instance"
_RECORDS = f"""{_ALL}, {_segments("flow_id, instance", f"(select * from fl where service in ({_VIDEO}))")}, {_segment_ticks("flow_id, instance", _LIVES)},
vj as (select flow_id, instance, tick, string_agg({_ONE}, ',' order by seg) v from vt group by flow_id, instance, tick),
ct as ({_counters("flow_id, instance, tick", "fl")}), aw as (select flow_id, instance, unnest(range(first_tick, last_tick + 1)) tick from l),
hd as (select * from fl qualify row_number() over (partition by flow_id, instance order by ts_ns) = 1),
js as (select flow_id, instance, aw.tick, '{{"Id":"' || flow_id || '","Service":"' || service || '","DomainName":"","ServiceIP":"' || service_ip || '","LocalIP":"' || my_ip || '","Protocol":"' || case when is_tcp then 'TCP' else 'UDP' end || '","LocalPort":"' || my_port || '","ServicePort":"' || service_port
    || '","Cntrs":[{{"CType":"PacketCounters","Data":{{"InCounter":' || coalesce("InCounter", 0) || ',"OutCounter":' || coalesce("OutCounter", 0) || ',"InBytes":' || coalesce("InBytes", 0) || ',"OutBytes":' || coalesce("OutBytes", 0) || '}}}}' || case when service in ({_VIDEO}) then ',{{"CType":"VideoCounters","Data":{{"VideoSegments":[' || coalesce(v, '') || ']}}}}' else '' end || ']}}' json
  from aw left join ct using (flow_id, instance, tick) left join vj using (flow_id, instance, tick) join hd using (flow_id, instance))"""


def _pick(k: int, low: int, high: int) -> str:
    return f"(('0x' || substr(md5('1:' || id || ':{k}'), 1, 12))::bigint % {high - low} + {low})"


ORACLES: dict[str, str] = {
    "filter_traffic_bpf": f"with {FRAMES} select pkt_no, proto, src_port, dst_port from fm where proto = 6 or (proto = 17 and src_port <> 53 and dst_port <> 53)",
    "filter_dns_bpf": f"with {FRAMES} select pkt_no, src_port, dst_port from fm where proto = 17 and (src_port = 53 or dst_port = 53)",
    "direction_router": f"with {FRAMES}, d as (select *, case when dst_mac = '{HWADDR}' then 1 when src_mac = '{HWADDR}' then 0 else -1 end v from fm) select pkt_no, v dir, case when v = 1 then src_mac else dst_mac end hw_addr from d",
    "direction_host": f"with {FRAMES}, d as (select *, case when src_mac = '{HWADDR}' then 1 when dst_mac = '{HWADDR}' then 0 else -1 end v from fm) select pkt_no, v dir, case when v = 1 then src_mac else dst_mac end hw_addr from d",
    "local_rfc1918": f"with {FRAMES} select pkt_no, {_PRIVATE.format('src_ip')} src_private, {_PRIVATE.format('dst_ip')} dst_private from fm",
    "local_private": f"with {FRAMES} select pkt_no, {_PRIVATE.format('src_ip')} or regexp_matches(src_ip, '^(127\\.|169\\.254\\.|fe[89ab]|f[cd]|::1$)') src_private, {_PRIVATE.format('dst_ip')} or regexp_matches(dst_ip, '^(127\\.|169\\.254\\.|fe[89ab]|f[cd]|::1$)') dst_private from fm",
    "project_offline": f"""with {FRAMES}, o as (select *, {_PRIVATE.format('dst_ip')} into_ from fm where is_ipv4 and is_tcp)
select pkt_no, case when into_ then 0 else 1 end dir, case when into_ then src_ip else dst_ip end service_ip, case when into_ then dst_ip else src_ip end my_ip, case when into_ then src_port else dst_port end service_port, case when into_ then dst_port else src_port end my_port, length, data_length, seq from o""",
    "decode_frames": f"""with {FRAMES} select ts_ns, src_mac, dst_mac, is_ipv4, src_ip, dst_ip, length ip_payload, case when is_ipv4 then 5 end ihl, proto, src_port, dst_port, case when is_tcp then seq end seq, case when is_tcp then ack end ack, case when is_tcp then 5 end data_offset, case when is_tcp then win end "window",
  case when is_tcp then false end f_fin, case when is_tcp then f_syn end f_syn, case when is_tcp then f_rst end f_rst, case when is_tcp then f_psh end f_psh, case when is_tcp then f_ack end f_ack, case when is_tcp then f_urg end f_urg from fm""",
    "decode_frames_dns_only": f"with {FRAMES} select ts_ns, src_port, dst_port from fm where proto = 17 and (src_port = 53 or dst_port = 53)",
    "decode_dns": f'with {DNS} select ts_ns, "name", ip, ttl from nm',
    "fnv32_flow": f"with {FRAMES}, i as (select distinct flow_id from pk) select flow_id, list_reduce([2166136261::bigint] || [ascii(x)::bigint for x in string_split(flow_id, '')], lambda a, b: xor((a * 16777619) % 4294967296, b)) fnv32 from i",
    "project_ports_ips": f"with {FRAMES} select pkt_no, way dir, '{HWADDR}' hw_addr, starts_with(service_ip, '192.168.') or (is_ipv4 and {_PRIVATE.format('service_ip')} and {_PRIVATE.format('my_ip')}) is_local, is_tcp, service_ip, my_ip, service_port, my_port, length, data_length, seq from fr where way >= 0",
    "flow_id": f"with {FRAMES} select pkt_no, flow_id from pk",
    "dns_substring_match": f'with {DNS} select distinct "name", service, pattern from hits where kind = 0',
    "dns_regex_match": f'with {DNS} select distinct "name", service, pattern from hits where kind = 1',
    "dns_first_match": f"with {DNS} select dns_no, ip, ttl, service, pattern from fst",
    "dns_all_match": f"with {DNS} select distinct dns_no, ip, service, kind from hits where kind = 0 union all select dns_no, ip, arg_min(service, service_id * 1000 + pos), 1 from hits where kind = 1 group by dns_no, ip",
    "cidr_first_match": f"with {FRAMES}, {CIDR} select ip, arg_min(service, pos) service, arg_min(prefix, pos) prefix from cid group by ip",
    "cidr_all_match": f"with {FRAMES}, {CIDR} select ip, service, prefix from cid",
    "dns_asof_ttl": f"with {FRAMES}, {DNS}, {CIDR}, {SERVICE} select pkt_no, dns_service service from asf",
    "service_lookup": f"with {FRAMES}, {DNS}, {CIDR}, {SERVICE} select pkt_no, service_ip, service from svc",
    "known_service_filter": f"with {FRAMES}, {DNS}, {CIDR}, {SERVICE} select pkt_no, service from svc where service is not null",
    "flow_create": f"with {_ALL} select flow_id, instance, service, service_ip, my_ip local_ip, case when is_tcp then 'TCP' else 'UDP' end protocol, my_port::varchar local_port, service_port::varchar service_port from fl qualify row_number() over (partition by flow_id, instance order by ts_ns) = 1",
    "flow_expiry": f"with {_ALL} select flow_id, instance, min(service) service, min(ts_ns) ts_first, max(ts_ns) ts_last, count(*) packets from fl group by flow_id, instance",
    "packet_counters": f"with {FRAMES} {_counters('flow_id')}",
    "packet_counters_tick": f"with {FRAMES} {_counters('flow_id, tick')}",
    "packet_counters_service": f"with {_ALL} {_counters('service, tick', f'(select * from fl where service in (select service from {_COLLECTS}))')}",
    "stream_packet_counters": f"with {FRAMES} {_counters('flow_id, tick')}",
    "video_segments": f"""with {FRAMES}, {SEGMENTS}, x as (select *, max(seg) over (partition by flow_id) = seg run from so)
select flow_id, seg, len_ "Len", seq_ "Seq", start_ "TsStart", case when run then 0 else last_ end "TsEnd", last_ "LastPkt", pkts_ "DownPkts", bytes_ "DonwBytes", max_ "MaxDSeq" from x where run or pkts_ > 0""",
    "video_segments_tick": f"with {FRAMES}, {SEGMENTS}, {_segment_ticks('flow_id', 'select flow_id, max(tick) last_tick from sg where seg > 0 group by flow_id')} select * from vt",
    "tcp_flags": f"with {FRAMES} select flow_id, tick, {_FLAGS} from pk where is_tcp group by flow_id, tick",
    "tcp_bytes_moments": f"with {FRAMES}, {_tcp('flow_id, tick')} select flow_id, tick, {_BYTES}, {_ways('RecWindow', 'win')}, {_ways('BytesPerPkt', 'bytes')} from tc group by flow_id, tick",
    "tcp_inflight": f"with {FRAMES}, {_tcp('flow_id, tick')} select pkt_no, in_flight from tc",
    "tcp_ooo": f"with {FRAMES}, {_tcp('flow_id, tick')} select flow_id, tick, {_OOO} from tc group by flow_id, tick",
    "tcp_retransmit": f"with {FRAMES}, {_tcp('flow_id')} select pkt_no, flow_id, dir from tc where retr",
    "tcp_rtt": f"with {FRAMES}, {_tcp('flow_id')} select pkt_no, flow_id, rtt from tc where rtt is not null",
    "tcp_state": f"with {FRAMES}, {_tcp('flow_id, tick')} select flow_id, tick, {_FLAGS}, {_RETR}, {_OOO}, {_BYTES}, {_ways('RecWindow', 'win')}, {_ways('BytesPerPkt', 'bytes')}, {_ways('BytesInFlight', 'in_flight')}, {_RTT} from tc group by flow_id, tick",
    "latency_jitter": f"""with {FRAMES}, {_tcp('flow_id')}, j as (select *, abs(rtt - lag(rtt, 1, 0) over (partition by flow_id order by ts_ns)) jit from tc where rtt is not null),
o as (select distinct flow_id, tick from tc)
select flow_id, tick, {_RTT}, round(coalesce(avg(jit), 0) / 1e6, 5) "JitterAvg", round(coalesce(case when count(jit) > 1 then var_samp(jit) end, 0) / 1e12, 5) "JitterVar", count(rtt) "RTTs" from o left join j using (flow_id, tick) group by flow_id, tick""",
    "byte_copy": f"with {_RAW}, g as (select flow_id, string_agg(part, '' order by doc_id)[1:800] h from hx group by flow_id) select flow_id, (length(h) // 2)::bigint copied_bytes, md5(unhex(h)) data_md5 from g where h <> ''",
    "welford_moments": "select user_id, count(value) n, round(avg(value), 4) avg_value, round(coalesce(case when count(value) > 1 then var_samp(value) end, 0), 4) var_value, round(coalesce(case when count(value) > 1 then stddev_samp(value) end, 0), 4) std_value from events group by user_id",
    "idle_emit": f"""with {_ALL}, c as ({_counters('flow_id, instance, tick', 'fl')}), t as (select flow_id, instance, unnest(range(min(tick), (max(ts_ns) + {CONFIG.evict_ns}) // 10000000000 + 1)) tick from fl group by flow_id, instance)
select flow_id, instance, tick, coalesce("InCounter", 0) "InCounter", coalesce("OutCounter", 0) "OutCounter", coalesce("InBytes", 0) "InBytes", coalesce("OutBytes", 0) "OutBytes" from t left join c using (flow_id, instance, tick)""",
    "flow_json": f"with {_RECORDS} select flow_id, instance, tick, json from js",
    "storage_profile": f"with {_RECORDS} select tick, count(*) flows, sum(strlen(json))::bigint json_bytes, max(strlen(json))::bigint largest_bytes from js group by tick",
    "stream_flow_json": f"with {_RECORDS} select flow_id, instance, tick, json from js",
    "stream_service_lookup": f"with {FRAMES}, {DNS}, {CIDR}, {SERVICE} select pkt_no, service_ip, service from svc",
    "cachedump_envelope": f"""with {_RECORDS}
select tick, flow_id[1] part, '{{"Version":"3.0","Conf":"--","Type":"CacheDump","TsStart":' || tick * 10 || ',"TsEnd":' || (tick * 10 + 10) || ',"Data":[' || string_agg(json, ',' order by flow_id, instance) || ']}}' json from js group by tick, flow_id[1]""",
    "byte_copy_tick": """with w as (select doc_id, 'flow-' || (doc_id // 8) flow_id, doc_id // 10 tick, encode(coalesce(text, '')) raw from documents),
p as (select *, hex(raw)[1 : 108] h from w),
b as (select *, coalesce(sum(length(h)) over (partition by flow_id order by doc_id rows between unbounded preceding and 1 preceding), 0) before from p),
o as (select *, case when before < 800 then h[1 : (800 - before)::bigint] else '' end own from b)
select flow_id, tick, max(least(before + length(h), 800)::bigint) // 2 copied_bytes, md5(unhex(string_agg(own, '' order by doc_id))) data_md5 from o group by flow_id, tick""",
    "png_copy": f"with {_RAW}, g as (select flow_id, string_agg(part, '' order by doc_id)[1:800] h from hx group by flow_id) select flow_id, case when length(h) = 800 then md5(unhex(h)) end pixels_md5 from g where h <> ''",
    "welford_checked": """with recursive e as (select user_id, value::double x, row_number() over (partition by user_id order by event_id) i from events),
r as (select user_id, i, 1::bigint n, x "avg", 0.0::double m2 from e where i = 1
  union all select user_id, i, case when bad then n else n + 1 end, case when bad then "avg" else a2 end, case when bad then m2 else q2 end from
    (select *, x > 1.5 * sqrt(q2 / greatest(n, 1)) and x > 10.0 bad from (select *, m2 + (x - "avg") * (x - a2) q2 from (select r.user_id, e.i, e.x, r.n, r."avg", r.m2, r."avg" + (e.x - r."avg") / (r.n + 1) a2 from r join e on e.user_id = r.user_id and e.i = r.i + 1))))
select user_id, n, round("avg", 6) avg_value from r qualify row_number() over (partition by user_id order by i desc) = 1""",
    "random_trace": f"""with t as (select event_id id from events)
select id pkt_no, id * 20000000 ts_ns, {_pick(8, 0, 2)}::int dir, lower(lpad(to_hex({_pick(9, 0, 64)} * 4 + 2), 2, '0')) || {" || ".join(f"':' || lower(lpad(to_hex({_pick(10 + i, 0, 256)}), 2, '0'))" for i in range(5))} hw_addr, true is_ipv4, true is_tcp,
  {" || '.' || ".join(_pick(i, 1, 255) for i in range(4))} service_ip, {" || '.' || ".join(_pick(4 + i, 1, 255) for i in range(4))} my_ip, {_pick(21, 1, 65536)}::int service_port, {_pick(22, 1, 65536)}::int my_port, {_pick(20, 20, 1480)} length, {_pick(20, 20, 1480)} - 20 data_length, {_pick(23, 0, 1 << 32)} seq from t""",
    "ifstats": """with x as (select event_id * 20000000 // 10000000000 tick, count(*) n from events group by 1)
select tick, n "PktRecv", 0::bigint "PktDrop", '{"Version":"3.0","Conf":"--","Type":"IfStatsPrinter","TsStart":' || tick * 10 || ',"TsEnd":' || (tick * 10 + 10) || ',"Data":[{"Name":"","PktRecv":' || n || ',"PktDrop":0}]}' json from x""",
}
