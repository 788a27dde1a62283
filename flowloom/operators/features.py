"""The features of flows, as windows and aggregates over packets in order of (ts_ns, pkt_no).

``keys`` name the columns a state belongs to: the flow, or the flow and its tick where
a tick starts with fresh state. What depends on all earlier packets of a flow is a running
value in two levels (see ``scan``), so that a flow with most packets is many tasks.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.net import uint32
from flowloom.functions.welford import mean, variance
from flowloom.model import IN, OUT
from flowloom.operators.scan import Running, by_weight, running, weighed
from flowloom.storage import written

#: Payload that a packet other than TCP must pass to be a request.
QUIC_HEADER = 100
FLOW = ("flow_id", "instance")


def _order(keys: list[str], *more: str):
    return Window.partitionBy(*keys, *more).orderBy("ts_ns", "pkt_no")


def _before(keys: list[str], *more: str):
    return _order(keys, *more).rowsBetween(Window.unboundedPreceding, -1)


def packet_counters(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Packets and bytes each way; fully mergeable, so it combines before the shuffle."""
    into, out = F.col("dir") == IN, F.col("dir") == OUT
    size = lambda way: F.coalesce(F.sum(F.when(way, F.col("length"))), F.lit(0))
    return packets.groupBy(*keys).agg(F.count_if(into).alias("InCounter"), F.count_if(out).alias("OutCounter"), size(into).alias("InBytes"), size(out).alias("OutBytes"))


def is_request() -> Column:
    return (F.col("dir") == OUT) & F.when(F.col("is_tcp"), F.col("data_length") > 0).otherwise(F.col("data_length") > QUIC_HEADER)


def _segments(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Packets from a flow's first request on, numbered by the requests so far; of their columns those that segments need.

    Requests and data are shuffled alone. How long a flow lasts is told by a row of its own behind its last packet.
    """
    ticks = [c for c in ("tick", "until_tick") if c in packets.columns and c not in keys]
    request = F.coalesce(is_request(), F.lit(False))
    data = F.coalesce((F.col("dir") == IN) & (F.col("data_length") > 0), F.lit(False))
    size = F.when(request, F.col("length")).otherwise(F.col("data_length"))
    rows = packets.where(request | data).select(*keys, "ts_ns", "pkt_no", *ticks, request.cast("long").alias("asks"), size.alias("size"), "seq")
    seg = {"seg": Running("sum", F.col("asks"), True)}
    if "tick" in keys:
        found = running(rows, keys, seg, None)
    else:
        lives = written(packets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.max(c).alias(c) for c in ("ts_ns", "pkt_no", *ticks))), "lives")
        ends = lives.drop("n").withColumns({"asks": F.lit(0).cast("long"), "size": F.lit(0)})
        # All partitions stay as they are: put together, one for each core, they outgrow its memory and are spilled.
        parts = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        numbered = lambda own, bucket_ns: running(own.repartition(parts, *keys) if bucket_ns is None else own, keys, seg, bucket_ns)
        found = by_weight(rows.unionByName(ends, allowMissingColumns=True), keys, numbered, counted=lives)
    return found.where("seg > 0").withColumns({"is_request": F.col("asks") > 0, "is_data": (F.col("asks") == 0) & (F.col("size") > 0)})


def _segment_values() -> list[Column]:
    request = lambda c: F.max(F.when(F.col("is_request"), F.col(c)))
    data = F.col("is_data")
    return [
        request("size").alias("Len"),
        request("seq").alias("Seq"),
        request("ts_ns").alias("TsStart"),
        F.coalesce(F.max(F.when(data, F.col("ts_ns"))), F.lit(0)).alias("LastPkt"),
        F.count_if(data).alias("DownPkts"),
        F.coalesce(F.sum(F.when(data, F.col("size"))), F.lit(0)).alias("DonwBytes"),
        F.coalesce(F.max(F.when(data, F.col("seq"))), F.lit(0)).alias("MaxDSeq"),
    ]


def video_segments(packets: DataFrame, keys: list[str]) -> DataFrame:
    """A request and the data that answers it, up to the next request.

    The last segment of a flow is running: its TsEnd is 0. Others without data are forgotten.
    """
    made = _segments(packets, keys).groupBy(*keys, "seg").agg(*_segment_values())
    made = made.withColumn("running", F.col("seg") == F.max("seg").over(Window.partitionBy(*keys)))
    running = F.col("running")
    made = made.withColumn("TsEnd", F.when(running, F.lit(0)).otherwise(F.col("LastPkt"))).where(running | (F.col("DownPkts") > 0))
    return made.select(*keys, "seg", "Len", "Seq", "TsStart", "TsEnd", "LastPkt", "DownPkts", "DonwBytes", "MaxDSeq")


_SO_FAR = ("LastPkt", "DownPkts", "DonwBytes", "MaxDSeq")


def _segment_ticks(packets: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each segment and tick with packets of it: all that it has so far, and the next row of its flow.

    ``next_seg`` and ``next_tick`` are those of the next row by segment and tick, so that of a segment's last row they
    tell the tick in which it is closed; ``last_tick`` is the flow's last tick so far.
    """
    rows = _segments(packets, keys)
    last = "until_tick" if "until_tick" in packets.columns else "tick"
    by_tick = rows.groupBy(*keys, "seg", "tick").agg(*_segment_values(), F.max(last).alias("own_last"))
    so_far = Window.partitionBy(*keys, "seg").orderBy("tick").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flow = Window.partitionBy(*keys).orderBy("seg", "tick")
    total = {c: (F.sum if c in ("DownPkts", "DonwBytes") else F.max)(c).over(so_far) for c in ("Len", "Seq", "TsStart", *_SO_FAR)}
    after = {"next_seg": F.lead("seg").over(flow), "next_tick": F.lead("tick").over(flow), "last_tick": F.max("own_last").over(flow)}
    return by_tick.withColumns(total | after)


def _emitted(rows: DataFrame, keys: list[str], ticks: Column) -> DataFrame:
    """``rows`` of ``_segment_ticks`` at each of ``ticks``, with TsEnd; closed segments without data are forgotten."""
    own = rows.withColumn("at", F.explode(ticks))
    closed = F.coalesce((F.col("next_seg") != F.col("seg")) & (F.col("at") == F.col("next_tick")), F.lit(False))
    own = own.withColumn("closed", closed).where("not closed or DownPkts > 0")
    end = F.when(F.col("closed"), F.col("LastPkt")).otherwise(F.lit(0)).alias("TsEnd")
    return own.select(*keys, F.col("at").alias("tick"), "seg", "Len", "Seq", "TsStart", end, *_SO_FAR, "closed")


def video_segments_tick(packets: DataFrame, keys: list[str]) -> DataFrame:
    """What each tick emits: closed segments once, the running one again and again, with all it has so far.

    A segment is emitted from its request's tick to that of the next request, in which
    it is closed, or to the flow's last tick: that of its last packet, or ``until_tick`` where
    the packets have that column. Ticks between are made last, and are not shuffled.
    """
    rows = _segment_ticks(packets, keys)
    until = F.when(F.col("next_tick").isNull(), F.col("last_tick")).when(F.col("next_seg") == F.col("seg"), F.col("next_tick") - 1).otherwise(F.col("next_tick"))
    return _emitted(rows, keys, F.sequence(F.col("tick"), until)).drop("closed")


def video_by_tick(packets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tick, VideoSegments, VideoSegments_idle): what ticks with packets emit, and what the idle ticks after each repeat."""
    both = (F.col("next_seg") != F.col("seg")) & (F.col("next_tick") > F.col("tick"))
    rows = _emitted(_segment_ticks(packets, keys), keys, F.when(both, F.array("tick", "next_tick")).otherwise(F.array("tick")))
    one = F.struct("seg", "Len", "Seq", "TsStart", "TsEnd", *_SO_FAR)
    listed = rows.groupBy(*keys, "tick").agg(F.array_sort(F.collect_list(one)).alias("s"), F.max(F.when(~F.col("closed"), one)).alias("r"))
    return listed.select(*keys, "tick", F.transform("s", lambda x: x.dropFields("seg")).alias("VideoSegments"), F.array(F.col("r").dropFields("seg")).alias("VideoSegments_idle"))


def tcp_rows(packets: DataFrame, keys: list[str]) -> DataFrame:
    """TCP packets with what the state before them says: in flight, out of order, retransmitted, round trip.

    A data packet's key is the number that acknowledges it. The keys outstanding at a
    packet are those sent since the last growth of the acknowledged number, if that
    number has passed the key, else all sent before; so two windows over the packets
    of a key find its first and last outstanding sender.
    """
    rows = packets.where("is_tcp").withColumn("bytes", F.col("length") - 4 * F.col("data_offset"))
    into, out, data = F.col("dir") == IN, F.col("dir") == OUT, F.col("bytes") > 0
    most = lambda way, c, extra: Running("max", F.when(way & extra, F.col(c)))
    firsts = {"ack_down": most(into, "ack", F.col("f_ack")), "ack_up": most(out, "ack", F.col("f_ack")), "seq_down": most(into, "seq", data), "seq_up": most(out, "seq", data)}
    rows = weighed(rows, keys, {"i": Running("sum", F.lit(1).cast("long"), True), **firsts}).withColumns({n: F.coalesce(n, F.lit(0)) for n in firsts})
    rows = rows.withColumn("key", uint32(F.col("seq") + F.col("bytes")))
    grown = lambda way, c: Running("max", F.when(way & F.col("f_ack") & (F.col("ack") > F.col(c)), F.col("i")))
    grew = {"grown_down": grown(into, "ack_down"), "grown_up": grown(out, "ack_up")}
    rows = weighed(rows, keys, grew).withColumns({n: F.coalesce(n, F.lit(0)) for n in grew})
    in_flight = uint32(F.col("seq") + F.col("bytes") - F.when(into, F.col("ack_up")).otherwise(F.col("ack_down")))
    out_of_order = data & (F.col("seq") < F.when(into, F.col("seq_down")).otherwise(F.col("seq_up")))
    passed = F.when(into, F.col("ack_up")).otherwise(F.col("ack_down")) > F.col("key")
    since = F.when(passed, F.when(into, F.col("grown_up")).otherwise(F.col("grown_down"))).otherwise(F.lit(0))
    # Packets that ask for nothing have a key of their own, so that they are no one group.
    rows = rows.withColumns({"in_flight": in_flight, "ooo": out_of_order, "since": since, "repeated": F.when(data, F.col("key")).otherwise(-F.col("i"))})
    previous = F.max(F.when(data, F.col("i"))).over(_before(keys, "dir", "repeated"))
    rows = rows.withColumn("retr", data & F.coalesce(previous > F.col("since"), F.lit(False))).drop("since", "repeated")
    # Round trips: what an incoming acknowledgement finds of outgoing data.
    acks = into & F.col("f_ack")
    rows = rows.withColumn("asked", F.when(out & data, F.col("key")).when(acks, F.col("ack")).otherwise(-F.col("i"))).withColumn("sent", F.when(out & data, F.col("ts_ns")))
    all_sent = F.min("sent").over(_before(keys, "asked"))
    new_sent = F.min("sent").over(_before(keys, "asked", "grown_down"))
    first = F.when(F.col("ack_down") > F.col("ack"), new_sent).otherwise(all_sent)
    return rows.withColumn("rtt", F.when(acks, F.col("ts_ns") - first)).drop("asked", "sent")


_WAYS = (("Up", OUT), ("Down", IN))


def tcp_flags(rows: DataFrame, keys: list[str]) -> DataFrame:
    flags = (("Ack", "f_ack"), ("Syn", "f_syn"), ("Rst", "f_rst"), ("Push", "f_psh"), ("Urg", "f_urg"))
    return rows.groupBy(*keys).agg(*_flag_values(flags))


def _flag_values(flags) -> list[Column]:
    return [F.count_if((F.col("dir") == way) & F.col(c)).alias(f"{name}{side}Counter") for name, c in flags for side, way in _WAYS]


def tcp_state(packets: DataFrame, keys: list[str]) -> DataFrame:
    """All values of the TCP feature; its state starts afresh with each of ``keys``."""
    rows = tcp_rows(packets, keys)
    flags = (("Ack", "f_ack"), ("Syn", "f_syn"), ("Rst", "f_rst"), ("Push", "f_psh"), ("Urg", "f_urg"), ("Retr", "retr"), ("OOO", "ooo"))
    made = _flag_values(flags)
    made += [F.coalesce(F.sum(F.when(F.col("dir") == way, F.col("bytes"))), F.lit(0)).alias(f"Bytes{side}Counter") for side, way in _WAYS]
    for name, c in (("RecWindow", "window"), ("BytesPerPkt", "bytes"), ("BytesInFlight", "in_flight")):
        for side, way in _WAYS:
            x = F.when(F.col("dir") == way, F.col(c))
            made += [mean(x).alias(f"{side}{name}Avg"), variance(x).alias(f"{side}{name}Var")]
    made += [mean(F.col("rtt")).alias("RTTAvg"), variance(F.col("rtt")).alias("RTTVar")]
    return rows.groupBy(*keys).agg(*made)


def latency_jitter(packets: DataFrame, flow_keys: list[str], tick: str | None = None) -> DataFrame:
    """Moments of round trips and of their changes; the first change is the first round trip itself.

    The state is the flow's, the moments are each tick's.
    """
    rows = tcp_rows(packets, flow_keys)
    found = weighed(rows.where("rtt is not null"), flow_keys, {"last_rtt": Running("last", F.col("rtt"))})
    found = found.withColumn("jitter", F.abs(F.col("rtt") - F.coalesce("last_rtt", F.lit(0))))
    keys = [*flow_keys, *([tick] if tick else [])]
    made = found.groupBy(*keys).agg(mean(F.col("rtt")).alias("RTTAvg"), variance(F.col("rtt")).alias("RTTVar"), mean(F.col("jitter")).alias("JitterAvg"), variance(F.col("jitter")).alias("JitterVar"), F.count(F.lit(1)).alias("RTTs"))
    every = rows.select(*keys).distinct()
    values = [c for c in made.columns if c not in keys]
    return every.join(made, keys, "left").select(*keys, *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


def copied(raw: Column, layers: int) -> Column:
    """The bytes of a frame that are copied: its headers (0), its payload (2), or both (1)."""
    base = F.when(F.col("is_ipv4"), 4 * F.col("ihl")).otherwise(40)
    head = (14 + base + F.col("length") - F.col("data_length")).cast("int")
    payload = F.substr(raw, head + 1, F.greatest(F.col("data_length"), F.lit(0)).cast("int"))
    headers = F.substr(raw, F.lit(1), head)
    return {0: headers, 1: F.concat(headers, payload), 2: payload}[layers]


def _parts(packets: DataFrame, keys: list[str], layers: int, to_copy: int, *more: str) -> DataFrame:
    """Keys, order, each frame's bytes of which some may be copied, and how many bytes came before it."""
    part = F.when(F.col("raw_data").isNotNull(), F.substring(copied(F.col("raw_data"), layers), 1, to_copy))
    rows = packets.select(*dict.fromkeys([*keys, "ts_ns", "pkt_no", *more]), part.alias("part"))
    return weighed(rows, keys, {"before": Running("sum", F.octet_length("part").cast("long"))}).withColumn("before", F.coalesce("before", F.lit(0)))


def byte_copy(packets: DataFrame, keys: list[str], layers: int = 1, to_copy: int = 400) -> DataFrame:
    """The first ``to_copy`` bytes of a flow's frames, in order.

    Only frames before which the flow is not full reach the aggregate, so a group
    holds at most ``to_copy`` frames.
    """
    rows = _parts(packets.where("raw_data is not null"), keys, layers, to_copy).where((F.col("before") < to_copy) & (F.octet_length("part") > 0))
    parts = F.array_sort(F.collect_list(F.struct("ts_ns", "pkt_no", F.hex("part").alias("part"))))
    data = F.substring(F.unhex(F.array_join(F.transform(parts, lambda p: p["part"]), "")), 1, to_copy)
    return rows.groupBy(*keys).agg(data.alias("Data")).withColumn("CopiedBytes", F.octet_length("Data"))


def byte_copy_tick(packets: DataFrame, flow: list[str], layers: int = 0, to_copy: int = 400) -> DataFrame:
    """(flow, tick, CopiedBytes, Data): a flow's first ``to_copy`` bytes once in its life; each tick has those copied in it.

    ``CopiedBytes`` counts from the flow's start. Ticks without packets have no row.
    """
    rows = _parts(packets, flow, layers, to_copy, "tick")
    own = F.when(F.col("before") < to_copy, F.expr(f"substring(part, 1, int({to_copy} - before))"))
    parts = F.array_sort(F.collect_list(F.when(F.octet_length("own") > 0, F.struct("ts_ns", "pkt_no", F.hex("own").alias("part")))))
    data = F.unhex(F.array_join(F.transform(parts, lambda p: p["part"]), ""))
    so_far = F.max(F.least(F.col("before") + F.coalesce(F.octet_length("part"), F.lit(0)), F.lit(to_copy))).cast("long")
    return rows.withColumn("own", own).groupBy(*flow, "tick").agg(so_far.alias("CopiedBytes"), data.alias("Data"))


def png_pixels(image: bytes, side: int = 20) -> bytes:
    """The pixels of an image that ``png_image`` made."""
    import zlib

    at = image.index(b"IDAT")
    lines = zlib.decompress(image[at + 4 : at + 4 + int.from_bytes(image[at - 4 : at])])
    return b"".join(lines[i * (side + 1) + 1 : (i + 1) * (side + 1)] for i in range(side))


def png_image(pixels: bytes, side: int = 20) -> bytes:
    """A square 8-bit gray image in PNG form."""
    import struct
    import zlib

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = b"".join(b"\0" + pixels[i * side : (i + 1) * side].ljust(side, b"\0") for i in range(side))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", side, side, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def png_copy(packets: DataFrame, keys: list[str], layers: int = 1, side: int = 20) -> DataFrame:
    """The copied bytes as an image, once there are enough to fill it."""

    @F.pandas_udf("binary")
    def image(data: pd.Series) -> pd.Series:
        return data.map(lambda d: png_image(bytes(d), side) if d is not None and len(d) >= side * side else None)

    return byte_copy(packets, keys, layers, side * side).withColumn("Data", image("Data"))
