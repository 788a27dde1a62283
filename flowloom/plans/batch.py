"""A whole trace: frames to packets, services, flows, features by tick, and envelopes."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.config import Config
from flowloom.functions.anonymize import Anonymizer
from flowloom.functions.net import traffic_filter
from flowloom.model import SECOND
from flowloom.operators import classify, flows, packets, registry
from flowloom.storage import written

FLOW = ["flow_id", "instance"]
VERSION = "3.0"


def flow_packets(spark: SparkSession, frames: DataFrame | Mapping[str, DataFrame], config: Config, messages: DataFrame | None = None, hwaddr: str | None = None, key: bytes | None = None, start_s: int | None = None) -> DataFrame:
    """Packets of flows with ``tick``, by the traffic parsers of the configuration, which feed one cache.

    With several parsers, ``frames`` names each interface's frames.
    Local addresses are anonymised if the configuration says so, with ``key``.
    """
    parsers = config.traffic_parsers
    if isinstance(frames, DataFrame):
        if len(parsers) > 1:
            raise ValueError("several traffic parsers need the frames of each interface")
        frames = {parsers[0].ifname: frames}
    if missing := {p.ifname for p in parsers} - frames.keys():
        raise ValueError(f"no frames of {sorted(missing)}")
    ports = F.col("proto"), F.col("src_port"), F.col("dst_port")
    rows = reduce(DataFrame.unionByName, (packets.project(frames[p.ifname].where(traffic_filter(*ports)), p.mode, hwaddr or p.hwaddr or "", p.localnet) for p in parsers))
    if config.anonymize:
        if key is None:
            raise ValueError("anonymising needs a key")
        rows = Anonymizer(spark, key).apply(rows, "my_ip")
    rows = flows.flow_packets(classify.with_service(spark, rows, config, messages), config.evict_ns)
    return packets.with_tick(rows, packets.start_second(rows) if start_s is None else start_s)


def flow_json(spark: SparkSession, rows: DataFrame, config: Config, start_s: int = 0, seconds: int = 10) -> DataFrame:
    """(flow_id, instance, tick, json): each flow's record of each tick from its start to its eviction, idle ones too.

    The packets are made once, in the shared folder; each feature of a flow's service
    then reads the columns that it needs. Only ticks in which something happened are shuffled: each
    stands for the idle ones up to the next as well, which are made at the end.
    """
    rows = written(rows, "packets")
    until = F.expr(f"((max(ts_ns) + {config.evict_ns}) div {SECOND} - {start_s}) div {seconds}")
    lives = flows.flows(rows).join(rows.groupBy(*FLOW).agg(F.min("tick").alias("tick"), until.alias("until_tick")), FLOW)
    about = F.struct(*(F.col(c).alias(n) for c, n in (("flow_id", "Id"), ("service", "Service"), ("domain_name", "DomainName"), ("service_ip", "ServiceIP"), ("local_ip", "LocalIP"), ("protocol", "Protocol"), ("local_port", "LocalPort"), ("service_port", "ServicePort"))))
    # Pieces of JSON are put together as they are: what is in a name never looks like one.
    made = [lives.select(*FLOW, "tick", "service_id", "until_tick", F.to_json(about).alias("head"))]
    names = sorted({f for s in config.services for f in s.collect})
    collects = [F.col("service_id").isin([i for i, s in enumerate(config.services) if name in s.collect]) for name in names]
    none = []
    for k, name in enumerate(names):
        found, before = registry.records(registry.get(name), rows.where(collects[k]), FLOW)
        made.append(found.withColumnsRenamed({"Data": f"data{k}", "Idle": f"idle{k}"}))
        none.append(before)
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made).repartition(*FLOW)
    known = both.groupBy(*FLOW, "tick").agg(*(F.max(c).alias(c) for c in both.columns if c not in (*FLOW, "tick")))
    order = Window.partitionBy(*FLOW).orderBy("tick")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = {c: F.last(c, True).over(order) for c in ("service_id", "until_tick", "head", *(f"idle{k}" for k in range(len(names))))}
    data = {f"data{k}": F.coalesce(f"data{k}", F.last(f"idle{k}", True).over(earlier), none[k]) for k in range(len(names))}
    full = known.withColumns({**so_far, **data, "next_tick": F.lead("tick").over(order)}).where("tick <= until_tick")
    last = F.least(F.coalesce(F.col("next_tick") - 1, F.col("until_tick")), F.col("until_tick"))
    every = full.withColumn("at", F.explode(F.sequence(F.col("tick"), last)))
    here = F.col("at") == F.col("tick")
    pieces = [F.when(collects[k], F.concat(F.lit(f'{{"CType":{json.dumps(name, ensure_ascii=False)},"Data":'), F.when(here, F.col(f"data{k}")).otherwise(F.coalesce(f"idle{k}", none[k])), F.lit("}"))) for k, name in enumerate(names)]
    return every.select(*FLOW, F.col("at").alias("tick"), F.concat(F.expr("substring(head, 1, char_length(head) - 1)"), F.lit(',"Cntrs":['), F.concat_ws(",", *pieces), F.lit("]}")).alias("json"))


def envelope(kind: str, start_s, end_s, data):
    """A record of a sink: version, configuration, kind, interval in seconds, and data in JSON."""
    head = F.concat(F.lit(f'{{"Version":"{VERSION}","Conf":"--","Type":"{kind}","TsStart":'), start_s.cast("string"), F.lit(',"TsEnd":'), end_s.cast("string"), F.lit(',"Data":'))
    return F.concat(head, data, F.lit("}"))


def cache_dump(records: DataFrame, start_s: int, seconds: int = 10, digits: int = 2) -> DataFrame:
    """(tick, part, json): envelopes of a tick's flows, dealt by the first hex digits of their ids.

    Each further digit makes sixteen times as many parts, so that no task need hold a whole tick.
    """
    numbered = records.withColumn("part", F.substring("flow_id", 1, digits))
    listed = numbered.groupBy("tick", "part").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("flow_id", "instance", "json"))), lambda x: x["json"]), ","), F.lit("]")).alias("data"))
    begin = F.lit(start_s) + F.col("tick") * seconds
    return listed.select("tick", "part", envelope("CacheDump", begin, begin + seconds, F.col("data")).alias("json"))


def interface_stats(frames: DataFrame, start_s: int, seconds: int = 10) -> DataFrame:
    """(tick, json, PktRecv): packets received by tick; a capture file has dropped none."""
    rows = packets.with_tick(frames, start_s, seconds).groupBy("tick").agg(F.count(F.lit(1)).alias("PktRecv"))
    data = F.concat(F.lit("["), F.to_json(F.struct(F.lit("").alias("Name"), "PktRecv", F.lit(0).alias("PktDrop"))), F.lit("]"))
    begin = F.lit(start_s) + F.col("tick") * seconds
    return rows.select("tick", "PktRecv", F.lit(0).cast("long").alias("PktDrop"), envelope("IfStatsPrinter", begin, begin + seconds, data).alias("json"))
