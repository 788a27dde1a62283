"""Flows: keyed by the 4-tuple, bound to a service when they start, split when idle for too long."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.packets import with_flow_id
from flowloom.operators.scan import Running, by_weight, running


def flow_packets(classified: DataFrame, evict_ns: int) -> DataFrame:
    """The packets that belong to flows, with ``flow_id``, ``instance`` and the flow's service.

    ``classified`` has ``service_id`` and ``service`` for each packet. A flow starts at
    its first classified packet and keeps that service; packets before it are dropped.
    After a gap of more than ``evict_ns`` the flow is gone and a new instance starts.
    """

    def bound(rows: DataFrame, bucket_ns: int | None) -> DataFrame:
        rows = running(rows, ["flow_id"], {"before_ns": Running("last", F.col("ts_ns"))}, bucket_ns)
        gap = F.coalesce(F.col("ts_ns") - F.col("before_ns") > evict_ns, F.lit(False))
        rows = running(rows, ["flow_id"], {"instance": Running("sum", gap.cast("long"), True)}, bucket_ns).drop("before_ns")
        known = F.when(F.col("service_id").isNotNull(), F.struct("service_id", "service"))
        rows = running(rows, ["flow_id", "instance"], {"bound": Running("first", known, True)}, bucket_ns).where("bound is not null")
        return rows.withColumns({"service_id": F.col("bound.service_id"), "service": F.col("bound.service")}).drop("bound")

    return by_weight(with_flow_id(classified), ["flow_id"], bound)


def flows(packets: DataFrame) -> DataFrame:
    """One row a flow instance, described by its first packet."""
    first = F.min_by(F.struct("service", "service_id", "service_ip", "my_ip", "is_tcp", "my_port", "service_port"), F.struct("ts_ns", "pkt_no"))
    rows = packets.groupBy("flow_id", "instance").agg(first.alias("f"), F.min("ts_ns").alias("ts_first"), F.max("ts_ns").alias("ts_last"), F.count(F.lit(1)).alias("packets"))
    return rows.select(
        "flow_id",
        "instance",
        F.col("f.service").alias("service"),
        F.col("f.service_id").alias("service_id"),
        F.lit("").alias("domain_name"),
        F.col("f.service_ip").alias("service_ip"),
        F.col("f.my_ip").alias("local_ip"),
        F.when(F.col("f.is_tcp"), "TCP").otherwise("UDP").alias("protocol"),
        F.col("f.my_port").cast("string").alias("local_port"),
        F.col("f.service_port").cast("string").alias("service_port"),
        "ts_first",
        "ts_last",
        "packets",
    )


def with_idle_ticks(features: DataFrame, ticks: DataFrame, values: list[str]) -> DataFrame:
    """``features`` by (flow_id, instance, tick) with rows of zeros for ticks in which a live flow was idle.

    ``ticks`` holds (flow_id, instance, first_tick, last_tick): from the flow's start to its eviction.
    """
    flow = ["flow_id", "instance"]
    begun = ticks.select(*flow, F.col("first_tick").alias("tick"), "last_tick")
    both = features.select(*flow, "tick", *values).unionByName(begun, allowMissingColumns=True).repartition(*flow)
    known = both.groupBy(*flow, "tick").agg(*(F.max(c).alias(c) for c in ("last_tick", *values)))
    order = Window.partitionBy(*flow).orderBy("tick")
    last = F.last("last_tick", True).over(order)
    # A tick's row stands for the idle ticks up to the next one as well, so that these are made at the end.
    until = F.least(F.coalesce(F.lead("tick").over(order) - 1, last), last)
    spread = known.withColumn("until", until).where("tick <= until").withColumn("at", F.explode(F.sequence("tick", "until")))
    return spread.select(*flow, F.col("at").alias("tick"), *(F.when(F.col("at") == F.col("tick"), F.coalesce(v, F.lit(0))).otherwise(F.lit(0)).alias(v) for v in values))
