"""What a run costs: time a packet by feature, bytes of records by tick, bytes of state by flow.

``storage`` is a query like any other. ``cpu`` times each feature over packets that are made
beforehand, as often as asked, and gives the least and the median; ``folder`` does so for each
capture file of a folder. ``state`` reads what a stream's state stores report.
"""

from __future__ import annotations

import statistics
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.config import Config
from flowloom.operators import registry
from flowloom.operators.packets import with_flow_id, with_tick
from flowloom.storage import written

CPU = "feature string, packets long, loops int, ns_per_packet double, median_ns_per_packet double"


def storage(records: DataFrame) -> DataFrame:
    """(tick, flows, json_bytes, largest_bytes) of the records that ``flow_json`` gives."""
    size = F.octet_length("json").cast("long")
    return records.groupBy("tick").agg(F.count(F.lit(1)).alias("flows"), F.sum(size).alias("json_bytes"), F.max(size).alias("largest_bytes"))


def cpu(packets: DataFrame, features: Iterable[str], loops: int = 3) -> DataFrame:
    """Nanoseconds a packet of each feature, without what makes the packets: they have tick and flow already."""
    spark = packets.sparkSession
    rows = written(packets.withColumn("instance", F.lit(0).cast("long")), "profile")
    n = rows.count()
    made = []
    for name in features:
        took = []
        for _ in range(loops):
            began = time.perf_counter_ns()
            registry.get(name).batch(rows, ["flow_id", "instance"]).write.format("noop").mode("overwrite").save()
            took.append((time.perf_counter_ns() - began) / max(n, 1))
        made.append((name, n, loops, min(took), statistics.median(took)))
    return spark.createDataFrame(made, CPU)


def folder(spark: SparkSession, path: str, config: Config, hwaddr: str, loops: int = 3) -> DataFrame:
    """``cpu`` of the configuration's features for each capture file in ``path``, named by ``file``."""
    from flowloom.operators import packets
    from flowloom.sources import pcap

    names = sorted({f for s in config.services for f in s.collect})
    seen = written(pcap.read_frames(spark, path, "traffic"), "frames")
    parser = config.traffic_parsers[0]
    out = spark.createDataFrame([], f"file string, {CPU}")
    for file in [r.path for r in seen.select("path").distinct().orderBy("path").toLocalIterator()]:  # names alone
        own = packets.project(seen.where(F.col("path") == file), parser.mode, parser.hwaddr or hwaddr, parser.localnet)
        out = out.union(cpu(with_tick(with_flow_id(own), 0), names, loops).select(F.lit(file), "*"))
    return out


def state(query) -> dict[str, float]:
    """Rows and bytes that a stream's state stores hold at last, and bytes a row."""
    progress = [p for p in query.recentProgress if p.stateOperators]
    rows = sum(o.numRowsTotal for o in progress[-1].stateOperators) if progress else 0
    used = sum(o.memoryUsedBytes for o in progress[-1].stateOperators) if progress else 0
    return {"state_rows": rows, "state_bytes": used, "bytes_per_row": used / rows if rows else 0.0}
