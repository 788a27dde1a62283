"""Streams, and bounded runs of them.

``counters``: packet counters as a windowed aggregate under a watermark. ``flow_values``:
order-dependent features as state by flow, with a time to live of a flow's eviction;
each micro-batch is a tick and emits all flows that had packets in it. Packets of a
flow are taken in order of (ts_ns, pkt_no) within a micro-batch, and micro-batches in
order of arrival. ``service_lookup`` and ``flow_records`` keep event-time state (see ``lookup``
and ``records``) and so do not depend on how packets fall into micro-batches.
"""

from __future__ import annotations

import json
import pickle
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowloom.config import Config
from flowloom.operators import packets
from flowloom.operators.registry import SEEN
from flowloom.sources import tables
from flowloom.storage import shared_dir
from flowloom.streaming import lookup, records
from flowloom.streaming.state import Latency, Packets, TcpState, Video


def counters(rows: DataFrame, seconds: int = 10, late: str = "10 minutes") -> DataFrame:
    """Packet counters by flow and tick of a stream of packets with ``flow_id``."""
    timed = rows.withColumn("ts", F.timestamp_micros(F.expr("ts_ns div 1000"))).withWatermark("ts", late)
    into, out = F.col("dir") == 0, F.col("dir") == 1
    size = lambda way: F.coalesce(F.sum(F.when(way, F.col("length"))), F.lit(0))
    made = timed.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "flow_id").agg(F.count_if(into).alias("InCounter"), F.count_if(out).alias("OutCounter"), size(into).alias("InBytes"), size(out).alias("OutBytes"))
    return made.select("flow_id", F.expr(f"unix_seconds(w.start) div {seconds}").alias("tick"), "InCounter", "OutCounter", "InBytes", "OutBytes")


#: Idle time after which a flow's state goes.
EVICT_MS = 600_000
_STATE = "body binary"
_OUT = "flow_id string, packets long, Data string"


def _flow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    kept = pickle.loads(state.get[0]) if state.exists else (Packets(), Video(), TcpState(), Latency())
    rows = pd.concat(list(batches)).sort_values(["ts_ns", "pkt_no"])
    for p in rows.itertuples(index=False):
        for feature in kept:
            feature.add(p)
    names = ("PacketCounters", "VideoCounters", "TCPState", "LatencyJitterCounter")
    data = {n: f.values() for n, f in zip(names, kept, strict=True)}
    for feature in kept:
        feature.clear()
    state.update((pickle.dumps(kept),))
    if state._timeout_conf != "NoTimeout":
        state.setTimeoutDuration(EVICT_MS)
    yield pd.DataFrame({"flow_id": [key[0]], "packets": [len(rows)], "Data": [json.dumps(data)]})


def flow_values(rows: DataFrame, evict: bool = True) -> DataFrame:
    """(flow_id, packets, Data): features of each flow with packets in a micro-batch.

    With ``evict`` the state of a flow that has been idle goes; a stream that is to end
    by itself needs it off, as waiting for that time never ends.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if evict else GroupStateTimeout.NoTimeout
    seen = rows.select("flow_id", *SEEN)  # what the features read; the rest need not be made
    return seen.groupBy("flow_id").applyInPandasWithState(_flow, _OUT, _STATE, "append", timeout)


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # A folder of files streams as it is; a single file is found by its name.
    folder = spark.read.parquet(path).select(F.input_file_name()).first()
    single = folder is not None and folder[0].rstrip("/").endswith(f"{name}.parquet")
    source = spark.readStream.schema(schema)
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if single else source.parquet(path)


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream of packets."""
    return packets.project(tables.frames_of(_source(spark, sf_dir, "events")), "host", tables.HWADDR, "192.168.0.0/16")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with ``flow_id``."""
    return packets.with_flow_id(_packets(spark, sf_dir))


def _finished(rows: DataFrame, mode: str) -> DataFrame:
    """All that a bounded stream emits, by files in the shared folder."""
    spark = rows.sparkSession
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}" if mode == "append" else f"{place}/out/last")

    run = rows.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{place}/out")


def counters_by_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished(counters(_stream(spark, sf_dir)), "complete")


def flow_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished(flow_values(_stream(spark, sf_dir), False), "append")


#: Nanoseconds that the clock goes beyond the last packet when a bounded stream ends.
BEYOND_NS = 3_600 * 1_000_000_000
#: State on disk, and no more of it or of what comes in at once than a few blocks of packets.
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 * lookup.CHUNK_BYTES),
    "spark.sql.execution.arrow.transformWithStateInPySpark.maxStateRecordsPerBatch": str(lookup.CHUNK),
}


class Clock:
    """A stream of times in a folder, for streams whose sources say nothing for a while."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], "ts_ns long").write.parquet(path)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema("ts_ns long").parquet(self.path)

    def tell(self, ts_ns: int) -> None:
        self.spark.createDataFrame([(ts_ns,)], "ts_ns long").coalesce(1).write.mode("append").parquet(self.path)


def drained(rows: DataFrame, place: str, clock: Clock, end_ns: int, pause: bool = False, late: list[int] | None = None) -> DataFrame:
    """All that a bounded stream with event-time state emits, as a table at ``place``.

    All files must be one micro-batch, behind which the clock says that all is over. With ``pause``, for sources of
    several micro-batches, the stream stops before that, and goes on from its checkpoint once the clock
    has said so. ``late`` gets the number of rows dropped behind the watermark.
    """
    spark = rows.sparkSession
    before = {name: spark.conf.get(name) for name in _CONF}
    for name, value in _CONF.items():
        spark.conf.set(name, value)
    try:
        for over in (False, True) if pause else (True,):
            if over:
                clock.tell(end_ns)
            run = rows.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").outputMode("append").trigger(availableNow=True).start()
            run.awaitTermination()
            if late is not None:
                late.append(sum(o.numRowsDroppedByWatermark for p in run.recentProgress for o in p.stateOperators))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(rows.schema).parquet(f"{place}/out")


def _end_ns(*tables_: DataFrame) -> int:
    """A time beyond all that the tables have."""
    found = [df.agg(F.max("ts_ns")).first()[0] for df in tables_]
    return max([0, *(x for x in found if x is not None)]) + BEYOND_NS


def classified(spark: SparkSession, sf_dir: str, place: str, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of packets with their services, as a stream of packets and one of DNS messages give them."""
    from flowloom.plans.queries import CONFIG

    clock = Clock(spark, f"{place}/clock")
    messages = tables.dns_messages_of(_source(spark, sf_dir, "pages"))
    rows = lookup.with_service(_packets(spark, sf_dir).select(*columns), messages, CONFIG, clock.stream())
    return drained(rows, place, clock, _end_ns(tables.frames(spark, sf_dir), tables.dns_messages(spark, sf_dir)))


def service_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", ("ts_ns", "pkt_no", "service_ip"))


def flow_records(spark: SparkSession, sf_dir: str, config: Config) -> DataFrame:
    """The records of all flows: one stream finds services, another one reads its output and keeps flows."""
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    found = classified(spark, sf_dir, f"{place}/services", (*SEEN, "service_ip", "my_ip", "service_port", "my_port"))
    clock = Clock(spark, f"{place}/clock")
    source = spark.readStream.schema(found.schema).parquet(f"{place}/services/out")
    return drained(records.records(source, clock.stream(), config), f"{place}/records", clock, _end_ns(found))
