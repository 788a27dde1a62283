"""The features that a configuration can name. Others are added with ``@feature`` or ``@stateful``.

A feature has a form for tables, and one for streams: a class whose objects take a flow's
packets in order. A class alone is enough; tables then run it over each flow's packets.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import ClassVar, Protocol

import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators import features
from flowloom.streaming.state import Latency, Packets, TcpState, Video

#: (packets with a tick, keys of a flow) -> rows by flow and tick with the feature's values.
Batch = Callable[[DataFrame, list[str]], DataFrame]


class State(Protocol):
    """A feature's state of one flow.

    ``schema`` is what ``save`` gives and ``load`` takes, a tuple of a state store's types; ``emits``
    are the values of a tick. ``clear`` comes after each tick, and ``add`` for each packet in order of (ts_ns, pkt_no).
    """

    schema: ClassVar[str]
    emits: ClassVar[str]

    def add(self, p) -> None: ...
    def emit(self) -> dict: ...
    def clear(self) -> None: ...
    def save(self) -> tuple: ...
    @classmethod
    def load(cls, saved: tuple) -> State: ...


@dataclass(frozen=True)
class Feature:
    """``carry`` names values that a tick without packets repeats; its others are zero or empty.

    ``ticks`` gives ticks with packets alone, where ``batch`` gives idle ones too; ``x_idle`` is what the ticks after one have as ``x``.
    """

    name: str
    batch: Batch
    carry: tuple[str, ...] = ()
    state: type[State] | None = None
    ticks: Batch | None = None


_FEATURES: dict[str, Feature] = {}


def feature(name: str, carry: tuple[str, ...] = (), state: type[State] | None = None, ticks: Batch | None = None) -> Callable[[Batch], Batch]:
    """Registers a feature; a later one of the same name takes its place."""

    def put(batch: Batch) -> Batch:
        if not callable(batch):
            raise ValueError(f"{name}: not a feature")
        _FEATURES[name] = Feature(name, batch, carry, state, ticks)
        return batch

    return put


def stateful(name: str, carry: tuple[str, ...] = ()) -> Callable[[type[State]], type[State]]:
    """Registers a feature by its state alone, for tables and for streams.

    ``carry`` names the values that ``clear`` leaves as they are; the others are zero or empty in an idle tick.
    """

    def put(state: type[State]) -> type[State]:
        _FEATURES[name] = Feature(name, _by_state(state), carry, state)
        return state

    return put


#: What of a packet a state may read.
SEEN = ("ts_ns", "pkt_no", "dir", "is_tcp", "length", "data_length", "seq", "ack", "data_offset", "window", "f_syn", "f_rst", "f_psh", "f_ack", "f_urg")


def _by_state(state: type[State]) -> Batch:
    def batch(packets: DataFrame, flow: list[str]) -> DataFrame:
        kinds = {f.name: f.dataType.simpleString() for f in packets.schema.fields}
        head = ", ".join(f"{c} {kinds[c]}" for c in flow)

        def run(group: pd.DataFrame) -> pd.DataFrame:
            own, made, tick = state(), [], None
            for p in group.sort_values(["ts_ns", "pkt_no"]).itertuples(index=False):
                if tick is not None and p.tick != tick:
                    made.append((*key, tick, *own.emit().values()))
                    own.clear()
                key, tick = tuple(getattr(p, c) for c in flow), p.tick
                own.add(p)
            made.append((*key, tick, *own.emit().values()))
            return pd.DataFrame(made, columns=[*flow, "tick", *own.emit()])

        return packets.select(*flow, "tick", *SEEN).groupBy(*flow).applyInPandas(run, f"{head}, tick long, {state.emits}")

    return batch


def states(names: tuple[str, ...]) -> dict[str, type[State]]:
    """The states of features; one that has none is an error."""
    if none := [n for n in names if get(n).state is None]:
        raise ValueError(f"features without a form for streams: {none}")
    return {n: get(n).state for n in names}


def data_json(values: dict) -> str:
    """A tick's values in JSON, as short as the one that tables give."""
    return json.dumps(values, separators=(",", ":"), ensure_ascii=False)


def get(name: str) -> Feature:
    if name not in _FEATURES:
        raise ValueError(f"no such feature: {name}")
    return _FEATURES[name]


def names() -> set[str]:
    return set(_FEATURES)


def _zero(kind: str) -> Column:
    if kind.startswith("array"):
        return F.expr(f"cast(array() as {kind})")
    return F.lit("" if kind == "string" else False if kind == "boolean" else 0).cast(kind)


def records(found: Feature, packets: DataFrame, flow: list[str]) -> tuple[DataFrame, Column]:
    """(flow, tick, Data, Idle), and what a flow has before all of these.

    ``Data`` are the feature's values of a tick in JSON, ``Idle`` those of the ticks without values after it.
    """
    keys = [*flow, "tick"]
    made = (found.ticks or found.batch)(packets, flow)
    values = [(c, kind) for c, kind in made.dtypes if c not in keys and not c.endswith("_idle")]
    so_far = Window.partitionBy(*flow).orderBy("tick").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = made.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in found.carry})
    kept = lambda c: f"{c}_idle" if f"{c}_idle" in made.columns else c if c in found.carry else None
    own = F.struct(*(F.coalesce(F.col(c), _zero(kind)).alias(c) for c, kind in values))
    idle = F.struct(*(F.coalesce(F.col(kept(c)), _zero(kind)).alias(c) if kept(c) else _zero(kind).alias(c) for c, kind in values))
    none = F.struct(*(_zero(kind).alias(c) for c, kind in values))
    return made.select(*keys, F.to_json(own).alias("Data"), F.to_json(idle).alias("Idle")), F.to_json(none)


@feature("PacketCounters", state=Packets)
def _packets(packets: DataFrame, flow: list[str]) -> DataFrame:
    return features.packet_counters(packets, [*flow, "tick"])


@feature("VideoCounters", state=Video, ticks=features.video_by_tick)
def _video(packets: DataFrame, flow: list[str]) -> DataFrame:
    keys = [*flow, "tick"]
    rows = features.video_segments_tick(packets, flow)
    one = F.struct("seg", *(c for c in rows.columns if c not in (*keys, "seg")))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("s"))
    return listed.select(*keys, F.transform("s", lambda x: x.dropFields("seg")).alias("VideoSegments"))


@feature("TCPState", state=TcpState)
def _tcp(packets: DataFrame, flow: list[str]) -> DataFrame:
    return features.tcp_state(packets, [*flow, "tick"])


@feature("LatencyJitterCounter", state=Latency)
def _latency(packets: DataFrame, flow: list[str]) -> DataFrame:
    return features.latency_jitter(packets, flow, "tick").drop("RTTs")


@feature("ByteCopyCounters", carry=("CopiedBytes",))
def _bytes(packets: DataFrame, flow: list[str]) -> DataFrame:
    return features.byte_copy_tick(packets, flow).withColumn("Data", F.base64("Data"))


@feature("PNGCopyCounters", carry=("CopiedBytes", "Data"))
def _png(packets: DataFrame, flow: list[str]) -> DataFrame:
    """The image of the copied bytes, from the tick on in which there are enough."""
    keys = [*flow, "tick"]
    counted = features.byte_copy_tick(packets, flow).select(*keys, "CopiedBytes")
    image = features.png_copy(packets, flow, layers=0).where("Data is not null").select(*flow, F.base64("Data").alias("Data"))
    return counted.join(image, flow, "left").select(*keys, "CopiedBytes", F.when(F.col("CopiedBytes") >= 400, F.col("Data")).alias("Data"))
