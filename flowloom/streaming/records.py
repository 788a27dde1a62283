"""Records of flows from a stream: every live flow at every tick, idle ones too, until its eviction.

A flow's packets wait until the watermark has passed their tick, and then go in order of
(ts_ns, pkt_no) through the features of the flow's service. A timer at the end of each tick
emits the record; the last one is that of the flow's eviction, after which only the number
of the flow's instances is kept, and that for ``FORGET_S`` seconds. The records are those of
``batch.flow_json`` on the same packets, whatever the order in which they came.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from flowloom.config import Config
from flowloom.model import SECOND
from flowloom.operators import registry
from flowloom.operators.packets import with_flow_id
from flowloom.streaming.lookup import event_time, passed_ns, timer_ms

#: Seconds after its last packet in which a flow that comes again gets the next instance's number.
FORGET_S = 86_400
_ABOUT = ("service_ip", "my_ip", "my_port", "service_port")
_PACKET = "ts_ns long, pkt_no long, dir int, is_tcp boolean, length long, data_length long, seq long, ack long, data_offset int, window int, f_syn boolean, f_rst boolean, f_psh boolean, f_ack boolean, f_urg boolean, service_id int, service string, service_ip string, my_ip string, my_port int, service_port int"
_NAMES = [x.split()[0] for x in _PACKET.split(", ")]
#: ``about`` is the first packet's end of the record; ``service_id`` null: no live instance.
_LIFE = "instance long, last_ns long, service_id int, next_tick long, about string"
RECORD = "flow_id string, instance long, tick long, json string"


class Flows(StatefulProcessor):
    def __init__(self, config: Config, seconds: int, start_s: int):
        self.collect = {i: registry.states(s.collect) for i, s in enumerate(config.services)}
        self.states = {n: f for own in self.collect.values() for n, f in own.items()}
        self.evict_ns, self.tick_ns, self.start_ns = config.evict_ns, seconds * SECOND, start_s * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _PACKET)
        self.life = handle.getValueState("life", _LIFE)
        self.saved = {n: handle.getValueState(f"feature_{n}", f.schema) for n, f in self.states.items()}
        self.due = handle.getValueState("due", "at long")

    def _tick(self, ts_ns: int) -> int:
        return (ts_ns - self.start_ns) // self.tick_ns

    def _wake(self, tick: int) -> None:
        """Looks again when the watermark has passed a tick."""
        at, known = timer_ms(self.start_ns + (tick + 1) * self.tick_ns), self.due.get()
        if known is not None and known[0] <= at:
            return
        if known is not None:
            self.handle.deleteTimer(known[0])
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came = [tuple(r[n] for n in _NAMES) for r in rows if r["pkt_no"] is not None]
        if came:
            self.waiting.appendList(came)
            self._wake(self._tick(min(p[0] for p in came)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = self._tick(passed_ns(timerValues))  # ticks before this one are whole
        self.due.clear()
        life = self.life.get()
        instance, last, service, tick, about = life if life is not None else (0, None, None, None, None)
        features = {}
        if service is not None:
            for n, f in self.collect[service].items():
                found = self.saved[n].get()
                features[n] = f.load(tuple(found)) if found is not None else f()
        ready, rest = [], []
        for p in self.waiting.get():
            (ready if self._tick(p[0]) < passed else rest).append(tuple(p))

        def record(at: int) -> Row:
            counters = sorted((n, f'{{"CType":{json.dumps(n)},"Data":{registry.data_json(f.emit())}}}') for n, f in features.items())
            for f in features.values():
                f.clear()
            return Row(flow_id=key[0], instance=instance, tick=at, json=f'{about},"Cntrs":[{",".join(c for _, c in counters)}]}}')

        packet = Row(*_NAMES)
        for values in sorted(ready, key=lambda p: p[:2]):
            p = packet(*values)
            if last is not None and p.ts_ns - last > self.evict_ns:
                if service is not None:
                    for at in range(tick, self._tick(last + self.evict_ns) + 1):
                        yield record(at)
                instance, service, features = instance + 1, None, {}
            last = p.ts_ns
            if service is None:
                if p.service_id is None:
                    continue
                service, tick = p.service_id, self._tick(p.ts_ns)
                features = {n: f() for n, f in self.collect[service].items()}
                head = {"Id": key[0], "Service": p.service, "DomainName": "", "ServiceIP": p.service_ip, "LocalIP": p.my_ip, "Protocol": "TCP" if p.is_tcp else "UDP", "LocalPort": str(p.my_port), "ServicePort": str(p.service_port)}
                about = registry.data_json(head)[:-1]
            for at in range(tick, self._tick(p.ts_ns)):
                yield record(at)
            tick = self._tick(p.ts_ns)
            for f in features.values():
                f.add(p)
        if service is not None:
            until = self._tick(last + self.evict_ns)
            for at in range(tick, min(until + 1, passed)):
                yield record(at)
            tick = max(tick, min(until + 1, passed))
            if tick > until:
                service, features = None, {}
        forgotten = last is None or (service is None and not rest and self._tick(last + FORGET_S * SECOND) < passed)
        if forgotten:
            self.life.clear()
        else:
            self.life.update((instance, last, service, tick, about if service is not None else None))
        for n, state in self.saved.items():
            state.update(features[n].save()) if n in features else state.clear()
        self.waiting.put(rest) if rest else self.waiting.clear()
        if rest or not forgotten:
            after = [self._tick(min(p[0] for p in rest))] if rest else []
            self._wake(min([*after, tick if service is not None else self._tick(last + FORGET_S * SECOND)]))

    def close(self) -> None:
        pass


def records(classified: DataFrame, clock: DataFrame, config: Config, seconds: int = 10, start_s: int = 0, late: str = "30 seconds") -> DataFrame:
    """(flow_id, instance, tick, json) of a stream of packets with ``service_id`` and ``service``.

    ``clock(ts_ns)`` goes on where no packets come. Packets that come more than ``late`` behind the
    latest are dropped, and counted among the query's rows dropped by the watermark.
    """
    rows = with_flow_id(classified).select("flow_id", *_NAMES)
    ticks = clock.select(F.lit("").alias("flow_id"), *(F.col("ts_ns") if n == "ts_ns" else F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in _NAMES))
    timed = event_time(rows.union(ticks)).withWatermark("ts", late)
    return timed.groupBy("flow_id").transformWithState(Flows(config, seconds, start_s), RECORD, "append", "EventTime")
