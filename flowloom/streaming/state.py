"""The features as state that takes one packet at a time: for streams, and to hold the windows against in tests."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import ClassVar

IN, OUT = 0, 1


@dataclass
class Moments:
    n: int = 0
    avg: float = 0.0
    m2: float = 0.0

    def add(self, x: float) -> None:
        self.n += 1
        delta = x - self.avg
        self.avg += delta / self.n
        self.m2 += delta * (x - self.avg)

    @property
    def var(self) -> float:
        return self.m2 / (self.n - 1) if self.n > 1 else 0.0


@dataclass
class Packets:
    InCounter: int = 0
    OutCounter: int = 0
    InBytes: int = 0
    OutBytes: int = 0

    def add(self, p) -> None:
        if p.dir == IN:
            self.InCounter += 1
            self.InBytes += p.length
        else:
            self.OutCounter += 1
            self.OutBytes += p.length

    def clear(self) -> None:
        self.__init__()

    def values(self) -> dict:
        return dict(vars(self))

    schema: ClassVar[str] = "InCounter long, OutCounter long, InBytes long, OutBytes long"
    emits: ClassVar[str] = schema
    emit = values

    def save(self) -> tuple:
        return tuple(int(x) for x in vars(self).values())

    @classmethod
    def load(cls, saved: tuple) -> Packets:
        return cls(*saved)


_SEGMENT = ("seg", "Len", "Seq", "TsStart", "TsEnd", "LastPkt", "DownPkts", "DonwBytes", "MaxDSeq")


def plain(x) -> tuple:
    """A struct's values, as a state gives them in a row or by name."""
    return tuple(x.values()) if isinstance(x, dict) else tuple(x)


def _fields(names: tuple[str, ...], sep: str) -> str:
    return ", ".join(f"{n}{sep}long" for n in names)


@dataclass
class Video:
    closed: list[dict] = field(default_factory=list)
    running: dict | None = None
    seg: int = 0

    def add(self, p) -> None:
        if p.dir == OUT:
            if p.data_length > (0 if p.is_tcp else 100):
                if self.running and self.running["DownPkts"] > 0:
                    self.closed.append({**self.running, "TsEnd": self.running["LastPkt"]})
                self.seg += 1
                self.running = {"seg": self.seg, "Len": p.length, "Seq": p.seq, "TsStart": p.ts_ns, "TsEnd": 0, "LastPkt": 0, "DownPkts": 0, "DonwBytes": 0, "MaxDSeq": 0}
        elif p.data_length > 0 and self.running:
            r = self.running
            r["DownPkts"] += 1
            r["DonwBytes"] += p.data_length
            r["MaxDSeq"] = max(r["MaxDSeq"], p.seq)
            r["LastPkt"] = p.ts_ns

    def clear(self) -> None:
        self.closed = []

    def values(self) -> list[dict]:
        return [*self.closed, *([dict(self.running)] if self.running else [])]

    schema: ClassVar[str] = f"closed array<struct<{_fields(_SEGMENT, ': ')}>>, running struct<{_fields(_SEGMENT, ': ')}>, seg long"
    emits: ClassVar[str] = f"VideoSegments array<struct<{_fields(_SEGMENT[1:], ': ')}>>"

    def emit(self) -> dict:
        return {"VideoSegments": [{n: int(s[n]) for n in _SEGMENT[1:]} for s in self.values()]}

    def save(self) -> tuple:
        row = lambda s: tuple(int(s[n]) for n in _SEGMENT)
        return [row(s) for s in self.closed], row(self.running) if self.running else None, self.seg

    @classmethod
    def load(cls, saved: tuple) -> Video:
        row = lambda s: dict(zip(_SEGMENT, plain(s), strict=True))
        return cls([row(s) for s in saved[0]], row(saved[1]) if saved[1] is not None else None, saved[2])


@dataclass
class Outstanding:
    """Data sent one way and not yet acknowledged."""

    keys: dict[int, int] = field(default_factory=dict)
    acked: int = 0
    seq: int = 0

    def ack(self, number: int) -> None:
        if number > self.acked:
            self.acked = number
            self.keys = {k: t for k, t in self.keys.items() if k >= number}

    def send(self, seq: int, key: int, ts: int) -> tuple[bool, bool]:
        """Whether the packet is out of order, and whether it repeats one."""
        late, again = seq < self.seq, key in self.keys
        self.seq = max(self.seq, seq)
        self.keys.setdefault(key, ts)
        return late, again

    def save(self) -> tuple:
        return {int(k): int(t) for k, t in self.keys.items()}, int(self.acked), int(self.seq)


@dataclass
class Tcp:
    """``rtts`` of an incoming acknowledgement; ``rows`` is what each packet showed."""

    up: Outstanding = field(default_factory=Outstanding)
    down: Outstanding = field(default_factory=Outstanding)

    def add(self, p) -> dict:
        size = p.length - 4 * p.data_offset
        key = (p.seq + size) % 2**32
        own, other = (self.up, self.down) if p.dir == OUT else (self.down, self.up)
        rtt = None
        if p.f_ack:
            if p.dir == IN and p.ack in other.keys:
                rtt = p.ts_ns - other.keys[p.ack]
            other.ack(p.ack)
        in_flight = (p.seq + size - own.acked) % 2**32
        late = again = False
        if size > 0:
            late, again = own.send(p.seq, key, p.ts_ns)
        return {"in_flight": in_flight, "ooo": late, "retr": again, "rtt": rtt}

    def save(self) -> tuple:
        return self.up.save(), self.down.save()

    @classmethod
    def load(cls, saved: tuple) -> Tcp:
        return cls(*(Outstanding(dict(keys), acked, seq) for keys, acked, seq in map(plain, plain(saved))))


_SENT = "struct<" + ", ".join(f"{way}: struct<keys: map<long, long>, acked: long, seq: long>" for way in ("up", "down")) + ">"
_MOMENTS = "struct<n: long, avg: double, m2: double>"


def _moments(x: Moments) -> tuple:
    return int(x.n), float(x.avg), float(x.m2)


@dataclass
class TcpState:
    """Counts and moments of the TCP feature, whose state starts afresh at each tick."""

    sent: Tcp = field(default_factory=Tcp)
    counts: dict[str, int] = field(default_factory=lambda: {f"{n}{s}Counter": 0 for n in ("Ack", "Syn", "Rst", "Push", "Urg", "Bytes", "Retr", "OOO") for s in ("Up", "Down")})
    moments: dict[str, Moments] = field(default_factory=lambda: {n: Moments() for n in (*(f"{s}{n}" for n in ("RecWindow", "BytesPerPkt", "BytesInFlight") for s in ("Up", "Down")), "RTT")})

    def add(self, p) -> None:
        if not p.is_tcp:
            return
        shown, size = self.sent.add(p), int(p.length - 4 * p.data_offset)
        side = "Up" if p.dir == OUT else "Down"
        for name, here in (("Ack", p.f_ack), ("Syn", p.f_syn), ("Rst", p.f_rst), ("Push", p.f_psh), ("Urg", p.f_urg), ("Retr", shown["retr"]), ("OOO", shown["ooo"])):
            self.counts[f"{name}{side}Counter"] += bool(here)
        self.counts[f"Bytes{side}Counter"] += size
        for name, x in (("RecWindow", p.window), ("BytesPerPkt", size), ("BytesInFlight", shown["in_flight"])):
            self.moments[side + name].add(float(x))
        if shown["rtt"] is not None:
            self.moments["RTT"].add(float(shown["rtt"]))

    def clear(self) -> None:
        self.__init__()

    def values(self) -> dict:
        return self.counts | {f"{n}{m}": getattr(x, m.lower()) for n, x in self.moments.items() for m in ("Avg", "Var")}

    schema: ClassVar[str] = f"sent {_SENT}, counts map<string, long>, moments map<string, {_MOMENTS}>"
    emits: ClassVar[str] = ", ".join([*(f"{n}{s}Counter long" for n in ("Ack", "Syn", "Rst", "Push", "Urg", "Retr", "OOO", "Bytes") for s in ("Up", "Down")), *(f"{s}{n}{m} double" for n in ("RecWindow", "BytesPerPkt", "BytesInFlight") for s in ("Up", "Down") for m in ("Avg", "Var")), "RTTAvg double", "RTTVar double"])

    def emit(self) -> dict:
        found = self.values()
        return {n: found[n] for n in (x.split()[0] for x in self.emits.split(", "))}

    def save(self) -> tuple:
        return self.sent.save(), {n: int(x) for n, x in self.counts.items()}, {n: _moments(x) for n, x in self.moments.items()}

    @classmethod
    def load(cls, saved: tuple) -> TcpState:
        return cls(Tcp.load(saved[0]), dict(saved[1]), {n: Moments(*plain(x)) for n, x in saved[2].items()})


@dataclass
class Latency:
    sent: Tcp = field(default_factory=Tcp)
    last: int = 0
    rtt: Moments = field(default_factory=Moments)
    jitter: Moments = field(default_factory=Moments)

    def add(self, p) -> None:
        if p.is_tcp and (rtt := self.sent.add(p)["rtt"]) is not None:
            self.rtt.add(rtt)
            self.jitter.add(abs(rtt - self.last))
            self.last = rtt

    def clear(self) -> None:
        self.rtt, self.jitter = Moments(), Moments()

    def values(self) -> dict:
        return {"RTTAvg": self.rtt.avg, "RTTVar": self.rtt.var, "JitterAvg": self.jitter.avg, "JitterVar": self.jitter.var}

    schema: ClassVar[str] = f"sent {_SENT}, last long, rtt {_MOMENTS}, jitter {_MOMENTS}"
    emits: ClassVar[str] = "RTTAvg double, RTTVar double, JitterAvg double, JitterVar double"
    emit = values

    def save(self) -> tuple:
        return self.sent.save(), int(self.last), _moments(self.rtt), _moments(self.jitter)

    @classmethod
    def load(cls, saved: tuple) -> Latency:
        return cls(Tcp.load(saved[0]), saved[1], *(Moments(*plain(x)) for x in saved[2:]))
