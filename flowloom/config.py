"""The JSON configuration that names services, how they are recognised and what is collected.

Durations are integer nanoseconds. ``Features`` is read as another name of
``Collect``. Unknown features, double names and bad prefixes or patterns are errors.
"""

from __future__ import annotations

import ipaddress
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from flowloom.model import SECOND

SEARCH_PATH = ("./flowloom.json", "/etc/flowloom/flowloom.json")


@dataclass(frozen=True)
class Service:
    name: str
    domains: tuple[str, ...] = ()
    regexes: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    collect: tuple[str, ...] = ()
    #: Length of a tick in nanoseconds, where it differs from the default.
    emit_ns: int | None = None


@dataclass(frozen=True)
class Parser:
    driver: str = "pcap"
    ifname: str = "eth0"
    mode: str = "router"
    hwaddr: str | None = None
    localnet: str | None = None
    replay: bool = False


@dataclass(frozen=True)
class Config:
    services: tuple[Service, ...] = ()
    dns_parser: Parser = field(default_factory=Parser)
    traffic_parsers: tuple[Parser, ...] = (Parser(),)
    evict_ns: int = 600 * SECOND
    cleanup_ns: int = 300 * SECOND
    dns_evict_ns: int = 600 * SECOND
    shards: int = 32
    anonymize: bool = True
    stats_run: bool = False
    stats_mode: str = "dump"
    append: bool = True
    out_folder: str = "/tmp/"

    def validate(self, features: set[str] | None = None) -> Config:
        names = [s.name for s in self.services]
        if len(set(names)) < len(names):
            raise ValueError(f"service names must be unique: {names}")
        for s in self.services:
            for p in s.prefixes:
                ipaddress.ip_network(p)
            for r in s.regexes:
                re.compile(r)
            if features is not None and (unknown := set(s.collect) - features):
                raise ValueError(f"{s.name}: no such feature: {sorted(unknown)}")
        if self.stats_mode != "dump":
            raise ValueError(f"no such Stats.Mode: {self.stats_mode}")
        return self


def _parser(x: dict) -> Parser:
    return Parser(x.get("Driver", "pcap"), x.get("Ifname", "eth0"), x.get("Mode", "router"), x.get("ReplayMAC") or x.get("HwAddr"), x.get("LocalNet"), bool(x.get("Replay", False)))


def parse(text: str) -> Config:
    x = json.loads(text)
    cache, stats, parsers = x.get("FlowCache", {}), x.get("Stats", {}), x.get("Parsers", {})
    services = tuple(
        Service(
            s["Name"],
            tuple((f := s.get("Filter", {})).get("DomainsString") or ()),
            tuple(f.get("DomainsRegex") or ()),
            tuple(f.get("Prefixes") or ()),
            tuple(s.get("Collect") or s.get("Features") or ()),
        )
        for s in x.get("Services", ())
    )
    return Config(
        services,
        _parser(parsers.get("DNSParser", {})),
        tuple(map(_parser, parsers.get("TrafficParsers", ({},)))),
        cache.get("EvictTime", Config.evict_ns),
        cache.get("CleanupTime", Config.cleanup_ns),
        x.get("DNSCache", {}).get("EvictTime", Config.dns_evict_ns),
        cache.get("ShardsCount", Config.shards),
        cache.get("Anonymize", True),
        stats.get("Run", False),
        stats.get("Mode", "dump"),
        stats.get("Append", True),
        x.get("Sys", {}).get("OutFolder", "/tmp/"),
    )


def load(path: str | None = None) -> Config:
    """The configuration in ``path``, or in the first file of the search path."""
    for p in (path,) if path else SEARCH_PATH:
        try:
            with open(p) as f:
                return parse(f.read())
        except FileNotFoundError:
            if path:
                raise
    raise FileNotFoundError(f"no configuration in {SEARCH_PATH}")


# The dimension tables. Their sizes are the configuration's, not the data's.


def service_domains(spark: SparkSession, config: Config) -> DataFrame:
    rows = [(i, s.name, j, d) for i, s in enumerate(config.services) for j, d in enumerate(s.domains)]
    return spark.createDataFrame(rows, "service_id int, service string, pos int, pattern string")


def service_prefixes(spark: SparkSession, config: Config) -> DataFrame:
    """Prefixes in order of the configuration; ``net`` holds the bits that addresses must begin with."""
    rows, pos = [], 0
    for i, s in enumerate(config.services):
        for p in s.prefixes:
            net = ipaddress.ip_network(p)
            bits = bin(int(net.network_address))[2:].zfill(net.max_prefixlen)[: net.prefixlen]
            rows.append((i, s.name, pos, p, net.version, net.prefixlen, bits))
            pos += 1
    return spark.createDataFrame(rows, "service_id int, service string, pos int, prefix string, version int, bits_len int, net string")


def service_features(spark: SparkSession, config: Config) -> DataFrame:
    rows = [(i, s.name, j, f) for i, s in enumerate(config.services) for j, f in enumerate(s.collect)]
    return spark.createDataFrame(rows, "service_id int, service string, pos int, feature string")
