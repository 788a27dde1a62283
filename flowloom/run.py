"""A configuration from source to sink in one call, or as a command.

    python -m flowloom.run --conf conf.json --captures eth0=/captures/eth0 --dns /captures/dns --out /records

Each traffic parser of the configuration takes the capture files of its interface. The records of
all flows go to ``OUT/dump``, a folder a tick, and those of the interfaces to ``OUT/ifstats`` where the
configuration asks for them; appended to what is there or in its place, as the configuration says.
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom import config as c
from flowloom import sinks
from flowloom.operators import packets, registry
from flowloom.plans import batch
from flowloom.sources import pcap
from flowloom.storage import written


def run(spark: SparkSession, config: c.Config, captures: Mapping[str, str], out: str, dns: str | None = None, hwaddr: str | None = None, key: bytes | None = None, seconds: int = 10) -> DataFrame:
    """Runs a configuration over the capture files of its interfaces; returns the dumps (tick, part, json) it wrote.

    ``dns`` names the capture files of DNS answers; without it prefixes alone tell services. The clock
    starts at the first packet's second. Without any packet nothing is written.
    """
    config.validate(registry.names())
    frames = {name: pcap.read_frames(spark, path, include_raw=any(f in s.collect for s in config.services for f in ("ByteCopyCounters", "PNGCopyCounters"))) for name, path in captures.items()}
    messages = pcap.read_dns(spark, dns, answered=True) if dns else None
    rows = written(batch.flow_packets(spark, frames, config, messages, hwaddr, key, start_s=0), "flows")
    start_s = packets.start_second(rows)
    rows = packets.with_tick(rows.drop("tick"), start_s, seconds)
    dumps = written(batch.cache_dump(batch.flow_json(spark, rows, config, start_s, seconds), start_s, seconds), "dumps")
    sinks.write_json_lines(dumps, f"{out}/dump", config.append, by="tick")
    if config.stats_run:
        for name, own in frames.items():
            sinks.write_json_lines(batch.interface_stats(own, start_s, seconds).withColumn("interface", F.lit(name)), f"{out}/ifstats", config.append, by="interface")
    return dumps


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="flowloom.run", description="Runs a configuration over capture files.")
    parser.add_argument("--conf", help="the configuration; else the first file of the search path")
    parser.add_argument("--captures", action="append", required=True, metavar="INTERFACE=FOLDER")
    parser.add_argument("--dns", help="capture files of DNS answers")
    parser.add_argument("--out", help="where records go; else the configuration's folder")
    parser.add_argument("--hwaddr", help="hardware address of the capturing device, where the configuration names none")
    parser.add_argument("--key", help="64 hex digits for the anonymisation that the configuration asks for")
    parser.add_argument("--seconds", type=int, default=10, help="seconds of a tick")
    given = parser.parse_args(arguments)
    config = c.load(given.conf)
    captures = dict(x.split("=", 1) for x in given.captures)
    spark = SparkSession.builder.appName("flowloom").getOrCreate()
    run(spark, config, captures, given.out or config.out_folder, given.dns, given.hwaddr, bytes.fromhex(given.key) if given.key else None, given.seconds)


if __name__ == "__main__":
    main()
