"""Which service an address belongs to: by DNS answers, in time, and by prefixes.

Dimension tables come from the configuration. A pattern or prefix of an earlier
service wins; domain substrings win over all regular expressions.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.config import Config, service_domains, service_features, service_prefixes
from flowloom.functions.net import ip_bits
from flowloom.functions.patterns import with_found
from flowloom.model import SECOND
from flowloom.operators.scan import BUCKET_NS

#: Rows of the configuration that are broadcast; larger tables are joined by a shuffle where the join has a key.
BROADCAST = 100_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST else df


def dns_names(messages: DataFrame) -> DataFrame:
    """(dns_no, ts_ns, name, ip, ttl): the first question and the first answer with an address."""
    first = F.get(F.filter("answers", lambda a: a["ip"].isNotNull()), F.lit(0))
    rows = messages.select("dns_no", "ts_ns", F.get("questions", F.lit(0))["name"].alias("name"), first["ip"].alias("ip"), first["ttl"].alias("ttl"))
    return rows.where("ip is not null and name is not null")


def name_matches(spark: SparkSession, names: DataFrame, config: Config) -> DataFrame:
    """(name, kind, pos, service_id, service, pattern) of all patterns found in each distinct name.

    ``kind`` is 0 for substrings and 1 for regular expressions; ``pos`` is the
    pattern's place in the configuration.
    """
    distinct = names.select("name").distinct()
    domains = [(i, s.name, j, d) for i, s in enumerate(config.services) for j, d in enumerate(s.domains)]
    table = service_domains(spark, config).withColumn("number", F.col("pos") + F.element_at(F.lit(_starts(config)), F.col("service_id") + 1))
    hit = with_found(distinct, "name", [d for *_, d in domains]).withColumnRenamed("text", "name")
    found = hit.join(_small(table, len(domains)), "number").select("name", F.lit(0).alias("kind"), "service_id", "service", "pos", "pattern")
    regexes = [(i, s.name, j, r) for i, s in enumerate(config.services) for j, r in enumerate(s.regexes)]
    if regexes:
        each = F.array(*(F.struct(F.lit(i).alias("service_id"), F.lit(n).alias("service"), F.lit(j).alias("pos"), F.lit(r).alias("pattern")) for i, n, j, r in regexes))
        matching = distinct.withColumn("r", F.explode(F.filter(each, lambda x: F.regexp_like(F.col("name"), x["pattern"]))))
        found = found.unionByName(matching.select("name", F.lit(1).alias("kind"), "r.*"))
    return found


def _starts(config: Config) -> list[int]:
    """How many substrings the services before each one have."""
    out, n = [], 0
    for s in config.services:
        out.append(n)
        n += len(s.domains)
    return out


def dns_first_match(spark: SparkSession, messages: DataFrame, config: Config) -> DataFrame:
    """(dns_no, ts_ns, ip, ttl, service_id, service, pattern): the first pattern found in the question."""
    names = dns_names(messages)
    rank = F.struct("kind", "service_id", "pos")
    best = name_matches(spark, names, config).groupBy("name").agg(F.min_by(F.struct("service_id", "service", "pattern"), rank).alias("best"))
    return names.join(best, "name").select("dns_no", "ts_ns", "ip", "ttl", "best.*")


def dns_all_matches(spark: SparkSession, messages: DataFrame, config: Config) -> DataFrame:
    """Every service with a substring in the question, and the first whose expression matches."""
    names = dns_names(messages)
    found = name_matches(spark, names, config)
    domains = found.where("kind = 0").select("name", "kind", "service_id", "service").distinct()
    regex = found.where("kind = 1").groupBy("name").agg(F.min_by(F.struct("kind", "service_id", "service"), F.struct("service_id", "pos")).alias("r")).select("name", "r.*")
    return names.join(domains.unionByName(regex), "name").select("dns_no", "ip", "kind", "service_id", "service")


def dns_bindings(first: DataFrame, evict_ns: int) -> DataFrame:
    """Matches as intervals in which they are an address's latest binding.

    [bound_at, until): until the next binding of the address; ``expires_s`` is the
    last second in which it holds. A time to live of 0 holds until the cache drops it.
    """
    order = Window.partitionBy("ip").orderBy("ts_ns", "dns_no")
    rows = first.withColumn("until", F.coalesce(F.lead("ts_ns").over(order), F.lit(2**63 - 1)))
    second = F.expr(f"ts_ns div {SECOND}")
    expires = F.when(F.col("ttl") == 0, second + evict_ns // SECOND).otherwise(second + F.col("ttl"))
    return rows.where("until > ts_ns").select("ip", F.col("ts_ns").alias("bound_at"), "until", expires.alias("expires_s"), "service_id", "service")


def _by_address(rows: DataFrame, ip: str, bindings: DataFrame | None, prefixes: DataFrame | None) -> DataFrame:
    """``rows`` with ``__b``, the address's latest binding, and ``__p``, what ``prefixes`` hold of it; null where there is none.

    Rows and bindings are dealt by address and bucket of time, and merged in order there; what held before a bucket
    is found on the buckets alone, and comes first in it. So rows move once, an address that most rows have is many tasks, and
    the work is linear in both.
    """
    bucket = lambda c: F.expr(f"{c} div {BUCKET_NS}").alias("__bucket")
    place = ["__ip", "__bucket"]
    marks = rows.select(F.col(ip).alias("__ip"), bucket("ts_ns")).where("__ip is not null").distinct()
    both = rows.select(*rows.columns, F.col(ip).alias("__ip"), bucket("ts_ns"), F.col("ts_ns").alias("__at"), F.lit(True).alias("__row"))
    before = marks
    if bindings is not None:
        bound = bindings.select(F.col("ip").alias("__ip"), bucket("bound_at"), F.struct("bound_at", "expires_s", "service_id", "service").alias("__b"))
        latest = marks.unionByName(bound, allowMissingColumns=True).groupBy(*place).agg(F.max("__b").alias("__b"))
        earlier = Window.partitionBy("__ip").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        before = latest.select(*place, F.last("__b", True).over(earlier).alias("__b"))
        both = both.unionByName(bound.withColumns({"__at": F.col("__b.bound_at"), "__row": F.lit(False)}), allowMissingColumns=True)
    if prefixes is not None:
        before = before.join(prefixes.select(F.col("ip").alias("__ip"), F.struct("service_id", "service").alias("__p")), "__ip", "left")
    first = before.withColumns({"__at": F.lit(-(2**63)), "__row": F.lit(False)})
    order = Window.partitionBy(*place).orderBy("__at", "__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = [c for c, x in (("__b", bindings), ("__p", prefixes)) if x is not None]
    merged = both.unionByName(first, allowMissingColumns=True)
    return merged.withColumns({c: F.last(c, True).over(order) for c in found}).where("__row").select(*rows.columns, *found)


def _held(field: str) -> Column:
    """A field of the latest binding, if that has not expired."""
    return F.when(F.expr(f"ts_ns div {SECOND}") <= F.col("__b.expires_s"), F.col(f"__b.{field}"))


def asof_binding(rows: DataFrame, bindings: DataFrame, ip: str = "service_ip") -> DataFrame:
    """``rows`` with the service of the address's latest binding at ``ts_ns``, if that has not expired.

    A binding at a packet's own time comes before it.
    """
    return _by_address(rows, ip, bindings, None).select(*rows.columns, _held("service_id").alias("dns_service_id"), _held("service").alias("dns_service"))


def cidr_matches(spark: SparkSession, ips: DataFrame, config: Config, ip: str = "ip") -> DataFrame:
    """(ip, pos, service_id, service, prefix) for each distinct address and prefix that holds it.

    An equi-join on (length, leading bits), one probe a distinct prefix length.
    """
    prefixes = service_prefixes(spark, config)
    nets = [ipaddress.ip_network(p) for s in config.services for p in s.prefixes]
    lengths = sorted({(n.version, n.prefixlen) for n in nets})
    rows = sum(len(s.prefixes) for s in config.services)
    bits = ips.select(F.col(ip).alias("ip")).distinct().withColumn("bits", ip_bits(F.col("ip"))).where("bits is not null")
    version = F.when(F.length("bits") == 32, 4).otherwise(6)
    probes = F.array(*(F.struct(F.lit(v).alias("version"), F.lit(n).alias("bits_len")) for v, n in lengths)) if lengths else F.expr("cast(array() as array<struct<version:int,bits_len:int>>)")
    asked = bits.select("ip", "bits", version.alias("v"), F.explode(probes).alias("p")).where("v = p.version").select("ip", "p.version", "p.bits_len", F.expr("substring(bits, 1, p.bits_len)").alias("net"))
    return asked.join(_small(prefixes, rows), ["version", "bits_len", "net"]).select("ip", "pos", "service_id", "service", "prefix")


def cidr_first_match(spark: SparkSession, ips: DataFrame, config: Config, ip: str = "ip") -> DataFrame:
    """(ip, service_id, service, prefix) of the first prefix in the configuration's order."""
    best = F.min_by(F.struct("service_id", "service", "prefix"), "pos").alias("best")
    return cidr_matches(spark, ips, config, ip).groupBy("ip").agg(best).select("ip", "best.*")


def with_service(spark: SparkSession, packets: DataFrame, config: Config, messages: DataFrame | None = None) -> DataFrame:
    """Packets with ``service_id`` and ``service`` of their remote end at their time; null if unknown."""
    by_prefix = cidr_first_match(spark, packets, config, "service_ip").select("ip", "service_id", "service")
    bindings = None if messages is None else dns_bindings(dns_first_match(spark, messages, config), config.dns_evict_ns)
    rows = _by_address(packets, "service_ip", bindings, by_prefix)
    if messages is None:
        return rows.select(*packets.columns, F.col("__p.service_id").alias("service_id"), F.col("__p.service").alias("service"))
    service = F.when(_held("service_id").isNotNull(), _held("service")).otherwise(F.col("__p.service"))
    return rows.select(*packets.columns, F.coalesce(_held("service_id"), F.col("__p.service_id")).alias("service_id"), service.alias("service"))


def known_service_only(packets: DataFrame) -> DataFrame:
    return packets.where("service_id is not null")


def collecting(spark: SparkSession, packets: DataFrame, config: Config, feature: str) -> DataFrame:
    """Packets of flows whose service collects a feature."""
    wanted = service_features(spark, config).where(F.col("feature") == feature).select("service_id").distinct()
    return packets.join(F.broadcast(wanted), "service_id", "left_semi")
