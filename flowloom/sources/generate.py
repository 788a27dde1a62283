"""Random traces, and lines of a text file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def random_trace(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """``n`` random packets, a millisecond apart."""
    return random_packets(spark.range(n).select("id", (F.col("id") * 1_000_000).alias("ts_ns")), seed)


def random_packets(moments: DataFrame, seed: int = 0) -> DataFrame:
    """A TCP packet at each of ``moments(id, ts_ns)``, with random hardware and IP addresses, ports and direction.

    Each value is drawn by a hash of the seed, the packet and the field, so a trace does
    not depend on its partitions.
    """
    pick = lambda k, low, high: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), F.lit(str(k))).cast("binary")), 1, 12), 16, 10).cast("long") % (high - low) + low
    octet = lambda k: F.concat_ws(".", *(pick(k + i, 1, 255).cast("string") for i in range(4)))
    # The second lowest bit of the first byte marks an address as local, the lowest one as a group's.
    mac = F.concat_ws(":", F.lpad(F.lower(F.hex(pick(9, 0, 64) * 4 + 2)), 2, "0"), *(F.lpad(F.lower(F.hex(pick(10 + i, 0, 256))), 2, "0") for i in range(5)))
    length = pick(20, 20, 1480)
    return moments.select(
        F.col("id").alias("pkt_no"),
        "ts_ns",
        pick(8, 0, 2).cast("int").alias("dir"),
        mac.alias("hw_addr"),
        F.lit(True).alias("is_ipv4"),
        F.lit(True).alias("is_tcp"),
        octet(0).alias("service_ip"),
        octet(4).alias("my_ip"),
        pick(21, 1, 65536).cast("int").alias("service_port"),
        pick(22, 1, 65536).cast("int").alias("my_port"),
        length.alias("length"),
        (length - 20).alias("data_length"),
        pick(23, 0, 1 << 32).alias("seq"),
    )


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file; none if it can't be read."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "value string")
    return spark.read.text(path)
