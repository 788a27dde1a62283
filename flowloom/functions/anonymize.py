"""Prefix-preserving address anonymisation (Crypto-PAn) in native expressions.

Bit i of the result is bit i of the address, flipped by the first bit of AES-128
over the first i bits of the address followed by the pad's other bits. Addresses
that agree on a prefix agree on it afterwards. The key has 32 bytes: the cipher's
16 and the 16 that the pad is made from.

``ip`` enciphers an address on its own, 32 or 128 times, for streams; ``apply`` enciphers each
distinct prefix of a table's addresses once, whatever the number of addresses that begin with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.net import ip4_num, ip4_string, ip6_hex, ip_bits
from flowloom.storage import written


class Anonymizer:
    def __init__(self, spark: SparkSession, key: bytes):
        if len(key) != 32:
            raise ValueError(f"the key needs 32 bytes and has {len(key)}")
        self._key = F.lit(bytes(key[:16]))
        pad = spark.range(1).select(F.hex(self._cipher(F.lit(bytes(key[16:]))))).first()[0]
        self._pad = f"{int(pad, 16):0128b}"
        self._high, self._low = (int(pad[i : i + 16], 16) - (1 << 64 if int(pad[i], 16) > 7 else 0) for i in (0, 16))

    def _cipher(self, block: Column) -> Column:
        return F.substring(F.aes_encrypt(block, self._key, F.lit("ECB"), F.lit("PKCS")), 1, 16)

    def _flips(self, high: Column, low: Column, first: int, n: int) -> Column:
        """The n flip bits from bit ``first`` on, as one number."""
        pad_high, pad_low = F.lit(self._high), F.lit(self._low)
        half = lambda x, pad, keep: x.bitwiseAND(keep).bitwiseOR(pad.bitwiseAND(F.bitwise_not(keep)))

        def bit(acc: Column, i: Column) -> Column:
            # Masks of the first i bits; shifts by 64 would wrap.
            mask = lambda k: F.when(k <= 0, F.lit(0)).when(k >= 64, F.lit(-1)).otherwise(F.call_function("shiftleft", F.lit(-1).cast("long"), (F.lit(64) - k).cast("int"))).cast("long")
            block = F.concat(F.lpad(F.hex(half(high, pad_high, mask(i))), 16, "0"), F.lpad(F.hex(half(low, pad_low, mask(i - 64))), 16, "0"))
            top = F.hex(F.substring(self._cipher(F.unhex(block)), 1, 1))
            return F.call_function("shiftleft", acc, F.lit(1)).bitwiseOR((top >= "80").cast("long"))

        return F.aggregate(F.sequence(F.lit(first), F.lit(first + n - 1)), F.lit(0).cast("long"), bit)

    def ip4(self, ip: Column) -> Column:
        num = ip4_num(ip)
        flips = self._flips(F.call_function("shiftleft", num, F.lit(32)), F.lit(0).cast("long"), 0, 32)
        return F.when(num.isNotNull(), ip4_string(num.bitwiseXOR(flips)))

    def ip6(self, ip: Column) -> Column:
        """As eight groups without leading zeros."""
        digits = ip6_hex(ip)
        signed = lambda h: F.conv(h, 16, -10).cast("long")
        high, low = signed(F.substring(digits, 1, 16)), signed(F.substring(digits, 17, 16))
        out = F.concat(*(F.lpad(F.hex(x.bitwiseXOR(self._flips(high, low, at, 64))), 16, "0") for x, at in ((high, 0), (low, 64))))
        groups = F.transform(F.sequence(F.lit(1), F.lit(29), F.lit(4)), lambda i: F.lower(F.regexp_replace(F.substr(out, i, F.lit(4)), "^0{1,3}", "")))
        return F.when(digits.isNotNull(), F.array_join(groups, ":"))

    def ip(self, ip: Column) -> Column:
        return F.coalesce(self.ip4(ip), self.ip6(ip))

    def _flip(self, prefix: Column) -> Column:
        """The flip of the bit behind a prefix (a string of bits), as a digit."""
        block = F.concat(prefix, F.substr(F.lit(self._pad), F.length(prefix) + 1))
        half = lambda at: F.lpad(F.conv(F.substring(block, at, 64), 2, 16), 16, "0")
        return F.when(F.hex(F.substring(self._cipher(F.unhex(F.concat(half(1), half(65)))), 1, 1)) >= "80", "1").otherwise("0")

    def apply(self, rows: DataFrame, column: str) -> DataFrame:
        """``rows`` with the column anonymised; what is no address stays.

        Each distinct prefix is enciphered once and its flip joined back to the addresses. A short
        prefix that all have is a skewed key of that join, which AQE splits.
        """
        bits = written(rows.select(F.col(column).alias("__plain")).distinct().withColumn("bits", ip_bits(F.col("__plain"))).where("bits is not null"), "addresses")
        each = bits.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("bits") - 1))).withColumn("prefix", F.expr("substring(bits, 1, at)"))
        flips = each.select("prefix").distinct().withColumn("flip", self._flip(F.col("prefix")))
        flipped = F.when(F.expr("substring(bits, at + 1, 1)") == F.col("flip"), "0").otherwise("1")
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", flipped.alias("bit")))), lambda x: x["bit"]), "")
        done = each.join(flips, "prefix").groupBy("__plain").agg(listed.alias("out"))
        part = lambda at, n, base: F.lower(F.conv(F.substring("out", at, n), 2, base))
        four = F.concat_ws(".", *(part(1 + 8 * i, 8, 10) for i in range(4)))
        six = F.concat_ws(":", *(part(1 + 16 * i, 16, 16) for i in range(8)))
        known = done.select("__plain", F.when(F.length("out") == 32, four).otherwise(six).alias("__anonymous"))
        joined = rows.join(known, F.col(column) == F.col("__plain"), "left")
        return joined.withColumn(column, F.coalesce("__anonymous", column)).select(*rows.columns)
