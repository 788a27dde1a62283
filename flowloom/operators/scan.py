"""Running values of a flow: a window over its packets, in two levels where there are very many.

Flows of up to ``HEAVY`` packets are one window each. The packets of longer ones lie in buckets of time. Each bucket is summed up on its own; the summaries of
a flow, one row a bucket, are folded in order; and within each bucket the running values go on
from what the fold says came before. All kinds of values are associative:

* ``sum`` and ``max`` of what came so far,
* ``last`` and ``first``: the latest and the earliest that is not null.

No window holds more than ``HEAVY`` packets, a bucket's packets, or a flow's buckets, and packets move once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.storage import written

#: Nanoseconds of a bucket.
BUCKET_NS = 10_000_000_000
#: Packets of a flow that are one window. Longer flows are few: a table has at most its rows by this.
HEAVY = 200_000
_ORDER = ("ts_ns", "pkt_no")


@dataclass(frozen=True)
class Running:
    """A value of the packets before each packet, or with ``own`` of those up to it."""

    kind: str
    value: Column
    own: bool = False


def _summary(x: Running) -> Column:
    at = F.when(x.value.isNotNull(), F.struct(*_ORDER))
    return {"sum": F.sum(x.value), "max": F.max(x.value), "last": F.max_by(x.value, at), "first": F.min_by(x.value, at)}[x.kind]


def _over(kind: str, value: Column, window) -> Column:
    return {"sum": F.sum(value), "max": F.max(value), "last": F.last(value, True), "first": F.first(value, True)}[kind].over(window)


def _joined(kind: str, before: Column, here: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before + here, before, here)
    return {"max": F.greatest(before, here), "last": F.coalesce(here, before), "first": F.coalesce(before, here)}[kind]


def by_weight(rows: DataFrame, keys: list[str], made: Callable[[DataFrame, int | None], DataFrame], bucket_ns: int | None = BUCKET_NS, counted: DataFrame | None = None) -> DataFrame:
    """``made(rows, None)`` of the keys with few rows, and ``made(rows, bucket_ns)`` of those with more than ``HEAVY``.

    ``rows`` are written once; which keys are heavy is read from them. ``counted(keys, n)`` says it for rows that a table
    gives at little cost: these are written only where a key is heavy.
    """
    dealt = rows if counted is not None else written(rows, "scan")
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if counted is None else counted
    heavy = written(counts.where(F.col("n") > HEAVY).select(*keys), "heavy")
    if heavy.isEmpty():
        return made(dealt, None)
    dealt = dealt if counted is None else written(rows, "scan")
    few = F.broadcast(heavy)
    return made(dealt.join(few, keys, "left_anti"), None).unionByName(made(dealt.join(few, keys, "left_semi"), bucket_ns))


def weighed(rows: DataFrame, keys: list[str], wanted: dict[str, Running]) -> DataFrame:
    """The same as ``running``: one window for each key with few rows, two levels for the others."""
    if "tick" in keys:
        return running(rows, keys, wanted, None)
    return by_weight(rows, keys, lambda part, bucket_ns: running(part, keys, wanted, bucket_ns))


def running(rows: DataFrame, keys: list[str], wanted: dict[str, Running], bucket_ns: int | None = BUCKET_NS) -> DataFrame:
    """``rows`` with a column for each of ``wanted``, null where nothing came before.

    ``rows`` have ts_ns and pkt_no; they are written once and read twice. Without ``bucket_ns``, or where the keys
    hold the tick and so are short, each key is one window.
    """
    span = lambda x: (Window.unboundedPreceding, Window.currentRow if x.own else -1)
    if bucket_ns is None or "tick" in keys:
        order = Window.partitionBy(*keys).orderBy(*_ORDER)
        return rows.withColumns({n: _over(x.kind, x.value, order.rowsBetween(*span(x))) for n, x in wanted.items()})
    dealt = written(rows.withColumn("__bucket", F.expr(f"ts_ns div {bucket_ns}")), "scan")
    parts = [*keys, "__bucket"]
    sums = dealt.groupBy(*parts).agg(*(_summary(x).alias(f"__{n}") for n, x in wanted.items()))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*parts, *(_over(x.kind, F.col(f"__{n}"), earlier).alias(f"__{n}") for n, x in wanted.items()))
    order = Window.partitionBy(*parts).orderBy(*_ORDER)
    within = dealt.withColumns({f"__own_{n}": _over(x.kind, x.value, order.rowsBetween(*span(x))) for n, x in wanted.items()})
    both = within.join(carry, parts, "left")
    return both.select(*rows.columns, *(_joined(x.kind, F.col(f"__{n}"), F.col(f"__own_{n}")).alias(n) for n, x in wanted.items()))
