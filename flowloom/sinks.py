"""Sinks: JSON lines, appended or overwritten, in batch or from a stream, a folder for each period."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_json_lines(records: DataFrame, path: str, append: bool = True, column: str = "json", by: str | None = None) -> None:
    """Writes the column as lines, committed as a whole; ``by`` makes a folder of each of its values."""
    out = records.select(column, *([by] if by else [])).write.mode("append" if append else "overwrite")
    (out.partitionBy(by) if by else out).text(path)


def period(ts_s: Column, seconds: int) -> Column:
    """The name of a period: when it starts, so that names sort by time."""
    return F.date_format(F.timestamp_seconds(F.floor(ts_s / seconds) * seconds), "yyyy-MM-dd'T'HH-mm-ss")


def stream_json_lines(records: DataFrame, path: str, checkpoint: str, column: str = "json", seconds: int | None = 10, by: str | None = None) -> StreamingQuery:
    """Appends the column's lines each ``seconds``; without, all that there is and then stops.

    ``by`` makes a folder of each of its values, such as a ``period``. A micro-batch's files count once
    it is committed, so readers see no torn line, and none twice after a restart.
    """
    out = records.select(column, *([by] if by else [])).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    if by:
        out = out.partitionBy(by)
    return (out.trigger(processingTime=f"{seconds} seconds") if seconds else out.trigger(availableNow=True)).start()


@dataclass(frozen=True)
class Collector:
    """Records of a kind, how often they are collected, and how long a period of theirs is."""

    records: DataFrame
    every_s: int | None = 10
    rotate_s: int | None = None
    time_column: str = "ts_s"


def collect(collectors: Mapping[str, Collector], path: str, checkpoint: str) -> dict[str, StreamingQuery]:
    """Starts each collector, at its own pace and with periods of its own, into a folder of its name."""
    if odd := [n for n in collectors if not n or "/" in n]:
        raise ValueError(f"no names of folders: {odd}")
    running = {}
    for name, c in collectors.items():
        rows = c.records.withColumn("period", period(F.col(c.time_column), c.rotate_s)) if c.rotate_s else c.records
        running[name] = stream_json_lines(rows, f"{path}/{name}", f"{checkpoint}/{name}", seconds=c.every_s, by="period" if c.rotate_s else None)
    return running
