"""Request-rate audit over tumbling and rolling windows, for tables and streams alike."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rawharbor.functions.nulls import column
from rawharbor.session import prepare_python


def rate_audit(
    requests: DataFrame,
    ts: str,
    limit: int,
    every: str = "1 second",
    by: Sequence[str] = (),
    late: str | None = None,
) -> DataFrame:
    """Windows holding more requests than the limit.

    Counts combine before the shuffle. On a stream the watermark bounds the state
    to one counter per open window and drops what comes later than ``late``, which must
    therefore be said; Spark reports the number as ``numRowsDroppedByWatermark``.
    """
    kind = requests.schema[ts].dataType
    rows = requests
    if requests.isStreaming:
        if late is None:
            raise ValueError("a stream needs to be told how late rows may come")
        # A watermark needs an instant; the result is turned back into the given type.
        rows = requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    counted = rows.groupBy(F.window(ts, every), *by).agg(F.count(F.lit(1)).alias("requests"))
    start = F.col("window.start").cast(kind).alias("window_start")
    return counted.where(F.col("requests") > limit).select(start, *by, "requests")


# A rolling count needs the rows just before; time is cut into blocks of so many windows.
WINDOWS_PER_BLOCK = 64


def _in_blocks(requests: DataFrame, ts: str, within: int, by: Sequence[str]) -> DataFrame:
    """``by, _block, _at, _own``: each row in its block of time, and once more in the next one
    (not as its own) if a window of that block reaches back to it."""
    width = within * WINDOWS_PER_BLOCK
    at = F.unix_micros(column(ts).cast("timestamp"))
    rows = requests.where(column(ts).isNotNull()).withColumn("_at", at)
    block = F.floor(F.col("_at") / F.lit(width)).cast("bigint")
    reached = F.col("_at") > (block + 1) * width - within
    blocks = F.when(reached, F.array(block, block + 1)).otherwise(F.array(block))
    own = F.floor(F.col("_at") / F.lit(width)).cast("bigint") == F.col("_block")
    return rows.withColumn("_block", F.explode(blocks)).withColumn("_own", own)


def _instant(micros: Column, kind: T.DataType) -> Column:
    return F.timestamp_micros(micros).cast(kind)


def rolling_rate(requests: DataFrame, ts: str, limit: int, within: int = 1_000_000, by: Sequence[str] = ()) -> DataFrame:
    """Instants by which more requests than the limit came within the ``within`` microseconds
    up to them, whatever clock seconds those lie in: ``ts, by..., requests``.

    Requests of the same instant are counted before the shuffle. Time is cut into blocks, so
    that neither a busy key nor a table without one is a single window; the end of a
    block is given to the next one as well. Rows without a time are not counted.
    """
    counted = _in_blocks(requests, ts, within, by).groupBy(*by, "_block", "_at", "_own").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by, "_block").orderBy("_at").rangeBetween(1 - within, 0)
    rolled = counted.withColumn("requests", F.sum("_n").over(before))
    kind = requests.schema[ts].dataType
    return rolled.where(F.col("_own") & (F.col("requests") > limit)).select(_instant(F.col("_at"), kind).alias(ts), *by, "requests")


class _Rolling(StatefulProcessor):
    """Counts per instant of one block; when the watermark has passed the block, its answer."""

    def __init__(self, by: Sequence[str], limit: int, within: int):
        self.by, self.limit, self.within = list(by), limit, within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "at bigint, own boolean", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            at, own = frame.iloc[:, -3], frame.iloc[:, -1]  # names that begin with "_" do not come through
            for (at, own), n in frame.groupby([at.to_numpy(), own.to_numpy()]).size().items():
                place = (int(at), bool(own))
                known = self.counts.getValue(place)[0] if self.counts.containsKey(place) else 0
                self.counts.updateValue(place, (known + int(n),))
        end = (int(key[-1]) + 1) * self.within * WINDOWS_PER_BLOCK // 1000 + 1
        self.handle.registerTimer(end)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = sorted((at, own, n[0]) for (at, own), n in self.counts.iterator())
        at, own, n = (np.array(c) for c in zip(*found))
        sums = np.concatenate([[0], np.cumsum(n)])
        first = np.searchsorted(at, at - self.within, side="right")
        last = np.searchsorted(at, at, side="right")
        totals = sums[last] - sums[first]
        flagged = own.astype(bool) & (totals > self.limit)
        self.counts.clear()
        out = pd.DataFrame({"_at": at[flagged], "requests": totals[flagged]})
        for i, name in enumerate(self.by):
            out[name] = key[i]
        yield out[["_at", *self.by, "requests"]]

    def close(self) -> None:
        pass


def rolling_rate_stream(
    requests: DataFrame, ts: str, limit: int, late: str, within: int = 1_000_000, by: Sequence[str] = ()
) -> DataFrame:
    """:func:`rolling_rate` of a stream. State is one counter per instant of the blocks that the
    watermark has not passed; a timer at a block's end gives its answer and clears it.
    Requests that come later than ``late`` are not counted. Needs the RocksDB state store."""
    prepare_python(requests.sparkSession)
    schema, kind = requests.schema, requests.schema[ts].dataType
    timed = requests.withColumn(ts, column(ts).cast("timestamp")).withWatermark(ts, late)
    fields = [T.StructField("_at", T.LongType()), *[schema[c] for c in by], T.StructField("requests", T.LongType())]
    rolled = (
        _in_blocks(timed, ts, within, by)
        .groupBy(*by, "_block")
        .transformWithStateInPandas(_Rolling(by, limit, within), T.StructType(fields), "Append", "EventTime")
    )
    return rolled.select(_instant(F.col("_at"), kind).alias(ts), *by, "requests")
