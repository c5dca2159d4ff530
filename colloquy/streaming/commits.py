"""Structured Streaming measures of a live display log: ``token, ts, tier, text``, ts a ``timestamp``.

State is keyed by token in the RocksDB store and goes when the watermark has passed a token's last row by ``keep``. Rows
behind the watermark never arrive; rows that are older than what their token has seen are counted as late and change
nothing. Results go to Parquet, so a query that is started again on its checkpoint goes on where it stopped.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windows(log: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Revisions per tumbling or sliding window and tier."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return log.withWatermark("ts", late).groupBy(w, "tier").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "tier", "n")


def sessions(log: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Bursts of revisions of a token, closed by a pause."""
    return log.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "token").agg(F.count("*").alias("n")).select("token", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _ms(pdf: pd.DataFrame) -> list[int]:
    return (pdf["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist()


class _Keyed(StatefulProcessor):
    """Rows of a token in event order; a timer clears its state ``keep_ms`` after the last of them."""

    schema = ""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", self.schema)

    def _rows(self, rows) -> pd.DataFrame:
        return pd.concat(list(rows)).sort_values(["ts", "tier", "text"], kind="stable", na_position="first")

    def _put(self, seen: int, *values) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(seen + self.keep_ms)
        self.state.update((seen, *values))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


class _Changes(_Keyed):
    schema = "seen long, text string, tier string"

    def __init__(self, keep_ms: int, trailing_ms: int):
        super().__init__(keep_ms)
        self.trailing_ms = trailing_ms

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        seen, text, tier = self.state.get() if self.state.exists() else (None, None, None)
        pdf = self._rows(rows)
        out: dict[str, list[int]] = {}
        for at, new, now in zip(_ms(pdf), pdf["text"].tolist(), pdf["tier"].tolist(), strict=True):
            cell = out.setdefault(now if seen is None or at < seen else tier, [0, 0, 0, 0, 0])
            if seen is not None and at < seen:
                cell[4] += 1
                continue
            if seen is not None:
                near = at - seen <= self.trailing_ms
                for k, x in enumerate((True, new != text, new != text and near, new != text and near and len((new or "").split()) == 1)):
                    cell[k] += int(x)
            seen, text, tier = at, new, now
        self._put(seen, text, tier)
        yield pd.DataFrame([(key[0], t, *c) for t, c in out.items() if any(c)], columns=["token", "tier", "n", "changed", "trailing", "single", "late"])


def changes(log: DataFrame, trailing: int = 60, late: str = "1 hour", keep: int = 86_400 * 365) -> DataFrame:
    """``token, tier, n, changed, trailing, single, late`` as updates, to be summed: revisions of a token since its last (by
    the last one's tier), those whose text differed, of these the ones within ``trailing`` seconds and the single words of
    these; and rows that came late. ``keep``: seconds that a token's state outlives the watermark."""
    schema = "token long, tier string, n long, changed long, trailing long, single long, late long"
    keyed = log.withWatermark("ts", late).groupBy("token")
    return keyed.transformWithStateInPandas(_Changes(keep * 1000, trailing * 1000), schema, "Append", "EventTime")


class _Pauses(_Keyed):
    schema = "seen long, waiting array<long>"

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        seen, waiting = self.state.get() if self.state.exists() else (-(2**62), [])
        waiting = list(waiting)
        pdf = self._rows(rows)
        out = []
        for at, tier in zip(_ms(pdf), pdf["tier"].tolist(), strict=True):
            if tier == "committed":
                out += [(key[0], t, at) for t in waiting if t <= at]
                waiting = [t for t in waiting if t > at]
            else:
                waiting.append(at)
            seen = max(seen, at)
        self._put(seen, waiting)
        yield pd.DataFrame(out, columns=["token", "pause_ms", "commit_ms"])


def pauses(log: DataFrame, late: str = "1 hour", keep: int = 86_400 * 365) -> DataFrame:
    """``token, pause_ms, commit_ms``: each provisional row with the first committed one of its token at or after it, when that comes."""
    keyed = log.withWatermark("ts", late).groupBy("token")
    return keyed.transformWithStateInPandas(_Pauses(keep * 1000), "token long, pause_ms long, commit_ms long", "Append", "EventTime")


class _Dropped(_Keyed):
    schema = "seen long, final boolean, shown boolean"

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        seen, final, shown = self.state.get() if self.state.exists() else (-(2**62), False, False)
        pdf = self._rows(rows)
        was = final and not shown
        tiers = set(pdf["tier"])
        final, shown = final or "final" in tiers, shown or "shown" in tiers
        self._put(max(seen, *_ms(pdf)), final, shown)
        delta = int(final and not shown) - int(was)
        yield pd.DataFrame([(key[0], delta)] if delta else [], columns=["token", "delta"])


def dropped_changes(events: DataFrame, late: str = "1 hour", keep: int = 86_400 * 365) -> DataFrame:
    """``token, delta`` of events whose tier is ``final`` or ``shown``: 1 when a finalised word is missing on the display,
    -1 when it comes after all. The sum of a token's deltas says whether it was dropped."""
    keyed = events.withWatermark("ts", late).groupBy("token")
    return keyed.transformWithStateInPandas(_Dropped(keep * 1000), "token long, delta int", "Append", "EventTime")


def dropped(finalised: DataFrame, displayed: DataFrame, key: str = "token") -> DataFrame:
    """Finalised words that were never shown, of tables."""
    return finalised.join(displayed.select(key).distinct(), key, "left_anti")


def run_once(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Takes what there is (``availableNow``) into Parquet under ``path``, which also has the checkpoint, and returns the table.

    Append mode adds rows at every start; complete mode replaces the table at every trigger.
    """
    spark, table = stream.sparkSession, f"{path}/table"
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True)
        if mode == "complete":
            writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(table))
        else:
            writer = writer.format("parquet").option("path", table)
        writer.start().awaitTermination()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
    return spark.read.schema(stream.schema).parquet(table)
