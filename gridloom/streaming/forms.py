"""Streaming forms that share the batch code: blocks, trailing windows, first sightings, carried values, daily sweeps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_blocks(events: DataFrame, ts: str, keys: Sequence[str], value: str, late: str = "7 days") -> DataFrame:
    """Count and mean of each day; a day is final once the watermark is past it, later rows are dropped."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, "1 day").alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), *keys, "n", "mean")


def trailing_windows(events: DataFrame, ts: str, keys: Sequence[str], value: str, days: int = 8, late: str = "7 days") -> DataFrame:
    """Count and mean of each key over every window of `days` days, one window for each day."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    grouped = rows.groupBy(F.window(ts, f"{days} days", "1 day").alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return grouped.select(F.col("w.start").alias("start"), F.date_sub(F.to_date("w.end"), 1).alias("prediction_day"), *keys, "n", "mean")


def sessions(events: DataFrame, ts: str, keys: Sequence[str], gap: str, late: str = "7 days") -> DataFrame:
    """First time and number of rows of each key's bursts; a burst ends where nothing follows for `gap`, and is final once the watermark is past that."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("first_ts"), "n")


def first_sightings(events: DataFrame, ts: str, keys: Sequence[str], late: str = "7 days") -> DataFrame:
    """Each item once; items come back once the watermark has let their state go."""
    if not events.isStreaming:
        return events.dropDuplicates(list(keys))
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def carried_values(events: DataFrame, ts: str, key: str, value: str, late: str = "7 days") -> DataFrame:
    """(key, ts, filled, age_s): the last valid value of a key and its age in seconds (-1 before the first), carried between batches.

    The state of a key is one value with its time; it is dropped when the watermark
    passes its time by the timeout. Rows of a batch are taken in the order of time.
    """

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, at = state.get if state.exists else (None, None)
        rows = pd.concat(batches).sort_values("ts")
        filled, ages = [], []
        for when, reading in zip(rows["ts"], rows["value"]):
            second = when.timestamp()
            if pd.notna(reading):
                seen, at = float(reading), second
            filled.append(seen)
            ages.append(-1.0 if at is None else second - at)
        if at is not None:
            state.update((seen, at))
            state.setTimeoutTimestamp(max(int(at * 1000), state.getCurrentWatermarkMs()) + 8 * 86_400_000)
        yield pd.DataFrame({"key": group[0], "ts": rows["ts"].to_numpy(), "filled": pd.array(filled, "Float64"), "age_s": ages})

    rows = events.withWatermark(ts, late).select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(run, "key string, ts timestamp, filled double, age_s double", "seen double, at double", "append", GroupStateTimeout.EventTimeTimeout)


def sweep(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, partition: str = "day"):
    """Writes every micro-batch's partitions; a batch that runs again replaces what it wrote before."""

    def put(batch: DataFrame, number: int) -> None:
        transform(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", partition).parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
