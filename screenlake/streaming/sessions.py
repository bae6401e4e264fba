"""Sessions over streams of events: windows, duplicates within a watermark, running state of a session, and the sink."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "n long, overall double, l1_max double, l3_last double, terminated boolean"
OUTPUT = f"session long, {STATE}"


def events_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def window_counts(events: DataFrame, time: str, window: str, watermark: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Events a tumbling (or, with slide, sliding) window and key; rows later than the watermark are dropped once their
    window has closed."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withWatermark(time, watermark).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def activity(events: DataFrame, time: str, gap: str, watermark: str, key: str) -> DataFrame:
    """A key's spans of activity: events less than ``gap`` apart belong together."""
    return events.withWatermark(time, watermark).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def first_seen(events: DataFrame, time: str, watermark: str, *keys: str) -> DataFrame:
    """Each key once within the watermark; state is dropped behind it."""
    return events.withWatermark(time, watermark).dropDuplicatesWithinWatermark(list(keys))


def advance(state: tuple, layers: np.ndarray, scores: np.ndarray) -> tuple:
    """The state after events in order, up to the one at which the slow-burn rule ends the session."""
    n, overall, l1, l3, terminated = state
    if terminated or not len(scores):
        return state
    first = np.maximum.accumulate(np.where(layers == "L1", scores, l1))
    first = np.maximum(first, l1)
    at = np.maximum.accumulate(np.where(layers == "L3", np.arange(len(scores)), -1))
    third = np.where(at >= 0, scores[np.maximum(at, 0)], l3)
    ends = np.flatnonzero((third > 0.7) & (first > 0.3))
    k = int(ends[0]) if len(ends) else len(scores) - 1
    return n + k + 1, max(overall, float(scores[: k + 1].max())), float(first[k]), float(third[k]), bool(len(ends))


def session_state(events: DataFrame, time: str, watermark: str = "1 hour", idle_ms: int = 1_800_000) -> DataFrame:
    """A session's state after each batch: events until it ended, running maxima, whether a rule has ended it.

    events: session, event_id, layer, score and an event time. State is five numbers a session, however many events it has,
    and is dropped once the watermark lies ``idle_ms`` behind the session's last event.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else (0, 0.0, 0.0, 0.0, False)
        rows = pd.concat(list(batches)).sort_values("event_id")  # one session's events of one micro-batch
        now = advance(now, rows["layer"].to_numpy(), rows["score"].to_numpy(float))
        state.update(now)
        state.setTimeoutTimestamp(max(int(rows["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame([(key[0], *now)], columns=["session", "n", "overall", "l1_max", "l3_last", "terminated"])

    rows = events.select("session", "event_id", "layer", "score", F.col(time).alias("at")).withWatermark("at", watermark)
    return rows.groupBy("session").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def run_to_end(df: DataFrame, mode: str, folder: str) -> DataFrame:
    """Process what is there now; every batch writes its own part of a table, anew if it runs again. Returns the table, with
    the number of the batch, so that of updates the latest can be taken."""
    out = f"{folder}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    spark = df.sparkSession
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*")


def latest(df: DataFrame, *keys: str) -> DataFrame:
    """Of a table of updates, each key's row of the latest batch."""
    rest = [c for c in df.columns if c not in (*keys, "batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")
