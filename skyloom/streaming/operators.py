"""Streaming twins of the grouping operators (ST1-ST4)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def incoming(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_trigger: int = 1000) -> DataFrame:
    """ST1: newly arrived files of a folder; the checkpoint remembers what was read."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that is there into a Parquet sink, exactly once, then stop."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
    q.awaitTermination()


def stream_events(df: DataFrame, time: str, keys: list[str], gap: str, lateness: str) -> DataFrame:
    """ST2: events as sessions whose gaps do not exceed ``gap``; closed sessions are emitted once."""
    s = df.withWatermark(time, lateness).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(
        F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.count(F.lit(1)).alias("n_detections"), F.max("value").alias("flux_max"))
    return s.drop("w")


def stream_bins(df: DataFrame, time: str, keys: list[str], width: str, lateness: str, slide: str | None = None) -> DataFrame:
    """ST3: time bins (tumbling, or sliding with ``slide``)."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    s = df.withWatermark(time, lateness).groupBy(*keys, w.alias("w")).agg(F.avg("value").alias("flux"), F.count(F.lit(1)).alias("n_frames"))
    return s.select(*keys, F.col("w.start").alias("bin_start"), "flux", "n_frames")


EXTENDED = "objid long, frame_start long, frame_end long, n_detections long"
OPEN = "start long, end long, last long, misses long, hits long"
CLOSED = (-1, -1, -1, 0, 0)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Extension(StatefulProcessor):
    """State of ST4 per object: the open event and the frames that the watermark has not passed.

    Frames wait until no row of theirs can come any more, so the order of arrival does not matter.
    An event-time timer stands at the end of the first waiting frame, or at the end of the frame with
    which absent frames alone would use up the open event's budget; what is left without an
    open event or a waiting frame is cleared.
    """

    def __init__(self, open_sig: float, hit_sig: float, budget: int, frame_ms: int, origin_ms: int):
        self.open_sig, self.hit_sig, self.budget = open_sig, hit_sig, budget
        self.frame_ms, self.origin_ms = frame_ms, origin_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.event = handle.getValueState("event", OPEN)
        self.waiting = handle.getMapState("waiting", "frame long", "sig double")

    def close(self) -> None:
        pass

    def _wake(self, frame: int) -> None:
        self.handle.registerTimer(self.origin_ms + (frame + 1) * self.frame_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found: dict[int, float] = {}
        for pdf in rows:
            for frame, sig in pdf.groupby("frame")["sig"].max().items():
                found[int(frame)] = max(float(sig), found.get(int(frame), float("-inf")))
        for frame, sig in found.items():
            before = self.waiting.getValue((frame,)) if self.waiting.containsKey((frame,)) else None
            self.waiting.updateValue((frame,), (sig if before is None else max(sig, before[0]),))
        if found:
            self._wake(min(found))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        through = (timerValues.getCurrentWatermarkInMs() - self.origin_ms) // self.frame_ms - 1
        frames = sorted((k[0], v[0]) for k, v in self.waiting.iterator())
        due = [f for f in frames if f[0] <= through]
        event, done = self.advance(tuple(self.event.get()) if self.event.exists() else CLOSED, due, through)
        for frame, _ in due:
            self.waiting.removeKey((frame,))
        later = [f[0] for f in frames[len(due):]]
        if event[0] >= 0:
            self.event.update(event)
            later.append(event[2] + self.budget - event[3])
        else:
            self.event.clear()
        if later:
            self._wake(min(later))
        yield pd.DataFrame([(key[0], *d) for d in done], columns=["objid", "frame_start", "frame_end", "n_detections"])

    def advance(self, event: tuple, frames: list[tuple[int, float]], through: int) -> tuple[tuple, list[tuple[int, int, int]]]:
        """The open event after ``frames`` and all absent frames up to ``through``, and the events that closed."""
        start, end, last, misses, hits = event
        done = []
        for frame, sig in frames:
            if start >= 0:
                if frame <= last:
                    continue
                misses += frame - last - 1 + (0 if sig >= self.hit_sig else 1)
                # A hit only counts when the budget was not used up before it.
                if misses >= self.budget:
                    done.append((start, end, hits))
                    start = -1
                elif sig >= self.hit_sig:
                    end, hits = frame, hits + 1
            if start < 0 and sig >= self.open_sig:
                start, end, misses, hits = frame, frame, 0, 1
            last = frame
        if start >= 0 and misses + through - last >= self.budget:
            done.append((start, end, hits))
            start = -1
        return ((start, end, last, misses, hits) if start >= 0 else CLOSED), done


def stream_extend(df: DataFrame, time: str, frame_seconds: int, origin: int = 0, lateness: str = "1 hour", open_sig: float = 5.0,
                  hit_sig: float = 3.0, budget: int = 5) -> DataFrame:
    """ST4: event boundaries with a budget of missed frames, over rows of objid, frame, sig and ``time``.

    An event opens at ``open_sig``, follows every frame from ``hit_sig`` on and closes when
    ``budget`` frames were missed in all, absent frames included.  Frame f ends at ``origin`` + (f + 1) *
    ``frame_seconds`` (Unix seconds); an event is given out once the watermark passes the frame that closes
    it, whether rows come after it or not.  Rows that ``lateness`` leaves behind are dropped.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = df.select("objid", "frame", "sig", time).filter("sig IS NOT NULL AND frame IS NOT NULL").withWatermark(time, lateness)
    step = Extension(open_sig, hit_sig, budget, 1000 * frame_seconds, 1000 * origin)
    return rows.groupBy("objid").transformWithStateInPandas(statefulProcessor=step, outputStructType=EXTENDED, outputMode="Append", timeMode="EventTime")
