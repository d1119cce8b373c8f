"""Progress of a run: rates over a sliding window, time left, and event tails as streams."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WINDOW_SECONDS, THROTTLE_MS = 10, 250


class RateWindow:
    """Rows a second over the samples of the last ten seconds; two samples are always kept."""

    def __init__(self, seconds: float = WINDOW_SECONDS):
        self.seconds, self.samples = seconds, deque()

    def add(self, at: float, rows: int) -> float:
        self.samples.append((at, rows))
        while len(self.samples) > 2 and self.samples[0][0] < at - self.seconds:
            self.samples.popleft()
        (a, m), (b, n) = self.samples[0], self.samples[-1]
        return (n - m) / (b - a) if b > a else 0.0


class Throttle:
    """Lets an event through if the last one is long enough ago, or if it must go."""

    def __init__(self, least_ms: float = THROTTLE_MS):
        self.least_ms, self.last = least_ms, None

    def passes(self, at_ms: float, forced: bool = False) -> bool:
        if not forced and self.last is not None and at_ms - self.last < self.least_ms:
            return False
        self.last = at_ms
        return True


def seconds_left(totals: list[int | None], done: int, errors: int, rate: float) -> float | None:
    """None if the rate is zero or any total unknown."""
    if rate <= 0 or any(t is None for t in totals):
        return None
    return max(0, sum(totals) - done - errors) / rate


def sliding_counts(events: DataFrame, by: str, ts: str, seconds: int) -> DataFrame:
    """events with n_window: events of the same kind in the seconds up to each, itself included.

    Time is cut into stretches of eight windows, each counted by itself with the last window of the one before it, so no task
    sees a kind's whole history.
    """
    span = seconds * 1_000_000
    stretch = F.floor(F.col("__at") / F.lit(8 * span))
    seen = F.when(F.col("__at") >= (stretch + 1) * 8 * span - span, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))
    spread = events.withColumn("__at", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("__own", stretch)
    spread = spread.withColumn("__stretch", F.explode(F.when(F.col("__at").isNull(), F.array(F.lit(None).cast("long"))).otherwise(seen)))
    frame = Window.partitionBy(by, "__stretch").orderBy("__at").rangeBetween(-span, 0)
    counted = spread.withColumn("n_window", F.count("*").over(frame)).where(F.col("__own").eqNullSafe(F.col("__stretch")))
    return counted.drop("__at", "__own", "__stretch")


def windowed_rates(events: DataFrame, by: str, ts: str, window: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """Counts by kind and tumbling window; the same for a stream, late rows bounded by the watermark."""
    if events.isStreaming:
        events = events.withWatermark(ts, watermark)
    return events.groupBy(F.window(ts, window).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("window_start"), "n")


def tail(spark: SparkSession, path: str, schema, batch_files: int = 1) -> DataFrame:
    """A Parquet folder of events as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", batch_files).parquet(path)


def append_new(stream: DataFrame, target: str, checkpoint: str, after=None):
    """Append each batch to target, replayed batches replacing themselves: every batch has its own partition."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (after(batch) if after else batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
