"""An online demand monitor on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, remove, scratch


def event_stream(spark: SparkSession, sf_dir: str, zones: int = 30, per_trigger: int = 1) -> DataFrame:
    """ts (timestamp), zone_id from the events file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", per_trigger).parquet(sf_dir)
    return rows.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % zones + 1).cast("long").alias("zone_id"))


def cumulative_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("zone_id").agg(F.count("*").alias("trips"))


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """window_start, zone_id, trips by event time; rows later than `late` are dropped once their window closed."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(span.alias("w"), "zone_id").agg(F.count("*").alias("trips")).select(F.col("w.start").alias("window_start"), "zone_id", "trips")


def drain(result: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what its source holds and return its result.

    Every batch is written to the shared folder; in complete mode the last one
    is the result, in append mode all are.
    """
    spark = result.sparkSession
    place, last = scratch(spark, name), []

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{place}/batch={batch}")
        last[:] = [f"{place}/batch={batch}"] if mode == "complete" else [*last, f"{place}/batch={batch}"]

    run(result, keep, mode)
    return spark.read.schema(result.schema).parquet(*last) if last else spark.createDataFrame([], result.schema)


def run(stream: DataFrame, each: Callable[[DataFrame, int], object], mode: str = "append") -> None:
    """Hand all batches that the stream's source holds to each(rows, number)."""

    def take(rows: DataFrame, batch: int) -> None:
        each(rows, batch)

    query = stream.writeStream.foreachBatch(take).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def trailing_counts(stream: DataFrame, window: timedelta) -> DataFrame:
    """zone_id, trips of the monitor's window once it has taken all that the stream's source holds."""
    monitor = StreamingMonitor(stream.sparkSession, window)
    run(stream, monitor.update_batch)
    return monitor.window_frame()


HELD = "batch long, ts timestamp, zone_id long, n long"


class StreamingMonitor:
    """Counts per zone over micro-batches, cumulative and (with a window) trailing.

    update_batch takes a DataFrame (ts, zone_id); it also serves as a
    foreachBatch function.  Counts are merged by zone, so the driver holds one
    number a zone.

    The window leaves first-in first-out: from the head, events older than the
    latest less `window` are taken off, so a late event stays until those ahead
    of it have left.  At any moment the window thus begins with the first
    arrival that is not older than that; no event need be looked at in turn.
    Events of one batch count as arriving in order of time.  The window's
    events, counted by batch, time and zone, lie in the shared folder.
    """

    def __init__(self, spark: SparkSession, window: timedelta | None = None):
        self.spark, self.window = spark, window
        self._counts: dict[int, int] = {}
        self._held: str | None = None
        self._latest = None
        self._n = self._batch = 0

    def update(self, ts, zone_id: int) -> None:
        self.update_batch(self.spark.createDataFrame([(ts, zone_id)], "ts timestamp, zone_id long"))

    def update_batch(self, events: DataFrame, _batch: int | None = None) -> int:
        """Take a batch; the number of its events."""
        rows = events.groupBy("zone_id").agg(F.count("*").alias("n"), F.max("ts").alias("t")).collect()
        n = sum(r["n"] for r in rows)
        if not n:
            return 0
        for r in rows:
            self._counts[r["zone_id"]] = self._counts.get(r["zone_id"], 0) + r["n"]
        top = max(r["t"] for r in rows)
        self._latest = top if self._latest is None else max(self._latest, top)
        self._n, self._batch = self._n + n, self._batch + 1
        if self.window is not None:
            self._roll(events)
        return n

    def _roll(self, events: DataFrame) -> None:
        cells = events.groupBy(F.col("ts").cast("timestamp").alias("ts"), F.col("zone_id").cast("long").alias("zone_id")).agg(F.count("*").alias("n"))
        every = self._window().unionByName(cells.withColumn("batch", F.lit(self._batch).cast("long")))
        place = F.struct("batch", "ts")
        # The latest event is never too old, so there is a first one.
        first = F.broadcast(every.filter(F.col("ts") >= F.lit(self._latest - self.window)).agg(F.min(place).alias("first")))
        old, self._held = self._held, scratch(self.spark, "window")
        every.join(first, place >= F.col("first")).drop("first").write.parquet(self._held)
        if old:
            remove(self.spark, old)

    def _window(self) -> DataFrame:
        return self.spark.read.schema(HELD).parquet(self._held) if self._held else self.spark.createDataFrame([], HELD)

    def counts(self) -> dict[int, int]:
        return dict(self._counts)

    def window_frame(self) -> DataFrame:
        """zone_id, trips of the window; no rows without one."""
        return self._window().groupBy("zone_id").agg(F.sum("n").alias("trips"))

    def window_counts(self) -> dict[int, int]:
        return {r["zone_id"]: r["trips"] for r in self.window_frame().collect()} if self._held else {}

    def top_k(self, k: int = 10, windowed: bool = False) -> list[tuple[int, int, int]]:
        """(rank, zone, count), ties to the smaller zone."""
        counts = self.window_counts() if windowed else self._counts
        best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: max(0, k)]
        return [(r, z, n) for r, (z, n) in enumerate(best, 1)]

    @property
    def ingested(self) -> int:
        return self._n

    @property
    def latest_ts(self):
        return self._latest

    def __len__(self) -> int:
        return self._n

    def snapshot(self) -> dict:
        return {
            "ingested": self._n,
            "latest_ts": self._latest.isoformat() if self._latest else None,
            "unique_zones": len(self._counts),
            "window_seconds": self.window.total_seconds() if self.window else None,
            "window_events": sum(self.window_counts().values()),
        }


def stream_from_dataframe(events: DataFrame, ts_col: str = "ts", zone_col: str = "zone_id", batch_size: int = 1) -> Iterator[DataFrame]:
    """Replay a frame in time order, batch_size rows at a time; errors are raised at the first batch.

    The numbered rows are written once, in order of batches, so that a batch
    reads little more than itself.
    """
    from ..operators.approximate import batches

    numbered = batches(events, batch_size, ts_col, zone_col).select(ts_col, zone_col, "batch")
    numbered = materialise(numbered.repartitionByRange("batch").sortWithinPartitions("batch"), "replay")
    last = numbered.agg(F.max("batch")).first()[0]
    for k in range((last if last is not None else -1) + 1):
        yield numbered.filter(F.col("batch") == k).select(F.col(ts_col).cast("timestamp").alias("ts"), F.col(zone_col).alias("zone_id"))
