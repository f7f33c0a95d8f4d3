"""Streaming flows: decisions per micro-batch, trailing activity, bounded runs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskspark.operators import decide
from riskspark.operators.batch import Scorer, decide_batch
from riskspark.plans.fixpoint import passing

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep large state off the JVM heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def write_batches(stream: DataFrame, transform, path: str, checkpoint: str, output_mode: str = "append",
                  available_now: bool = True) -> StreamingQuery:
    """Write ``transform(batch)`` of every micro-batch under its own folder.

    A retried batch overwrites its folder, so nothing is written twice.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(sink).outputMode(output_mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class Arrivals:
    """What a stream has brought so far, a Parquet folder per micro-batch: its own history and its waiting room.

    A row is released once every row up to its time has had ``hold`` (an interval of event time) to
    arrive: when its time is not after the clock, the newest time seen minus ``hold``. Which rows a micro-batch releases follows
    from the stored folders alone, so a retry releases the same ones and nothing else must be kept. Rows
    without a time, after ``latest``, or later than ``hold`` allows are released at once; the first two don't move the clock.
    """

    def __init__(self, path: str, hold: str, latest=None):
        self.path, self.hold, self.latest = path, hold, latest

    def rows(self, batch: DataFrame) -> DataFrame:
        spark = batch.sparkSession
        return spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("batch_id", T.LongType())])).parquet(self.path)

    def _timed(self):
        timed = F.col("timestamp").isNotNull()
        return timed if self.latest is None else timed & (F.col("timestamp") <= F.lit(str(self.latest)).cast("timestamp_ntz"))

    def _clock(self, seen: DataFrame):
        return seen.where(self._timed()).agg((F.max("timestamp") - F.expr(f"INTERVAL {self.hold}")).alias("clock")).first()["clock"]

    def add(self, batch: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """Store a micro-batch; (the rows it releases, all rows stored so far)."""
        batch.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")
        seen = self.rows(batch).where(F.col("batch_id") <= batch_id)
        earlier, new = F.col("batch_id") < batch_id, F.col("batch_id") == batch_id
        before, now = self._clock(seen.where(earlier)), self._clock(seen)
        due = new & ~self._timed()
        if now is not None:
            reached = self._timed() & (F.col("timestamp") <= F.lit(str(now)).cast("timestamp_ntz"))
            due |= reached & (new if before is None else new | (F.col("timestamp") > F.lit(str(before)).cast("timestamp_ntz")))
        return seen.where(due).drop("batch_id"), seen.drop("batch_id")

    def held(self, like: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows still waiting, and all rows; for a stream that has ended."""
        seen = self.rows(like)
        clock = self._clock(seen)
        waiting = F.lit(False) if clock is None else self._timed() & (F.col("timestamp") > F.lit(str(clock)).cast("timestamp_ntz"))
        return seen.where(waiting).drop("batch_id"), seen.drop("batch_id")


def decide_with_history(stream: DataFrame, decision, history: DataFrame, path: str, checkpoint: str, hold: str,
                        latest=None, available_now: bool = True, then=None) -> StreamingQuery:
    """Write ``decision(rows, known)`` for the rows each micro-batch releases.

    ``known`` is ``history``, which holds no row of the stream, and everything the stream has brought. What depends
    on earlier rows only comes out alike however the stream is cut, as long as no row is later than
    ``hold``. Arrivals lie in ``{path}-arrivals``; ``finish`` decides the rows that still wait at the end.
    ``then(decided, batch_id)`` sees what was written.
    """
    arrivals = Arrivals(f"{path}-arrivals", hold, latest)

    def sink(batch: DataFrame, batch_id: int) -> None:
        due, seen = arrivals.add(batch, batch_id)
        out = f"{path}/batch_id={batch_id}"
        decision(due, history.unionByName(seen)).write.mode("overwrite").parquet(out)
        if then:
            then(batch.sparkSession.read.parquet(out), batch_id)

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def finish(like: DataFrame, decision, history: DataFrame, path: str, hold: str, latest=None) -> None:
    """Decide the rows that wait when a stream has ended for good, into ``batch_id=-1``. ``like`` has the stream's columns."""
    due, seen = Arrivals(f"{path}-arrivals", hold, latest).held(like)
    decision(due, history.unionByName(seen)).write.mode("overwrite").parquet(f"{path}/batch_id=-1")


def decide_stream(stream: DataFrame, scorer: Scorer, path: str, checkpoint: str, alerts_path: str | None = None,
                  available_now: bool = True, hold: str | None = None) -> StreamingQuery:
    """Score and log every micro-batch; high-risk rows also go to the alert feed.

    Without ``hold`` the scorer's history is taken to contain the stream's rows already. With it the stream
    keeps its own arrivals beside a history that holds none of them (``decide_with_history``).
    """
    def alert(decided: DataFrame, batch_id: int) -> None:
        if alerts_path:
            decide.high_risk_alerts(decided).write.mode("overwrite").parquet(f"{alerts_path}/batch_id={batch_id}")

    if hold:
        return decide_with_history(stream, lambda rows, known: decide_batch(rows, replace(scorer, history=known)), scorer.history,
                                   path, checkpoint, hold, scorer.as_of, available_now, alert)

    def sink(batch: DataFrame, batch_id: int) -> None:
        out = f"{path}/batch_id={batch_id}"
        with passing(batch.sparkSession):
            decide_batch(batch, scorer).write.mode("overwrite").parquet(out)
        alert(batch.sparkSession.read.parquet(out), batch_id)

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def activity_parts(stream: DataFrame, length: str = "24 hours", part: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count and volume per customer and ``part`` of time, from which windows of ``length`` are added up.

    State and output hold a row per part, not one per window over it. A part is kept until ``late``
    and a window's length have passed, so a row is dropped only when every window over it has closed.
    """
    timed = stream.withColumn("event_time", F.col("timestamp").cast("timestamp"))
    return (timed.withWatermark("event_time", f"{late} {length}")
            .groupBy("customer_id", F.window("event_time", part))
            .agg(F.count(F.lit(1)).alias("transactions"), F.sum(F.col("amount").cast("double")).alias("volume"))
            .select("customer_id", F.col("window.start").cast("timestamp_ntz").alias("part_start"), "transactions", "volume"))


def trailing_activity(parts: DataFrame, length: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Count and volume per customer in sliding windows, from the written micro-batches of ``activity_parts``.

    The newest micro-batch that wrote a part holds its totals. ``length`` and ``slide`` are whole numbers of
    parts. Rows move once, by customer: a customer has a row per part, however many transactions.
    """
    last = (parts.repartition("customer_id").groupBy("customer_id", "part_start")
            .agg(F.max_by("transactions", "batch_id").alias("transactions"), F.max_by("volume", "batch_id").alias("volume")))
    # Listed, not F.window: that would lose the order by customer, and every window would move.
    newest, span, step = F.window(F.col("part_start").cast("timestamp"), slide)["start"], F.expr(f"INTERVAL {length}"), F.expr(f"INTERVAL {slide}")
    return (last.select("customer_id", "transactions", "volume", F.explode(F.sequence(newest - span + step, newest, step)).alias("window_start"))
            .groupBy("customer_id", "window_start").agg(F.sum("transactions").alias("transactions"), F.sum("volume").alias("volume"))
            .select("customer_id", F.col("window_start").cast("timestamp_ntz"),
                    (F.col("window_start") + span).cast("timestamp_ntz").alias("window_end"), "transactions", "volume"))
