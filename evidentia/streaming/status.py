"""Streams of availability checks, scan progress and finished collectors; each has a batch form of the same result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import upsert


def latest_status(checks: DataFrame) -> DataFrame:
    """checks(id, shop_id, is_online, response_ms, checked_at) -> the last state of each shop; runs on streams (update mode) and tables."""
    return checks.groupBy("shop_id").agg(F.max(F.struct("checked_at", "id", "is_online", "response_ms")).alias("s")).select(
        "shop_id", "s.checked_at", "s.id", "s.is_online", "s.response_ms"
    )


def latest_progress(events: DataFrame) -> DataFrame:
    """events(scan_id, ts, seq, progress) -> the last progress of each scan."""
    return events.groupBy("scan_id").agg(F.max(F.struct("ts", "seq", "progress")).alias("s"), F.count("*").alias("updates")).select("scan_id", "s.ts", "s.progress", "updates")


def hourly_uptime(checks: DataFrame, late: str = "1 hour") -> DataFrame:
    """Checks and share online per hour. On streams, run it in append mode: an hour comes out once, when the watermark has passed its
    end, and its state is let go; a check that comes later still is left out."""
    rows = checks.withColumn("checked_at", F.col("checked_at").cast("timestamp"))
    rows = rows.withWatermark("checked_at", late) if checks.isStreaming else rows
    return rows.groupBy(F.window("checked_at", "1 hour")).agg(F.count("*").alias("checks"), F.sum(F.col("is_online").cast("int")).alias("online")).select(
        F.col("window.start").alias("hour"), "checks", "online"
    )


def first_success(attempts: DataFrame, by: str, most: int = 3) -> DataFrame:
    """attempts(by, attempt, ok, result) -> the first successful of up to `most` attempts, else the last one."""
    tried = attempts.filter(F.col("attempt") <= most)
    return tried.groupBy(by).agg(F.coalesce(F.min_by(F.when(F.col("ok"), F.col("result")), F.when(F.col("ok"), F.col("attempt"))), F.max_by("result", "attempt")).alias("result"), F.bool_or("ok").alias("ok"))


def scan_states(scans: DataFrame, done: DataFrame) -> DataFrame:
    """scans(id, requested[, error]), done(scan_id, collector, ok) -> the status of each scan: failed when the scan itself has an error,
    else pending, running, completed, or partial when every collector ended and one failed."""
    ended = done.groupBy("scan_id").agg(F.array_sort(F.collect_set("collector")).alias("completed"), F.bool_and("ok").alias("all_ok"))
    joined = scans.join(ended, scans["id"] == ended["scan_id"], "left")
    left = F.size(F.array_except("requested", F.coalesce("completed", F.array().cast("array<string>"))))
    failed = F.col("error").isNotNull() if "error" in scans.columns else F.lit(False)
    status = F.when(failed, "failed").when(F.col("completed").isNull(), "pending").when(left > 0, "running").when(F.col("all_ok"), "completed").otherwise("partial")
    return joined.select("id", status.alias("status"), left.alias("left"))


class ScanMachine(StatefulProcessor):
    """The same states as scan_states, kept per scan over a stream of (scan_id, requested, collector, ok, at). With patience, in
    milliseconds of event time, a scan that nothing more is heard of for so long becomes failed unless it had ended, and its state is
    let go either way."""

    def __init__(self, patience: int | None = None) -> None:
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("collectors", "collector string", "ok boolean")
        self.wanted = handle.getValueState("requested", "requested array<string>")

    def _status(self) -> tuple[str, int]:
        states = {k[0]: v[0] for k, v in self.seen.iterator()}
        left = len(set(self.wanted.get()[0]) - states.keys())
        return "pending" if not states else "running" if left else "completed" if all(states.values()) else "partial", left

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for batch in rows:
            for requested, collector, ok in zip(batch["requested"], batch["collector"], batch["ok"]):
                self.wanted.update((list(requested),))
                if collector is not None:
                    self.seen.updateValue((collector,), (bool(ok),))
            if self.patience is not None:
                last = int(batch["at"].max().timestamp() * 1000)
                latest = last if latest is None else max(latest, last)
        if latest is not None:
            set_before = list(self.handle.listTimers())
            for timer in set_before:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max([latest + self.patience, *set_before]))
        status, left = self._status()
        yield pd.DataFrame({"scan_id": [key[0]], "status": [status], "left": [left]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, left = self._status()
        self.seen.clear()
        self.wanted.clear()
        if status not in ("completed", "partial"):
            yield pd.DataFrame({"scan_id": [key[0]], "status": ["failed"], "left": [left]})

    def close(self) -> None:
        pass


_STATES = "scan_id long, status string, left int"


def scan_machine(events: DataFrame) -> DataFrame:
    """A stream of events -> the status of each scan after each batch (update mode). A scan's state is kept for good."""
    return events.groupBy("scan_id").transformWithStateInPandas(ScanMachine(), outputStructType=_STATES, outputMode="Update", timeMode="None")


def timed_scan_machine(events: DataFrame, late: str = "10 minutes", patience: str = "1 hour") -> DataFrame:
    """scan_machine over events with a time, `at`: a scan without events for `patience` becomes failed when the watermark has passed that
    time, and what is kept of it is let go, as is what is kept of an ended scan. Events that come more than `late` behind are left
    out; a scan heard of again after that begins anew."""
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)
    timed = events.withWatermark("at", late).groupBy("scan_id")
    return timed.transformWithStateInPandas(ScanMachine(wait), outputStructType=_STATES, outputMode="Update", timeMode="EventTime")


def timed_scan_states(scans: DataFrame, done: DataFrame, now: Column, patience: str = "1 hour") -> DataFrame:
    """The batch form: scans(id, requested, begun), done(scan_id, collector, ok, at) -> scan_states, those failed that are not ended and of
    which nothing was heard within `patience` before now."""
    heard = done.groupBy("scan_id").agg(F.max("at").alias("_at"))
    states = scan_states(scans, done).join(scans.select("id", "begun"), "id").join(heard, F.col("id") == F.col("scan_id"), "left")
    silent = F.greatest(F.col("begun"), F.col("_at")) + F.expr(f"interval {patience}") <= now
    given_up = silent & F.col("status").isin("pending", "running")
    return states.select("id", F.when(given_up, "failed").otherwise(F.col("status")).alias("status"), "left")


def distinct_checks(checks: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each check once, by its id. On streams a repetition is known for `late` after the first one, and then its state is let go; a table has
    all repetitions at hand."""
    if not checks.isStreaming:
        return checks.dropDuplicates(["id"])
    return checks.withColumn("checked_at", F.col("checked_at").cast("timestamp")).withWatermark("checked_at", late).dropDuplicatesWithinWatermark(["id"])


def work_sessions(events: DataFrame, by: str, at: str, pause: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """events(by, at) -> by, begun, ended, done: runs of work without a pause longer than `pause`. On streams, in append mode: a run comes
    out when the watermark has passed its end."""
    rows = events.select(by, F.col(at).cast("timestamp").alias("_at"))
    rows = rows.withWatermark("_at", late) if events.isStreaming else rows
    return rows.groupBy(by, F.session_window("_at", pause)).agg(F.min("_at").alias("begun"), F.max("_at").alias("ended"), F.count("*").alias("done")).select(by, "begun", "ended", "done")


def time_left(sessions: DataFrame, by: str, total: Column) -> DataFrame:
    """work_sessions -> by, done, left, elapsed and eta in seconds: the time at work, pauses left out, for each piece done, times those left.
    total is what there is to do, over the columns of the result; eta is null while no time has passed."""
    seconds = F.unix_micros("ended") - F.unix_micros("begun")
    sums = sessions.groupBy(by).agg(F.sum("done").alias("done"), (F.sum(seconds) / 1_000_000).alias("elapsed"))
    sums = sums.withColumn("left", F.greatest(F.lit(0).cast("long"), total - F.col("done")))
    return sums.withColumn("eta", F.when(F.col("elapsed") > 0, F.col("elapsed") / F.col("done") * F.col("left"))).select(by, "done", "left", "elapsed", "eta")


def scan_queue(requests: DataFrame, work: Callable[[dict], str], abort_at: int | None = None) -> DataFrame:
    """requests(shop_id, place, ...) -> (shop_id, place, status, result): each shop's work on its own, so that an error becomes the row
    of its shop (status error, the message as result) and stops no other. Shops from place abort_at on are not begun and give no
    rows. Runs on tables and streams; a task that is lost does its shops again, so work must bear that."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for row in batch.to_dict("records"):
                try:
                    done.append(("ok", work(row)))
                except Exception as error:
                    done.append(("error", str(error)))
            yield pd.DataFrame({"shop_id": batch["shop_id"], "place": batch["place"], "status": [x[0] for x in done], "result": [x[1] for x in done]})

    begun = requests if abort_at is None else requests.filter(F.col("place") < abort_at)
    return begun.mapInPandas(run, "shop_id long, place long, status string, result string")


def fold_latest(spark: SparkSession, checks: DataFrame, folder: str) -> DataFrame:
    """Run a stream of checks over what is there now, each batch folded into the stored last state of each shop, so that every batch
    sees what the ones before it appended. Only the buckets of shops in a batch are written (sources/upsert)."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in latest_status(checks).schema.fields)

    def fold(batch: DataFrame, number: int) -> None:
        upsert.upsert(latest_status(batch), number, f"{folder}/latest", "shop_id", ["checked_at", "id"])

    query = checks.writeStream.foreachBatch(fold).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return upsert.stored(spark, f"{folder}/latest", schema)


def replay(spark: SparkSession, stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over what is there now and return its results: the last table in complete mode, else all changes. Batches
    are written as Parquet by the executors; folder must be one that they share."""
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/rows")

    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/rows")
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/rows")
