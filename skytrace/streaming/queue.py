"""The scoring queue as a stream of files: each micro-batch is scored and written by batch id, so that a restart repeats none; and the states
of its jobs, as a stream with timers or from their log."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skytrace.storage import settled


def newest(jobs: DataFrame, key: str, order: str) -> DataFrame:
    """One job per flight, the newest."""
    return jobs.groupBy(key).agg(F.max(F.struct(order, *[c for c in jobs.columns if c not in (key, order)])).alias("_j")).select(key, "_j.*")


def _said(error: Exception) -> str:
    """What a scorer said when it failed: the last line that names an error, else the first."""
    lines = str(error).strip().splitlines() or [type(error).__name__]
    named = [x for x in lines if re.match(r"\w*(Error|Exception): ", x)]
    return (named or lines)[-1 if named else 0][:500]


def scored_apart(batch: DataFrame, score: Callable[[DataFrame], DataFrame], key: str, attempts: int = 2, most_failures: int = 100) -> tuple[list[DataFrame], list[tuple]]:
    """The settled scores of a batch, in pieces, and (key, attempts, error) of the flights whose scoring fails.

    The batch is scored whole. If that fails it is halved by a digest of the key, and each half is scored by itself, until what fails is one
    flight, which gets `attempts` tries. One bad flight costs as many jobs as the batch has bits of flights. If more than most_failures fail, it isn't the
    flights: the error is raised, and the stream stands until it starts again. Rows whose key is null are one flight."""
    done, failed, todo = [], [], [(1, 0)]
    while todo:
        parts, part = todo.pop()
        piece = batch if parts == 1 else batch.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part)
        for attempt in range(1, attempts + 1):
            try:
                done.append(settled(score(piece)))
                break
            except Exception as e:
                flights = piece.select(key).distinct().take(2)
                if len(flights) > 1:
                    todo += [(2 * parts, part + parts), (2 * parts, part)]
                    break
                if attempt == attempts:
                    if len(failed) == most_failures:
                        raise
                    failed.append((flights[0][0] if flights else None, attempts, _said(e)))
    return done, failed


def score_files(spark: SparkSession, incoming: str, schema: str, out: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], files_at_once: int = 64, key: str = "flight_id", failures: str | None = None) -> StreamingQuery:
    """Score every Parquet file that comes into a folder, and stop when there is none left.

    The checkpoint keeps which files are done: it is the queue's order, its recovery and its memory of attempts. A batch overwrites
    its own folder batch=<id>, so one that was cut off is done again without leaving rows behind. A flight whose scoring fails ends no
    batch: (flight, attempts, error) goes to the batch's folder in `failures`, by default beside out.
    """
    failures = failures or f"{out.rstrip('/')}_failed"

    def one(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            done, failed = scored_apart(kept, score, key)
        finally:
            kept.unpersist()
        if done:
            reduce(DataFrame.unionByName, done).write.mode("overwrite").parquet(f"{out}/batch={number}")
        kind = batch.schema[key].dataType.simpleString()
        batch.sparkSession.createDataFrame(failed, f"{key} {kind}, attempts int, error string").coalesce(1).write.mode("overwrite").parquet(f"{failures}/batch={number}")

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(incoming)
    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _lifecycle(most_attempts: int, retry_ms: int, stall_ms: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.exists
        attempts, error, due = state.get if known else (0, None, None)
        out = []
        tell = lambda at, now: out.append((key[0], pd.Timestamp(at, unit="ms"), now, attempts, error))
        if state.hasTimedOut:
            tell(due, "queued")
            due = None
        else:
            rows = []
            for batch in batches:
                at = (batch["at"] - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1)
                rows += zip(at.tolist(), batch["n"].tolist(), batch["event"].tolist(), batch["error"].tolist())
            for at, _, event, said in sorted(rows, key=lambda r: r[:2]):
                if due is not None and due <= at:
                    tell(due, "queued")
                    due = None
                if event == "queued" and not known:
                    known = True
                    tell(at, "queued")
                elif known and event == "running":
                    attempts, due = attempts + 1, at + stall_ms
                    tell(at, "running")
                elif known and event == "done":
                    error, due = None, None
                    tell(at, "done")
                elif known and event == "failed":
                    error, due = said, at + retry_ms if attempts < most_attempts else None
                    tell(at, "failed")
        if known:
            state.update((attempts, error, due))
            if due is not None:
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["flight_id", "at", "state", "attempts", "error"])

    return step


def lifecycle(events: DataFrame, most_attempts: int = 3, retry_s: int = 60, stall_s: int = 3600, late: str = "1 minute") -> DataFrame:
    """(flight_id, at, state, attempts, error): each state that a job comes to, as a stream over what is told of jobs (flight_id, at, n, event,
    error), event being queued, running, done or failed, n the order of what is told at one time.

    A job is queued once, and again by a timer: retry_s after it failed, while it has had fewer than most_attempts, and stall_s after it began to run
    if nothing is told of it since, as its worker may be gone. An error stays until a run ends well. What is told of a job that was
    never queued, events of other names and rows with a null in flight_id, at, n or event tell nothing. Timers go by the watermark, the latest at less `late`. State is three
    values per job."""
    whole = events.select("flight_id", "at", "n", "event", "error").dropna(subset=["flight_id", "at", "n", "event"]).withWatermark("at", late)
    step = _lifecycle(most_attempts, retry_s * 1000, stall_s * 1000)
    return whole.groupBy("flight_id").applyInPandasWithState(step, "flight_id long, at timestamp, state string, attempts long, error string", "attempts long, error string, due long", "append", GroupStateTimeout.EventTimeTimeout)


def behind(tracks: DataFrame, version: int) -> DataFrame:
    """Stored tracks of an older version, which a backfill encodes again."""
    return tracks.where(F.col("version") < version)


def states(log: DataFrame) -> DataFrame:
    """(flight_id, state, attempts, created_at, started_at, finished_at, error) of every job, from its log (flight_id, at, event, error)
    of queued, running, done and failed. A job is queued once; each run is an attempt; an error stays until a run ends well."""
    last = F.max(F.when(F.col("event") != "queued", F.struct("at", "event", "error"))).alias("_last")
    ran = F.max(F.when(F.col("event") == "running", F.col("at"))).alias("started_at")
    ended = F.max(F.when(F.col("event").isin("done", "failed"), F.struct("at", "event", "error"))).alias("_end")
    jobs = log.groupBy("flight_id").agg(F.min(F.when(F.col("event") == "queued", F.col("at"))).alias("created_at"), F.count_if(F.col("event") == "running").alias("attempts"), last, ran, ended)
    error = F.when(F.col("_end.event") == "failed", F.col("_end.error"))
    return jobs.where("created_at is not null").select("flight_id", F.coalesce("_last.event", F.lit("queued")).alias("state"), "attempts", "created_at", "started_at", F.col("_end.at").alias("finished_at"), error.alias("error"))


def recovered(jobs: DataFrame, booted: Column) -> DataFrame:
    """jobs after a start at `booted`: those that were running when the process before it ended are queued again."""
    orphan = (F.col("state") == "running") & (F.col("started_at") < booted)
    marked = jobs.withColumn("_orphan", F.coalesce(orphan, F.lit(False)))
    marked = marked.withColumn("started_at", F.when(~F.col("_orphan"), F.col("started_at")))
    return marked.withColumn("state", F.when(F.col("_orphan"), "queued").otherwise(F.col("state"))).drop("_orphan")
