"""Throttles, breakers and job states, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import scores

# Windows and limits of requests by key.
THROTTLES = {"api": ("15 minutes", 100), "auth": ("15 minutes", 5), "password": ("15 minutes", 5)}
#: The progress that each step of a documentation job has reached.
CHECKPOINTS = (10, 25, 40, 60, 80, 88, 92, 94, 95, 99, 100)


def throttled(events: DataFrame, key: str, ts: str = "ts", limit: int = 100, width: str = "15 minutes", late: str | None = None) -> DataFrame:
    """Requests of each key and window, and whether they are over the limit; works on a table and, with `late`, on a stream."""
    if late:
        events = events.withWatermark(ts, late)
    counts = events.groupBy(F.col(key), F.window(ts, width).alias("w")).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("blocked"))


def breaker(calls: DataFrame, key: str, ok: Column, order: Sequence[str] = ("ts",), limit: int = 3, reset_seconds: int = 300) -> DataFrame:
    """T5 in batch: for each call the failures that count after it, and whether they open the breaker.

    A failure adds one; a success sets them to none, and so does each failure `reset_seconds` later.  Calls and resets
    are put in one order, a reset before calls of the same time, and what was counted up to the last reset is taken
    off: two running sums for each key.  The first of `order` is the time.
    """
    ts, *ties = order
    rows = calls.withColumn("__ok", ok).withColumn("__at", F.unix_micros(ts)).withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in calls.columns]))
    tie = F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(ties)] or [F.lit(0).alias("t0")])
    call = rows.select(key, "__at", F.lit(1).alias("__kind"), tie.alias("__tie"), "__ok", "__row")
    later = call.filter(~F.col("__ok")).select(key, (F.col("__at") + reset_seconds * 1_000_000).alias("__at"), F.lit(0).alias("__kind"), "__tie", F.lit(True).alias("__ok"), F.lit(None).cast(call.schema["__row"].dataType).alias("__row"))
    upto = Window.partitionBy(key).orderBy("__at", "__kind", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = call.unionByName(later).withColumn("__n", F.sum(F.when(F.col("__ok"), 0).otherwise(1)).over(upto))
    n = n.withColumn("failures", F.col("__n") - F.coalesce(F.max(F.when(F.col("__ok"), F.col("__n"))).over(upto), F.lit(0)))
    return n.filter("__kind = 1").select("__row.*", "failures", (F.col("failures") >= limit).alias("is_open"))


def provider_order(stats: DataFrame) -> DataFrame:
    """T5: providers that aren't open, those with fewer failures first."""
    return stats.filter("not is_open").orderBy("failures", "provider")


def breaker_stream(calls: DataFrame, limit: int = 3, reset_seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """T5 as a stream of (provider, ok, ts), with the rule of `breaker`; a call that is earlier than one of a batch before
    counts at that one's time, and one that is `late` is left out.

    State is the count, the last time, and the failures of the last `reset_seconds`; it goes when they have passed.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    wait = reset_seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failures, last, pending = state.get if state.exists else (0, 0, [])
        pending = list(pending)
        calls_ = pd.concat(list(batches)).sort_values(["ts", "ok"], kind="stable")
        out = []
        for ts, ok in zip(calls_["ts"], calls_["ok"], strict=True):
            last = max(last, ts.value // 1000)
            while pending and pending[0] + wait <= last:
                pending.pop(0)
                failures = 0
            failures = 0 if ok else failures + 1
            if not ok:
                pending.append(last)
            out.append((key[0], ts, failures, failures >= limit))
        state.update((failures, last, pending))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, last // 1000 + reset_seconds * 1000))
        yield pd.DataFrame(out, columns=["provider", "ts", "failures", "is_open"])

    return calls.withWatermark("ts", late).groupBy("provider").applyInPandasWithState(
        step, "provider string, ts timestamp, failures int, is_open boolean", "failures int, last long, pending array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def paced(requests: DataFrame, key: str, order: Sequence[str], failures: Column, limited: Column, most: int = 3, spacing_ms: int = 1000, retry_ms: int = 2000) -> DataFrame:
    """T6 as a plan: requests of a provider go one after another; the attempts of each, whether it is answered, and when it
    starts, if calls take no time.

    Attempts are `spacing_ms` apart at least.  After a failure a request waits `retry_ms`, or longer each time if it was
    refused for its rate, then also after the last attempt; `most` failures end it.
    """
    failed = F.least(failures, F.lit(most)).cast("int")
    waits = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.when(k == 0, 0).when(limited, scores.backoff_ms(k)).when(k < most, retry_ms).otherwise(0))
    waited = F.aggregate(F.slice(waits, 1, failed + 1), F.lit(0).cast("long"), lambda s, x: s + x)
    span = waited + F.when(limited & (failed == most), 0).otherwise(spacing_ms)
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = requests.withColumn("attempts", F.least(failed + 1, F.lit(most))).withColumn("answered", failed < most)
    return rows.withColumn("start_ms", F.coalesce(F.sum(span).over(before), F.lit(0)).cast("long"))


def next_job_state(status: Column, progress: Column) -> Column:
    """Progress is kept within 0..100; all of it completes a job, some of it has it processing."""
    p = scores.clamp_progress(progress)
    new = F.when(status == "failed", status).when(p >= 100, "completed").when((status == "queued") & (p > 0), "processing").otherwise(status)
    return F.struct(new.alias("status"), F.when(new == "completed", 100).otherwise(p).alias("progress"))


def transitions(events: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """Each state of a key with the one after it."""
    return events.withColumn("next_state", F.lead(state).over(Window.partitionBy(key).orderBy(*order)))


def next_project_status(status: Column, upload: Column, analysis: Column) -> Column:
    """T3."""
    return F.when((status == "uploading") & (upload >= 100), "analyzing").when((status == "analyzing") & (analysis >= 100), "completed").otherwise(status)


def latest_state(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """T4: the newest values of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("s")).select(key, "s.*")


def status_or(state: Column, fallback: Column) -> Column:
    """T4: without a progress row the project's own status."""
    return F.coalesce(state, fallback)


def stage_log(jobs: DataFrame) -> DataFrame:
    """For each job the checkpoints that its progress has passed."""
    steps = F.array(*map(F.lit, CHECKPOINTS))
    return jobs.select("id", F.posexplode(F.filter(steps, lambda c: c <= F.col("progress"))).alias("step", "checkpoint"))


def cancelled(jobs: DataFrame, job_id: str) -> DataFrame:
    """An active job fails."""
    hit = (F.col("id") == job_id) & F.col("status").isin("queued", "processing")
    return jobs.withColumn("error_message", F.when(hit, "Cancelled by user").otherwise(F.col("error_message"))).withColumn("status", F.when(hit, "failed").otherwise(F.col("status")))
