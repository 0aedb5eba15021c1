"""Run control: stale runs in batch and as a stream, the cooldown, and the feed of changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import config


def stale_runs(runs: DataFrame, now: Column, stale_minutes: int = config.DEFAULTS["stale_minutes"], timeout_minutes: int = config.DEFAULTS["timeout_minutes"]) -> DataFrame:
    """Running runs to be marked failed, with the reason; the timeout's wins."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    quiet = micros(now) - micros(F.coalesce("last_progress_at", "started_at")) > stale_minutes * 60_000_000
    late = micros(now) - micros(F.col("started_at")) > timeout_minutes * 60_000_000
    reason = F.when(late, f"Scan marked failed: exceeded the {timeout_minutes}-minute timeout.").when(quiet, f"Scan marked failed: no progress for over {stale_minutes} minutes.")
    return runs.filter("status = 'running'").withColumn("reason", reason).filter("reason is not null")


def cooldown_remaining(last: Column, now: Column, seconds: int = config.DEFAULTS["cooldown_seconds"]) -> Column:
    """Whole seconds until the next manual trigger; 0 if there was none."""
    gone = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / 1e6
    return F.coalesce(F.greatest(F.lit(0), F.ceil(seconds - gone)), F.lit(0))


def trigger_result(authorized: Column, site_found: Column, cooldown: Column, active_run: Column) -> Column:
    """What a manual trigger is answered."""
    return F.when(authorized.isNull(), "not_configured").when(~authorized, "unauthorized").when(~site_found, "site_not_found").when(cooldown > 0, "cooldown").when(active_run.isNotNull(), "already_running").otherwise("ok")


def change_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The append-only change table as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def heartbeat_watch(progress: DataFrame, stale_minutes: int = config.DEFAULTS["stale_minutes"], watermark: str = "1 minute") -> DataFrame:
    """From a stream of heartbeats (run_id, at, status): run_id and reason for runs that fall silent for too long in event time, once each."""
    limit = stale_minutes * 60_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "reason": [f"no progress for over {stale_minutes} minutes"]})
            return
        last, over = (state.get if state.exists else (0, False)) or (0, False)
        for b in batches:
            last = max(last, int(b["at"].max().timestamp() * 1000))
            over = over or bool((b["status"] != "running").any())
        if over:
            if state.exists:
                state.remove()
            return
        state.update((last, over))
        state.setTimeoutTimestamp(max(last + limit, state.getCurrentWatermarkMs() + 1))

    return progress.withWatermark("at", watermark).groupBy("run_id").applyInPandasWithState(step, "run_id long, reason string", "last long, over boolean", "append", GroupStateTimeout.EventTimeTimeout)


def throttled(progress: DataFrame, seconds: int = 2) -> DataFrame:
    """One heartbeat a run and span of so many seconds: the last of each."""
    return progress.groupBy("run_id", F.window("at", f"{seconds} seconds")).agg(F.max("at").alias("at"), F.max_by("stage", "at").alias("stage")).drop("window")
