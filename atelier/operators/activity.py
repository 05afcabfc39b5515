"""Jobs, sessions, tokens and rate limits, from logs of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values


def state_counts(jobs: DataFrame, state: str = "state") -> DataFrame:
    return jobs.groupBy(F.col(state).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def last_state(log: DataFrame, job: str, at: str, order: str, state: str) -> DataFrame:
    """``job, state``: of each job the latest event's, by a grouped maximum."""
    return log.groupBy(F.col(job).alias("job")).agg(F.max_by(state, F.struct(at, order)).alias("state"), F.count(F.lit(1)).alias("events"))


def retried(jobs: DataFrame, now: int, most: int = 3) -> DataFrame:
    """Failed runs go back to the queue with a longer wait each time, until they have failed ``most`` times."""
    again = (F.col("state") == "failed_run") & (F.col("attempts") < most)
    state = F.when(again, "queued").when(F.col("state") == "failed_run", "failed").otherwise(F.col("state"))
    return jobs.withColumn("run_after", F.when(again, F.lit(now) + values.backoff(F.col("attempts"))).otherwise(F.col("run_after"))).withColumn("state", state)


def next_jobs(jobs: DataFrame, now: int, n: int = 1) -> DataFrame:
    return jobs.filter((F.col("state") == "queued") & (F.col("run_after") <= now)).orderBy(F.desc("priority"), "id").limit(n)


def one_each(jobs: DataFrame) -> DataFrame:
    """Of live jobs with the same dedupe key, the oldest; finished ones and those without a key all stay."""
    live = F.col("state").isin("queued", "running") & F.col("dedupe_key").isNotNull()
    oldest = jobs.filter(live).groupBy("dedupe_key").agg(F.min("id").alias("id"))
    return jobs.filter(~live).unionByName(jobs.filter(live).join(oldest.select("id"), "id", "left_semi"))


def fixed_windows(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """``key, window_start, n``: windows that are aligned to the clock. The exact rule, a window from the
    first failure on, needs state: see ``streaming.limits``."""
    start = (values.epoch(at) - values.epoch(at) % seconds).alias("window_start")
    return events.groupBy(F.col(key).alias("key"), start).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """``key, started, ended, n``: runs of events that are at most ``gap`` seconds apart."""
    own = Window.partitionBy(key).orderBy(at, "event_id")
    fresh = F.when(values.epoch(at) - values.epoch(F.lag(at).over(own)) <= gap, 0).otherwise(1)
    numbered = events.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(F.col(key).alias("key"), "_run").agg(F.min(values.epoch(at)).alias("started"), F.max(values.epoch(at)).alias("ended"), F.count(F.lit(1)).alias("n")).drop("_run")


def token_state(expires: Column, revoked: Column, now: int) -> Column:
    return F.when(revoked.isNotNull(), "revoked").when(expires <= now, "expired").otherwise("valid")


def retained(rows: DataFrame, at: str, cutoff: int) -> DataFrame:
    """Rows not older than the cutoff; no cutoff would purge all and is refused."""
    if cutoff <= 0:
        raise ValueError("a cutoff is needed")
    return rows.filter(F.col(at) >= cutoff)


def signed_in(sessions_: DataFrame, users: DataFrame, now: int) -> DataFrame:
    """Sessions that have neither expired nor idled out, with their users; sessions of unknown users drop out.
    Sessions have user_id, expires_at and idle_expires_at, users id, name and role."""
    live = sessions_.filter((F.col("expires_at") > now) & (F.col("idle_expires_at") > now))
    return live.join(users.select(F.col("id").alias("user_id"), "name", "role"), "user_id")
