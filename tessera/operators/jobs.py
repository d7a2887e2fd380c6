"""Index jobs as state transitions over a table, and their history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LIVE, TERMINAL = ("queued", "running"), ("succeeded", "failed", "cancelled")
#: Seconds of a lease, jobs of a history.
LEASE_SECONDS, HISTORY = 300.0, 100
SCOPE = ["workspace_id", "source_id", "idempotency_key"]


def expire(jobs: DataFrame, now: float) -> DataFrame:
    """Live jobs whose lease is over fail."""
    over = F.col("status").isin(*LIVE) & (F.col("lease_expires_at") <= now)
    return jobs.withColumns({"error": F.when(over, "lease expired").otherwise(F.col("error")), "updated_at": F.when(over, F.lit(now)).otherwise(F.col("updated_at")), "status": F.when(over, "failed").otherwise(F.col("status"))})


def submit(jobs: DataFrame, requests: DataFrame, now: float, lease: float = LEASE_SECONDS) -> DataFrame:
    """The table after requests (SCOPE, mode, job_id for new ones): a live job of the same key is joined, one that ended is queued again.

    Column ``outcome`` is joined, requeued, inserted, or null for jobs that no request names.
    """
    asked = requests.dropDuplicates(SCOPE).select(*SCOPE, F.col("mode").alias("asked_mode"), F.col("job_id").alias("asked_id"))
    both = expire(jobs, now).join(asked, SCOPE, "full_outer")
    outcome = F.when(F.col("asked_id").isNull(), F.lit(None)).when(F.col("job_id").isNull(), "inserted").when(F.col("status").isin(*LIVE), "joined").otherwise("requeued")
    again = outcome.isin("inserted", "requeued")
    return both.withColumn("outcome", outcome).select(
        F.coalesce("job_id", "asked_id").alias("job_id"),
        *SCOPE,
        F.coalesce("mode", "asked_mode").alias("mode"),
        F.when(again, "queued").otherwise(F.col("status")).alias("status"),
        F.coalesce("created_at", F.lit(now)).alias("created_at"),
        F.when(again, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(again, F.lit(now + lease)).otherwise(F.col("lease_expires_at")).alias("lease_expires_at"),
        F.when(again, F.lit("")).otherwise(F.col("error")).alias("error"),
        *(F.when(again, F.lit(None)).otherwise(F.col(c)).alias(c) for c in ("holder", "result") if c in jobs.columns),
        "outcome",
    )


def claim(jobs: DataFrame, asked: DataFrame, now: float, lease: float = LEASE_SECONDS) -> DataFrame:
    """The table after runners ask for jobs (job_id): column ``claimed`` says which of them now run.

    One job runs for a workspace and source.  Where none does, the oldest queued one that is asked for starts; the
    choice is an aggregate with partial results, so a scope with very many jobs isn't sorted in one task.
    """
    scope = ["workspace_id", "source_id"]
    rows = expire(jobs, now).join(asked.select("job_id").distinct().withColumn("asked", F.lit(True)), "job_id", "left")
    first = F.min(F.when(F.col("asked") & (F.col("status") == "queued"), F.struct("created_at", "job_id")))
    free = rows.groupBy(scope).agg(first.alias("first"), F.bool_or(F.col("status") == "running").alias("busy")).where("first IS NOT NULL AND NOT busy")
    rows = rows.join(free.select(F.col("first.job_id").alias("job_id"), F.lit(True).alias("won")), "job_id", "left")
    won = F.coalesce("won", F.lit(False))
    changed = {"status": F.lit("running"), "updated_at": F.lit(now), "lease_expires_at": F.lit(now + lease)}
    return rows.select(*(F.when(won, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in jobs.columns), won.alias("claimed"))


def renew(jobs: DataFrame, asked: DataFrame, now: float, lease: float = LEASE_SECONDS) -> DataFrame:
    """The table after heartbeats (job_id): the leases of running jobs are extended, lost ones stay lost."""
    rows = expire(jobs, now).join(asked.select("job_id").distinct().withColumn("asked", F.lit(True)), "job_id", "left")
    alive = F.coalesce("asked", F.lit(False)) & (F.col("status") == "running")
    return rows.withColumn("lease_expires_at", F.when(alive, F.lit(now + lease)).otherwise(F.col("lease_expires_at"))).select(*jobs.columns)


def finish(jobs: DataFrame, ended: DataFrame, now: float) -> DataFrame:
    """The table after jobs ended (job_id, error, and result if there is one): without an error they succeeded; the lease is given back."""
    own = [F.max("result").alias("gave")] if "result" in ended.columns else []
    last = ended.groupBy("job_id").agg(F.max(F.coalesce("error", F.lit(""))).alias("ended"), *own)
    rows, over = jobs.join(last, "job_id", "left"), F.col("ended").isNotNull()
    changed = {"status": F.when(F.col("ended") == "", "succeeded").otherwise("failed"), "error": F.col("ended"), "updated_at": F.lit(now), "lease_expires_at": F.lit(None)}
    changed |= {"result": F.col("gave")} if own else {}
    return rows.select(*(F.when(over, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in jobs.columns))


def active(jobs: DataFrame, now: float) -> DataFrame:
    """The oldest live job of each workspace and source."""
    live = jobs.where(F.col("status").isin(*LIVE) & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") > now)))
    first = F.row_number().over(Window.partitionBy("workspace_id", "source_id").orderBy("created_at", "job_id"))
    return live.withColumn("first", first).where("first = 1").drop("first")


def last_success(jobs: DataFrame) -> DataFrame:
    """(workspace_id, last_success_at): a job may name its workspaces in its result, * alone names none."""
    ids = F.coalesce(F.when(F.size("result_ids") > 0, F.col("result_ids")), F.when(F.col("workspace_id") != "*", F.array("workspace_id")))
    rows = jobs.where("status = 'succeeded'").select(F.explode(ids).alias("workspace_id"), "updated_at")
    return rows.groupBy("workspace_id").agg(F.max("updated_at").alias("last_success_at"))


def history(jobs: DataFrame, limit: int = HISTORY) -> DataFrame:
    """The latest jobs, with the duration of those that a dashboard started and that ended."""
    ended = F.startswith("idempotency_key", F.lit("gui-")) & F.col("status").isin(*TERMINAL)
    return jobs.select("job_id", "workspace_id", "status", "updated_at", F.when(ended, F.col("updated_at") - F.col("created_at")).alias("duration_seconds"), F.nullif("error", F.lit("")).alias("error")).orderBy(F.col("updated_at").desc(), "job_id").limit(limit)
