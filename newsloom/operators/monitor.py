"""Decisions over counts: storage, backlog, failing sources, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Percentages of the storage limit, the limit itself, articles for one worker, workers, failures in a row.
WARN_PERCENT, STOP_PERCENT, LIMIT_BYTES = 70.0, 90.0, 500 * 1024 * 1024
PER_WORKER, LEAST_WORKERS, MOST_WORKERS = 20, 1, 8
FAILING = 3


def storage_decision(used: Column, limit: int = LIMIT_BYTES) -> Column:
    """struct(percent, warn, stop) of used bytes."""
    percent = F.coalesce(used, F.lit(0)) * 100.0 / limit
    return F.struct(percent.alias("percent"), (percent >= WARN_PERCENT).alias("warn"), (percent >= STOP_PERCENT).alias("stop"))


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a path, whatever file system it is on; 0 where it isn't there or can't be read."""
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        return int(place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength())
    except Exception:  # noqa: BLE001 - a probe never stops a run
        return 0


def guard_storage(spark: SparkSession, path: str, limit: int = LIMIT_BYTES) -> None:
    """Refuse to go on, before anything is written, where the storage is nearly full."""
    used = stored_bytes(spark, path)
    if used * 100.0 / limit >= STOP_PERCENT:
        raise RuntimeError(f"{used} of {limit} bytes used")


def wanted_workers(backlog: Column) -> Column:
    return F.greatest(F.lit(LEAST_WORKERS), F.least(F.lit(MOST_WORKERS), F.ceil(backlog / PER_WORKER))).cast("int")


def failing(runs: DataFrame, threshold: int = FAILING) -> DataFrame:
    """(source_id, now_failing) of sources with at least `threshold` failures in a row by now, worst first.

    runs: (source_id, checked_at, observation_id, consecutive_failures)."""
    now = runs.groupBy("source_id").agg(F.max_by("consecutive_failures", F.struct("checked_at", "observation_id")).alias("now_failing"))
    return now.where(F.col("now_failing") >= threshold).orderBy(F.desc("now_failing"), "source_id")


def queue_batch(pending: DataFrame, bodies: DataFrame, size: int = 5) -> DataFrame:
    """(id) of the oldest `size` pending rows that have a body: a semi-join and a top-k."""
    return pending.join(bodies.select(F.col("raw_article_id").alias("id")), "id", "left_semi").orderBy("id").limit(size).select("id")


def run_ledger(events: DataFrame, most_errors: int = 20) -> DataFrame:
    """(run_id, started_at, finished_at, status, counters..., errors) from start and end events of runs.

    events: (run_id, kind, at, entries_seen, entries_new, error); kind is `start`, `end` or `error`. A run without an
    end is `running`; with errors it is `partial`. The first `most_errors` errors are kept, in order of time."""
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    errors = F.array_sort(F.collect_list(F.when(F.col("kind") == "error", F.struct("at", "error"))))
    out = events.groupBy("run_id").agg(
        F.min(F.when(F.col("kind") == "start", F.col("at"))).alias("started_at"), of("end", "at").alias("finished_at"), F.coalesce(of("end", "entries_seen"), F.lit(0)).alias("entries_seen"), F.coalesce(of("end", "entries_new"), F.lit(0)).alias("entries_new"),
        F.count_if(F.col("kind") == "error").alias("failures"), F.transform(F.slice(errors, 1, most_errors), lambda e: e["error"]).alias("errors"),
    )
    status = F.when(F.col("finished_at").isNull(), "running").when(F.col("failures") > 0, "partial").otherwise("success")
    return out.select("run_id", "started_at", "finished_at", status.alias("status"), "entries_seen", "entries_new", "failures", "errors")


def worker_counters(outcomes: DataFrame) -> DataFrame:
    """(claimed, summarized, failed, skipped) of what workers took, from its outcomes (outcome: DONE, FAILED, SKIPPED or null)."""
    of = lambda name, value: F.count_if(F.col("outcome") == value).alias(name)
    return outcomes.agg(F.count("*").alias("claimed"), of("summarized", "DONE"), of("failed", "FAILED"), of("skipped", "SKIPPED"))


def header_cache(answers: DataFrame) -> DataFrame:
    """(url, etag, last_modified) to ask with next: those of the newest answer that had a body. answers: (url, at, status, etag, last_modified)."""
    good = answers.where("status = 200 and (etag is not null or last_modified is not null)")
    return good.groupBy("url").agg(F.max_by(F.struct("etag", "last_modified"), "at").alias("h")).select("url", "h.etag", "h.last_modified")
