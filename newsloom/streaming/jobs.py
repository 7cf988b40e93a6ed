"""Streaming forms of ingest, failure breaking and admission."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.functions.urls import canonical_url, url_key
from newsloom.operators.ingest import first_of_each, unseen
from newsloom.sources.feeds import parse_feeds

STORED = "url_key string, canonical_url string, title string, summary string, published string, feed string"


def ingest_stream(spark: SparkSession, landing: str, out: str, checkpoint: str, whole: bool = True) -> StreamingQuery:
    """Feed files that land in a folder become new articles, each key once. A file is a document, or each of its lines
    is (whole=False).

    A micro-batch is parsed, reduced to the first entry of each key and appended without the keys already stored. The
    store is partitioned by the beginning of the key, and only partitions that the batch has keys of are read, their
    key column alone. A batch that is run again after a failure finds its own keys stored and adds nothing.
    """
    documents = spark.readStream.format("text").option("wholetext", str(whole).lower()).load(landing).select(F.col("_metadata.file_path").alias("name"), "value")

    def append(batch: DataFrame, _: int) -> None:
        rows = parse_feeds(batch, "name", "value").where("trim(url) <> ''")
        rows = rows.select(url_key(F.col("url")).alias("url_key"), canonical_url(F.col("url")).alias("canonical_url"), "title", "summary", "published", "feed", "entry_no")
        first = first_of_each(rows, "url_key", ["feed", "entry_no"]).drop("entry_no").withColumn("prefix", F.left("url_key", F.lit(2))).persist()
        session = batch.sparkSession
        touched = [r[0] for r in first.select("prefix").distinct().collect()]  # two hexadecimal digits: 256 at most
        if touched:
            stored = session.read.schema(f"{STORED}, prefix string").parquet(out).where(F.col("prefix").isin(touched)) if _exists(session, out) else session.createDataFrame([], STORED)
            unseen(first, stored, "url_key").select(*[c.split()[0] for c in STORED.split(", ")], "prefix").write.partitionBy("prefix").mode("append").parquet(out)
        first.unpersist()

    return documents.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stop_gracefully(query: StreamingQuery, wait_s: float = 10.0) -> None:
    """Let a query finish what it has at hand, then stop it; what wasn't committed is read again next time."""
    if query.isActive:
        query.processAllAvailable() if wait_s is None else query.awaitTermination(wait_s)
    query.stop()


def work_queue(spark: SparkSession, pending: str, schema: str, handle: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "id", files: int = 1) -> StreamingQuery:
    """A queue of work over a folder of pending rows: each row is handled once, `files` files at a time, oldest first.

    The stream's checkpoint takes the place of row locks: what a batch was given is given to no other, and a batch that
    failed is given again. Handled rows are appended under their batch; a batch that is given again replaces what it wrote."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("latestFirst", "false").parquet(pending)

    def work(batch: DataFrame, number: int) -> None:
        handle(batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def breaker_stream(observations: DataFrame, warn: int = 3, trip: int = 6) -> DataFrame:
    """(source_id, observation_id, consecutive_failures, warn, trips) for a stream of (source_id, observation_id, checked_at, failed).

    One counter for each source is the whole state; a success sets it to zero.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["checked_at", "observation_id"])
        out = []
        for ident, failed in zip(rows["observation_id"], rows["failed"]):
            count = count + 1 if failed else 0
            out.append((key[0], ident, count, count >= warn, count >= trip))
        state.update((count,))
        yield pd.DataFrame(out, columns=["source_id", "observation_id", "consecutive_failures", "warn", "trips"])

    schema = "source_id long, observation_id long, consecutive_failures long, warn boolean, trips boolean"
    return observations.groupBy("source_id").applyInPandasWithState(step, schema, "n long", "append", GroupStateTimeout.NoTimeout)


def admission_stream(events: DataFrame, rate: int = 60, window_s: float = 60.0) -> DataFrame:
    """(client, event_id, accepted) for a stream of (client, event_id, ts); the state is the accepted times of one window."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = deque(state.get[0] if state.exists else ())
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for ident, ts in zip(rows["event_id"], rows["ts"]):
            t = pd.Timestamp(ts).timestamp()
            while kept and kept[0] <= t - window_s:
                kept.popleft()
            ok = len(kept) < rate
            if ok:
                kept.append(t)
            out.append((key[0], ident, ok))
        state.update((list(kept),))
        yield pd.DataFrame(out, columns=["client", "event_id", "accepted"])

    return events.groupBy("client").applyInPandasWithState(step, "client string, event_id long, accepted boolean", "times array<double>", "append", GroupStateTimeout.NoTimeout)
