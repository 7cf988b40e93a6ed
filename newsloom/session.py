"""Session defaults and small helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings sources countries "
    "country_aliases languages mix_targets pack_specs raw_articles cleaned_articles article_embeddings"
).split()


def build_session(app: str = "newsloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is tuned for; `conf` overrides any of them."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults["spark.cleaner.referenceTracking.cleanCheckpoints"] = "true"
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small(df: DataFrame, most_rows: int = 100_000) -> bool:
    """Whether a frame has at most `most_rows` rows; counts no further."""
    return df.limit(most_rows + 1).count() <= most_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a local one only where that is unset in local mode, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "newsloom-checkpoints")
        os.makedirs(root, exist_ok=True)
        root = f"file://{root}"
    return root


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder; a folder made for it here goes when the program ends."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
        atexit.register(_remove, spark, spark.sparkContext._jsc.sc().getCheckpointDir().get())
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as a compressed table in the shared folder and read from there; removed when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.parquet(path)


def discarded(df: DataFrame) -> None:
    """Remove the files of a table made by `written`; nothing may read it afterwards."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        _remove(df.sparkSession, folder)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001 - the session may be gone by then
        pass
