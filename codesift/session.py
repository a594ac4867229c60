"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "codesift") -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.codesift.scanPartitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from `spark.checkpoint.dir`.

    Nothing is written elsewhere: where the session names no folder this is an
    error, but for a session on one machine, whose temporary folder all its
    threads share.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="codesift-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return d


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df):
    """Cut lineage: write `df` to the shared checkpoint folder and read it back.

    For small intermediate tables that an iterative plan reuses several times
    (so the scan under them runs once). Never a machine-local cache.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, compression="snappy"):
    """Cut lineage: write `df` as Parquet to the shared checkpoint folder and read it back.

    For tables that are joined with themselves: a checkpointed frame carries statistics and constraints of the plan it
    came from, which the optimizer cannot always rename for the second copy.
    """
    import uuid

    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
