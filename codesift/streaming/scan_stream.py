"""Streaming scan (S10): files or rows arrive, findings are appended.

The scan is stateless, so the streaming plan is the batch plan: no state
store, no watermark. Exactly-once output comes from the sink's checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.scan import scan


def stream_findings(spark: SparkSession, source_dir: str, schema: StructType, text_col: str = "code",
                    id_cols: Sequence[str] = ("file",), fmt: str = "parquet", max_files_per_trigger: int | None = None,
                    **scan_args) -> DataFrame:
    """A streaming DataFrame of findings over files arriving in `source_dir`."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return scan(reader.load(source_dir), text_col, id_cols, **scan_args)


def start_findings_stream(findings: DataFrame, sink_dir: str, checkpoint_dir: str, fmt: str = "parquet",
                          trigger_once: bool = False):
    """Append findings to `sink_dir`; `checkpoint_dir` must be on shared storage."""
    w = (findings.writeStream.format(fmt).outputMode("append")
         .option("path", sink_dir).option("checkpointLocation", checkpoint_dir))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def stream_table_findings(spark: SparkSession, sf_dir: str, table: str, text_col: str,
                          id_cols: Sequence[str]) -> DataFrame:
    """Run the streaming scan over one table (a file, or a folder of part files)
    to completion and return the appended findings (read back from the sink).

    Sink and stream checkpoint live in a fresh folder under the shared
    checkpoint directory, so a restarted query resumes exactly once.
    """
    import uuid

    from ..session import checkpoint_dir

    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{table}-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").schema
    src = (spark.readStream.format("parquet").schema(schema)
           # a pattern that only the table matches: a plain path would have to be a folder
           .load(f"{sf_dir.rstrip('/')}/[{table[0]}]{table[1:]}.parquet"))
    q = start_findings_stream(scan(src, text_col, id_cols), f"{base}/out", f"{base}/ckpt", trigger_once=True)
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.select(*id_cols, "kind", "domain", "rule_id", "severity", "message", "line", "rule_seq")
