"""Re-scan of changed texts (S10): a file that arrives again replaces its old findings.

Texts arrive on a stream, each with its ids and an order (a modification time, an offset). Every micro-batch keeps the
last text of each file, drops those whose content is the one last scanned, scans the others with the batch scan and
adds two folders to the store:

    findings/batch=N    the findings of the files that changed in batch N
    files/batch=N       (ids, content hash, gone) of these files, written after their findings

A file's findings are those of its last row in `files`; what earlier batches found for it no longer counts. A null text
means the file is gone: its findings go and none come. Nothing is rewritten, so a batch costs its own texts and one join
with the files' last states. A batch that runs again after a failure finds the same earlier batches and writes the same
folders, so restarts neither lose nor repeat findings.

`compact` writes the current state into a new store with one folder each. A stream over it starts with a fresh checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scan import FINDING_FIELDS, scan
from ..session import checkpoint_dir, materialize

#: The batch number of what a store begins with.
START = -1


def _schemas(texts: DataFrame, ids: Sequence[str]) -> tuple[T.StructType, T.StructType]:
    keys = [T.StructField(c, texts.schema[c].dataType) for c in ids]
    files = [*keys, T.StructField("hash", T.StringType()), T.StructField("gone", T.BooleanType())]
    return T.StructType(files), T.StructType([*keys, *FINDING_FIELDS])


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)


def _last(files: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The last state of each file: (ids, batch, hash, gone)."""
    state = files.groupBy(*ids).agg(F.max(F.struct("batch", "hash", "gone")).alias("_s"))
    return state.select(*ids, "_s.*")


def _same(ids: Sequence[str], a: str, b: str):
    out = F.lit(True)
    for c in ids:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def open_store(spark: SparkSession, store: str, texts: DataFrame, ids: Sequence[str]) -> None:
    """Make the folders of an empty store, if there are none yet."""
    for name, schema in zip(("files", "findings"), _schemas(texts, ids)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{store}/{name}/batch={START}")


def rescan_batch(store: str, text_col: str, ids: Sequence[str], order_col: str, **scan_args) -> Callable[[DataFrame, int], None]:
    """The body of `foreachBatch`."""
    ids = list(ids)

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        schemas = _schemas(batch, ids)
        arrived = batch.groupBy(*ids).agg(F.max(F.struct(F.col(order_col).alias("at"), F.col(text_col).alias("text"))).alias("_t"))
        text = F.col("_t.text")
        now = arrived.select(*ids, text.alias("text"), F.sha2(text, 256).alias("hash"), text.isNull().alias("gone"))
        before = _last(_read(spark, f"{store}/files", schemas[0]).where(F.col("batch") < n), ids)
        met = now.alias("a").join(before.alias("b"), _same(ids, "a", "b"), "left")
        # Of files that are new and gone at once nothing is written.
        differs = ~F.col("a.hash").eqNullSafe(F.col("b.hash"))
        changed = materialize(met.where(differs).select("a.*"))
        found = scan(changed, "text", ids, **scan_args)
        found.select(*schemas[1].fieldNames()).write.mode("overwrite").parquet(f"{store}/findings/batch={n}")
        changed.select(*schemas[0].fieldNames()).write.mode("overwrite").parquet(f"{store}/files/batch={n}")

    return run


def start_rescan_stream(texts: DataFrame, store: str, checkpoint: str, text_col: str = "code", id_cols: Sequence[str] = ("file",),
                        order_col: str = "arrived", trigger_once: bool = False, **scan_args):
    """Start scanning a stream of texts into `store`; store and checkpoint lie on shared storage."""
    spark = texts.sparkSession
    checkpoint_dir(spark)
    open_store(spark, store, texts, id_cols)
    w = texts.writeStream.foreachBatch(rescan_batch(store, text_col, id_cols, order_col, **scan_args)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if trigger_once else w).start()


def current_findings(spark: SparkSession, store: str, texts: DataFrame, id_cols: Sequence[str] = ("file",)) -> DataFrame:
    """The findings that hold now. `texts` gives the types of the ids (its rows are not read)."""
    ids = list(id_cols)
    files, findings = _schemas(texts, ids)
    last = _last(_read(spark, f"{store}/files", files), ids).where("NOT gone")
    rows = _read(spark, f"{store}/findings", findings)
    same = _same(ids, "f", "l") & (F.col("f.batch") == F.col("l.batch"))
    return rows.alias("f").join(last.alias("l"), same, "left_semi").drop("batch")


def compact(spark: SparkSession, store: str, target: str, texts: DataFrame, id_cols: Sequence[str] = ("file",)) -> None:
    """Write what holds now to a new store at `target`."""
    ids = list(id_cols)
    files, _ = _schemas(texts, ids)
    current_findings(spark, store, texts, ids).write.parquet(f"{target}/findings/batch={START}")
    _last(_read(spark, f"{store}/files", files), ids).where("NOT gone").drop("batch").write.parquet(f"{target}/files/batch={START}")


def rescanned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings after two arrivals of the `documents` table, the stream stopped and started between them.

    The second arrival repeats every third document unchanged, adds a line to every fifth and withdraws every seventh
    (the first of these that fits).
    """
    import uuid

    base = f"{checkpoint_dir(spark).rstrip('/')}/rescan-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", "text")
    first = docs.withColumn("arrived", F.lit(0).cast("long"))
    change = (
        F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("\neval(added);")))
    )
    second = docs.where("doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0").select("doc_id", change.alias("text"), F.lit(1).cast("long").alias("arrived"))
    for rows in (first, second):
        rows.write.mode("append").parquet(f"{base}/inbox")
        texts = spark.readStream.schema(first.schema).parquet(f"{base}/inbox")
        start_rescan_stream(texts, f"{base}/store", f"{base}/ckpt", "text", ["doc_id"], trigger_once=True).awaitTermination()
    return current_findings(spark, f"{base}/store", first, ["doc_id"])
