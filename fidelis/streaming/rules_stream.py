"""Row rules on a stream.

Rules are stateless projections (one array column + explode), so the batch plan
runs unchanged on a streaming DataFrame.  ``windowed_failure_counts`` adds the one
stateful piece: failures per rule per event-time window, bounded by a watermark so
state is dropped once a window can no longer change.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis.operators import rules as R
from fidelis.session import checkpoint_dir


def stream_failures(stream: DataFrame, rules: list[R.Rule], id_col: str) -> DataFrame:
    """Streaming failure rows ``(id, rule_name, description, severity, actual_value)``."""
    return R.rule_failures(stream, rules, id_col)


def windowed_failure_counts(stream: DataFrame, rules: list[R.Rule], id_col: str, event_time: str,
                            window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Failures per rule and event-time window; emit in append mode after the watermark."""
    clean = R.clean_frame(stream)
    viol = R.violations_column(clean, rules)
    exploded = clean.withWatermark(event_time, watermark).select(
        F.col(event_time), F.explode(viol).alias("v"))
    return exploded.groupBy(F.window(event_time, window).alias("window"), F.col("v.rule_name").alias("rule_name")).agg(
        F.count(F.lit(1)).alias("failures"))


def run_to_table(spark: SparkSession, stream_out: DataFrame, mode: str = "append") -> DataFrame:
    """Drive a finite stream to completion (``availableNow``) into a parquet table in the shared
    checkpoint folder and return that table as a batch DataFrame.

    Each micro-batch is written by ``foreachBatch`` (one folder per epoch, or the whole result
    rewritten in ``complete`` mode), so results never pass through the driver and a replayed
    batch overwrites its own output; the stream's checkpoint sits next to the table."""
    name = f"fidelis_stream_{uuid.uuid4().hex[:12]}"
    base = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    table_path, ckpt = f"{base}/table", f"{base}/checkpoint"

    def write_batch(batch: DataFrame, epoch: int) -> None:
        # idempotent under batch replays: each epoch owns its folder (append mode), or the
        # whole result is rewritten (complete / update mode)
        if mode == "append":
            batch.write.mode("overwrite").parquet(f"{table_path}/batch={epoch}")
        else:
            batch.write.mode("overwrite").parquet(table_path)

    q = (stream_out.writeStream.outputMode(mode).foreachBatch(write_batch)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    try:
        out = spark.read.parquet(table_path)
        return out.drop("batch") if "batch" in out.columns else out
    except Exception:  # noqa: BLE001 - the stream produced no batch with rows
        return spark.createDataFrame([], stream_out.schema)


def parquet_stream(spark: SparkSession, directory: str, file_name: str, schema: T.StructType,
                   max_files_per_trigger: int = 1) -> DataFrame:
    """A file stream over one table of a folder (``pathGlobFilter``), with an explicit schema."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", file_name)
            .option("maxFilesPerTrigger", max_files_per_trigger).parquet(directory))
