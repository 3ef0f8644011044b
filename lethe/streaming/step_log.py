"""Live epoch losses over a growing step log (A6, A7, E2 as a stream).

The benchmark shows the running loss of the current epoch while it
trains (a progress-bar postfix).  Here the training side appends step
rows (``lethe.schemas.STEP_LOG``) to a folder; a Structured Streaming
query keeps per (run, epoch, set) the step count, the loss sum and the
running mean, updated per micro-batch.  State is one row per epoch and
set, so it stays small however long the run is; the checkpoint lives in
the shared folder named by ``spark.checkpoint.dir``, so a restarted
query continues where it stopped.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lethe import schemas
from lethe.session import checkpoint_dir


def epoch_loss_stream(spark: SparkSession, log_dir: str, fmt: str = "parquet",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming aggregate ``run, epoch, set, n_steps, loss_sum,
    running_loss`` (forget rows with the ascent sign, as in A7)."""
    reader = spark.readStream.schema(schemas.STEP_LOG).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    steps = reader.load(log_dir)
    signed = F.when(F.col("set") == "forget", -F.col("loss")).otherwise(F.col("loss"))
    return (steps.groupBy("run", "epoch", "set")
            .agg(F.count(F.lit(1)).alias("n_steps"), F.sum(signed).alias("loss_sum"))
            .withColumn("running_loss", F.col("loss_sum") / F.col("n_steps")))


def start_epoch_loss_query(spark: SparkSession, log_dir: str, out_dir: str, name: str = "epoch_loss",
                           fmt: str = "parquet", trigger_seconds: int | None = None) -> StreamingQuery:
    """Run ``epoch_loss_stream`` and rewrite the small result table to
    ``out_dir`` after every micro-batch (complete mode through
    ``foreachBatch``: the table has one row per epoch and set)."""
    ckpt = os.path.join(checkpoint_dir(spark), "streams", name)

    def write(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out_dir)

    w = (epoch_loss_stream(spark, log_dir, fmt).writeStream.outputMode("complete")
         .option("checkpointLocation", ckpt).foreachBatch(write).queryName(name))
    if trigger_seconds:
        w = w.trigger(processingTime=f"{int(trigger_seconds)} seconds")
    return w.start()
