"""Row-local sequence metrics on a stream of logprob files.

M1-M8 are expressions over one row, so the batch code runs unchanged on a
streaming DataFrame: new logprob files arriving in a folder are decoded,
filtered to ok rows and scored (append mode, no state). The sink is the
caller's; :func:`write_scores_stream` writes parquet with a checkpoint in the
shared checkpoint folder, so a restarted query resumes exactly once.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import metrics as M
from tessera.functions.steps import decode_prompt_steps, steps_valid

LOGPROBS_SCHEMA = T.StructType([
    T.StructField("eval_id", T.LongType()), T.StructField("passage_id", T.StringType()),
    T.StructField("label", T.IntegerType()), T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()), T.StructField("prompt_logprob", T.StringType()),
    T.StructField("prefix_length", T.IntegerType()), T.StructField("ok", T.BooleanType()),
    T.StructField("error", T.StringType()),
])


def read_logprobs_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Logprob parquet files (reference layout) as a stream."""
    return (
        spark.readStream.schema(LOGPROBS_SCHEMA)
        .option("maxFilesPerTrigger", max_files)
        .parquet(path)
    )


def sequence_scores(rows: DataFrame) -> DataFrame:
    """ok rows -> ``eval_id, label, ppl, cme, inv_ppl, inv_cme, steps_ok``;
    the same expressions as the batch queries."""
    d = rows.where(F.col("ok")).withColumn("steps", decode_prompt_steps(F.col("prompt_logprob")))
    d = d.select(
        "eval_id", "label", steps_valid(F.col("steps")).alias("steps_ok"),
        M.sequence_ppl(F.col("steps"), F.col("prefix_length")).alias("ppl"),
        M.sequence_cme(F.col("steps"), F.col("prefix_length")).alias("cme"),
    )
    return d.withColumn("inv_ppl", M.invert_ppl(F.col("ppl"))).withColumn(
        "inv_cme", M.invert_entropy(F.col("cme"))
    )


def write_scores_stream(scores: DataFrame, out_path: str, name: str = "sequence_scores"):
    """Start the query: parquet sink, checkpoint under spark.checkpoint.dir."""
    spark = scores.sparkSession
    from tessera.session import ensure_checkpoint_dir

    ckpt = os.path.join(ensure_checkpoint_dir(spark), "streams", name)
    return (
        scores.writeStream.format("parquet").option("path", out_path)
        .option("checkpointLocation", ckpt).outputMode("append").start()
    )
