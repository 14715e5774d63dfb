"""Submissions as a stream: verdict counts per level and window, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.functions.exprs import status_code


def submission_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Submission files (Parquet) as they arrive in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_status_counts(submissions: DataFrame, labels: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts of verdicts by window and level; works alike on a stream and on a table.

    The stream is joined to the static labels and counted; state is dropped once the watermark passes a window.
    """
    timed = submissions.withColumn("at", F.col("date").cast("timestamp"))
    if submissions.isStreaming:
        timed = timed.withWatermark("at", late)
    joined = timed.join(labels.select("problem_id", "difficulty"), "problem_id")
    counts = joined.groupBy(F.window("at", window), "difficulty", status_code(F.col("status")).alias("status_code")).agg(F.count("*").alias("n_submissions"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "difficulty", "status_code", "n_submissions")
