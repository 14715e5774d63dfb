"""Submissions joined to their labels: the frame that every report starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictlake.functions.exprs import language_of, status_code


def fact(submissions: DataFrame, labels: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Labelled submissions with verdict code and language; ``users`` restricts to a cohort and adds its group.

    Labels are a few rows a contest, so the optimizer broadcasts them by their size; the cohort grows
    with the data and is left to it too. Columns that a report does not use are pruned in the scan.
    """
    out = submissions.join(labels.select("problem_id", "difficulty"), "problem_id").withColumn("status_code", status_code(F.col("status")))
    if "filename_ext" in submissions.columns:
        out = out.withColumn("language", language_of(F.col("filename_ext")))
    return out if users is None else out.join(users, "user_id")
