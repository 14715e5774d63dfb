"""The star-schema test tables seen as a catalogue and a submission log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.functions import enums as E

# How event types stand for verdicts; ``signup`` stays unknown on purpose.
EVENT_STATUS = {"purchase": "Accepted", "click": "Wrong Answer", "view": "Time Limit Exceeded", "error": "Runtime Error"}
EXTENSIONS = ["cpp", "py", "java", "c", "rb", "cs", "rs", "go", "hs"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue: brands are contests, parts are problems in the order of their keys."""
    name = F.concat(F.lit(E.CONTEST_PREFIX + " "), F.col("p_brand"), F.lit(" - "), F.col("p_name"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), name.alias("name"), F.col("p_partkey").alias("source_pos"))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submission log: events of users on the problem their properties name."""
    status = F.coalesce(F.create_map(*[F.lit(x) for kv in EVENT_STATUS.items() for x in kv])[F.col("event_type")], F.col("event_type"))
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), F.pmod("event_id", F.lit(len(EXTENSIONS))).cast("int") + 1)
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("submission_id"),
        F.get_json_object("props", "$.k").alias("problem_id"),
        "user_id",
        F.col("ts").alias("date"),
        status.alias("status"),
        ext.alias("filename_ext"),
    )
