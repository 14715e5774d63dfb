"""Difficulty letters by position within the contest, and points from the statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdictlake.functions import enums as E
from verdictlake.functions.exprs import contest_of, score_in


def contests(problems: DataFrame, prefix: str = E.CONTEST_PREFIX) -> DataFrame:
    """The catalogue of one contest series, with the contest's name."""
    return problems.where(F.col("name").startswith(prefix)).withColumn("contest", contest_of(F.col("name")))


def label_problems(problems: DataFrame, prefix: str = E.CONTEST_PREFIX, order: str = "source_pos") -> DataFrame:
    """First six problems of each contest as A to F: problem_id, contest, difficulty, then the catalogue's columns."""
    at = F.row_number().over(Window.partitionBy("contest").orderBy(order, "id"))
    ranked = contests(problems, prefix).withColumn("__at", at).where(F.col("__at") <= len(E.LETTERS))
    letter = F.element_at(F.array(*map(F.lit, E.LETTERS)), F.col("__at"))
    rest = [c for c in problems.columns if c not in ("id", order)]
    return ranked.select(F.col("id").alias("problem_id"), "contest", letter.alias("difficulty"), *rest)


def letter_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("difficulty").agg(F.count("*").alias("n_problems"))


def contest_sizes(problems: DataFrame, prefix: str = E.CONTEST_PREFIX) -> DataFrame:
    """How many contests have how many problems."""
    sizes = contests(problems, prefix).groupBy("contest").agg(F.count("*").alias("n_problems"))
    return sizes.groupBy("n_problems").agg(F.count("*").alias("n_contests"))


def extract_scores(statements: DataFrame) -> DataFrame:
    """(problem_id, score) of the statements that name their points; typed even if there are none."""
    return statements.select("problem_id", score_in(F.col("html")).alias("score")).where("score is not null")


def score_coverage(targeted: DataFrame, statements: DataFrame) -> DataFrame:
    """Counters of the extraction: problems asked for, statements found, points read, found without points."""
    found = targeted.select("problem_id").distinct().join(statements.select("problem_id", score_in(F.col("html")).alias("score"), F.lit(1).alias("f")), "problem_id", "left")
    return found.agg(
        F.count("*").alias("n_targeted"), F.count("f").alias("n_found"), F.count("score").alias("n_scores"), F.count_if(F.col("f").isNotNull() & F.col("score").isNull()).alias("n_without")
    )


def with_scores(labels: DataFrame, scores: DataFrame) -> DataFrame:
    return labels.join(scores, "problem_id", "left")
