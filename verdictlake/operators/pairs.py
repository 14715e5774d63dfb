"""Statistics of each (user, problem) pair, and the resolution reports over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdictlake.functions import enums as E
from verdictlake.functions.exprs import rounded, share

PAIR = ("user_id", "problem_id")


def attempts(fact: DataFrame) -> DataFrame:
    """Submissions numbered within their pair by date; equal dates are ordered by ``submission_id``."""
    order = Window.partitionBy(*PAIR).orderBy("date", "submission_id")
    return fact.withColumn("attempt", F.row_number().over(order))


def pair_stats(fact: DataFrame) -> DataFrame:
    """One row a pair. Window and aggregation share the pair's partitioning, so the log is shuffled once."""
    accepted = F.col("status_code") == E.ACCEPTED
    first = F.max(F.when(F.col("attempt") == 1, F.col("status_code")))
    return (
        attempts(fact)
        .groupBy(*PAIR, "difficulty")
        .agg(
            F.bool_or(accepted).alias("is_resolved"),
            F.count("*").alias("total_attempts"),
            (first == E.ACCEPTED).alias("first_try_ac"),
            first.alias("first_error_type"),
            F.min(F.when(accepted, F.col("attempt"))).alias("attempts_to_ac"),
        )
    )


def resolution(pairs: DataFrame, keys: list[str], first_try: bool) -> DataFrame:
    """Pairs, mean attempts of resolved ones (null if none), and rates in per cent, by ``keys``."""
    n, solved = F.count("*"), F.count_if("is_resolved")
    columns = [
        n.alias("n_pairs"),
        rounded(F.avg(F.when(F.col("is_resolved"), F.col("attempts_to_ac")))).alias("avg_attempts_to_ac"),
        share(solved, n).alias("resolution_rate"),
        share(n - solved, n).alias("abandon_rate"),
    ]
    if first_try:
        columns.append(share(F.count_if("first_try_ac"), n).alias("first_try_rate"))
    return pairs.groupBy(*keys).agg(*columns).orderBy(*keys)


def resolution_by_level(pairs: DataFrame) -> DataFrame:
    return resolution(pairs, ["difficulty"], True)


def resolution_by_group(pairs: DataFrame, users: DataFrame) -> DataFrame:
    return resolution(pairs.join(users, "user_id"), ["difficulty", "proficiency_group"], True)


def resolution_by_first_error(pairs: DataFrame) -> DataFrame:
    """Pairs whose first attempt failed."""
    return resolution(pairs.where(F.col("first_error_type") != E.ACCEPTED), ["difficulty", "first_error_type"], False)


def resolution_by_first_error_group(pairs: DataFrame, users: DataFrame) -> DataFrame:
    failed = pairs.where(F.col("first_error_type") != E.ACCEPTED).join(users, "user_id")
    return resolution(failed, ["difficulty", "proficiency_group", "first_error_type"], False)
