"""Distributions of verdicts and languages: one generic operator and its five reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictlake.functions.exprs import share_within


def distribution(rows: DataFrame, keys: list[str], category: str) -> DataFrame:
    """Counts of ``category`` within ``keys`` and their share in per cent.

    Counts are combined before the one shuffle; the share is a window over the few counted rows.
    """
    n = F.sum("n_submissions") if "n_submissions" in rows.columns else F.count("*")
    counts = rows.groupBy(*keys, category).agg(n.alias("n_submissions"))
    return counts.withColumn("pct", share_within("n_submissions", keys))


def submission_counts(fact: DataFrame, *more: str) -> DataFrame:
    """Submissions by level, language, verdict and ``more``: a small table that any of the distributions may take as rows."""
    return fact.groupBy("difficulty", *more, "language", "status_code").agg(F.count("*").alias("n_submissions"))


def status_distribution(fact: DataFrame) -> DataFrame:
    """By level, all users."""
    return distribution(fact, ["difficulty"], "status_code").orderBy("difficulty", "status_code")


def status_by_group(cohort_fact: DataFrame) -> DataFrame:
    """By level and proficiency group, classified users."""
    return distribution(cohort_fact, ["difficulty", "proficiency_group"], "status_code").orderBy("difficulty", "proficiency_group", "status_code")


def language_distribution(fact: DataFrame) -> DataFrame:
    """By level, most used first."""
    return distribution(fact, ["difficulty"], "language").orderBy("difficulty", F.desc("n_submissions"), "language")


def language_by_group(cohort_fact: DataFrame) -> DataFrame:
    """By level and proficiency group, most used first."""
    return distribution(cohort_fact, ["difficulty", "proficiency_group"], "language").orderBy("difficulty", "proficiency_group", F.desc("n_submissions"), "language")


def status_by_language(fact: DataFrame) -> DataFrame:
    """By level and language, all users."""
    return distribution(fact, ["difficulty", "language"], "status_code").orderBy("difficulty", "language", "status_code")


def status_by_language_group(cohort_fact: DataFrame) -> DataFrame:
    """By level, language and proficiency group: an extension of the two reports above."""
    return distribution(cohort_fact, ["difficulty", "language", "proficiency_group"], "status_code").orderBy("difficulty", "language", "proficiency_group", "status_code")
