"""The whole batch: catalogue and submission log in, labelled problems, profiles and ten reports out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from verdictlake.operators import distributions as D
from verdictlake.operators import labels as L
from verdictlake.operators import pairs as P
from verdictlake.operators import paths, profiles
from verdictlake.operators.fact import fact
from verdictlake.sources.sinks import write_report


@dataclass(frozen=True)
class Inputs:
    """``problems`` needs id, name and source_pos; ``submissions`` problem_id, user_id, date, submission_id, status, filename_ext."""

    problems: DataFrame
    submissions: DataFrame
    statements: DataFrame | None = None


def run_all(inputs: Inputs) -> dict[str, DataFrame]:
    """All result tables by name. The log is scanned once for pairs, whose table feeds four reports, and once each, with and without
    groups, for the counts that the five distributions are summed from. ``release`` frees what is kept for this."""
    labels = L.label_problems(inputs.problems)
    if inputs.statements is not None:
        labels = L.with_scores(labels, L.extract_scores(inputs.statements))
    labels = labels.persist(StorageLevel.MEMORY_AND_DISK)
    found = profiles.user_profiles(inputs.submissions, labels).persist(StorageLevel.MEMORY_AND_DISK)
    users = profiles.classified(found)
    rows = fact(inputs.submissions, labels)
    cohort = fact(inputs.submissions, labels, users)
    counts = D.submission_counts(rows).persist(StorageLevel.MEMORY_AND_DISK)
    group_counts = D.submission_counts(cohort, "proficiency_group").persist(StorageLevel.MEMORY_AND_DISK)
    stats = P.pair_stats(rows).persist(StorageLevel.MEMORY_AND_DISK)
    return {
        "problems_labeled": labels,
        "user_profiles": found,
        "group_summary": profiles.group_summary(found),
        "error_distribution": D.status_distribution(counts),
        "error_by_group_difficulty": D.status_by_group(group_counts),
        "language_distribution": D.language_distribution(counts),
        "language_by_group": D.language_by_group(group_counts),
        "error_by_language": D.status_by_language(counts),
        "resolution_by_difficulty": P.resolution_by_level(stats),
        "resolution_by_group": P.resolution_by_group(stats, users),
        "resolution_by_first_error": P.resolution_by_first_error(stats),
        "resolution_by_first_error_group": P.resolution_by_first_error_group(stats, users),
        "error_sequences": paths.error_paths(rows),
    }


def release(spark: SparkSession) -> None:
    """Free the frames that ``run_all`` keeps, once its tables are written."""
    spark.catalog.clearCache()


def write_all(tables: dict[str, DataFrame], folder: str, kind: str = "csv") -> None:
    """Each table under its name; the two that grow with the data keep their partitions."""
    for name, df in tables.items():
        write_report(df, f"{folder.rstrip('/')}/{name}", kind, files=None if name in ("user_profiles", "error_sequences") else 1)
