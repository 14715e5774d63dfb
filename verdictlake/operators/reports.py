"""Second-level reports over the result tables: matrices, shares and comparisons.

Every pivot names its columns, so it needs no pass to find them; cells without rows are zero unless a
report says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdictlake.functions import enums as E
from verdictlake.functions.exprs import lookup, place, rounded, share, share_within


def matrix(rows: DataFrame, by: list[str], column: str, values: list[str], cell: Column, fill: bool = True) -> DataFrame:
    """One row for each ``by``, one column for each of ``values``."""
    out = rows.groupBy(*by).pivot(column, values).agg(cell)
    return out.fillna(0, values) if fill else out


def status_matrix(status_dist: DataFrame) -> DataFrame:
    """Verdict shares by level."""
    return matrix(status_dist, ["difficulty"], "status_code", E.STATUS_ORDER, F.max("pct"))


def group_status_matrix(status_by_group: DataFrame, status: str) -> DataFrame:
    """Share of one verdict by level and group; combinations that never occur are null."""
    return matrix(status_by_group.where(F.col("status_code") == status), ["difficulty"], "proficiency_group", E.GROUPS, F.max("pct"), fill=False)


def counts_wide(status_by_group: DataFrame) -> DataFrame:
    """Counts of each verdict by level and group, their total and the share of AC; groups that solved something only."""
    wide = matrix(status_by_group, ["difficulty", "proficiency_group"], "status_code", E.STATUS_ORDER, F.sum("n_submissions"))
    total = sum((F.col(c) for c in E.STATUS_ORDER[1:]), F.col(E.ACCEPTED))
    return wide.withColumn("total", total).where(F.col(E.ACCEPTED) > 0).withColumn("ac_pct", share(F.col(E.ACCEPTED), F.col("total"), 1))


def reject_share(status_dist: DataFrame) -> DataFrame:
    """Verdicts among rejected submissions by level, as a matrix of counts' shares."""
    failed = status_dist.where(F.col("status_code") != E.ACCEPTED).withColumn("share", share_within("n_submissions", ["difficulty"]))
    return matrix(failed, ["difficulty"], "status_code", E.STATUS_ORDER[1:], F.max("share"))


def ac_by_level(status_dist: DataFrame) -> DataFrame:
    """Acceptance by level against the published rates."""
    known = lookup(F.col("difficulty"), {k: str(v) for k, v in E.PUBLISHED_AC.items()}).cast("double")
    ours = status_dist.where(F.col("status_code") == E.ACCEPTED).select("difficulty", "pct", known.alias("published_pct"))
    return ours.withColumn("diff", rounded(F.col("pct") - F.col("published_pct")))


def level_group_status(status_by_group: DataFrame, level: str = "A") -> DataFrame:
    """Verdict shares by group on one level."""
    return matrix(status_by_group.where(F.col("difficulty") == level), ["proficiency_group"], "status_code", E.STATUS_ORDER, F.max("pct"))


def language_matrix(language_dist: DataFrame, by: str = "difficulty") -> DataFrame:
    return matrix(language_dist, [by], "language", E.LANGUAGE_ORDER, F.max("pct"))


def language_status_matrix(status_by_language: DataFrame, status: str) -> DataFrame:
    """Share of one verdict by language and level."""
    return matrix(status_by_language.where(F.col("status_code") == status), ["language"], "difficulty", E.LETTERS, F.max("pct"))


def language_totals(language_dist: DataFrame) -> DataFrame:
    """Submissions by language over all levels, in presentation order."""
    summed = language_dist.groupBy("language").agg(F.sum("n_submissions").alias("n_submissions"))
    return summed.orderBy(place(F.col("language"), E.LANGUAGE_ORDER))


def level_by_language(status_by_language: DataFrame, level: str = "A", status: str = E.ACCEPTED) -> DataFrame:
    """Share of one verdict on one level by language, in presentation order."""
    return status_by_language.where((F.col("difficulty") == level) & (F.col("status_code") == status)).select("language", "pct").orderBy(place(F.col("language"), E.LANGUAGE_ORDER))


def resolution_matrix(by_group: DataFrame, metric: str) -> DataFrame:
    """One metric by level and group; empty cells stay null."""
    return matrix(by_group, ["difficulty"], "proficiency_group", E.GROUPS, F.max(metric), fill=False)


def level_resolution(by_group: DataFrame, level: str = "A") -> DataFrame:
    """Resolution and first-try rates by group on one level."""
    return by_group.where(F.col("difficulty") == level).select("proficiency_group", "resolution_rate", "first_try_rate")


def level_error_resolution(by_first_error_group: DataFrame, level: str = "D", error: str = "WA") -> DataFrame:
    """Resolution and mean attempts by group on one level after one first error."""
    chosen = by_first_error_group.where((F.col("difficulty") == level) & (F.col("first_error_type") == error))
    return chosen.select("proficiency_group", "resolution_rate", "avg_attempts_to_ac")


def first_error_share(by_first_error: DataFrame) -> DataFrame:
    """First errors by level: pairs and share, without ``Other``."""
    told = by_first_error.where(F.col("first_error_type") != E.OTHER).select("difficulty", "first_error_type", "n_pairs")
    return told.withColumn("pct", share_within("n_pairs", ["difficulty"]))


def first_error_matrix(by_first_error: DataFrame, metric: str) -> DataFrame:
    """One metric by level and first error, without ``Other``."""
    return matrix(by_first_error, ["difficulty"], "first_error_type", E.ERROR_ORDER[:-1], F.max(metric), fill=False)


def first_error_group_masked(by_first_error_group: DataFrame, metric: str = "resolution_rate") -> DataFrame:
    """One metric by level, first error and group; cells that cannot hold a solution (rate 0, no mean) are null."""
    impossible = (F.col("resolution_rate") == 0) & F.col("avg_attempts_to_ac").isNull()
    shown = by_first_error_group.where(F.col("first_error_type") != E.OTHER).withColumn("shown", F.when(~impossible, F.col(metric)))
    return matrix(shown, ["difficulty", "first_error_type"], "proficiency_group", E.GROUPS, F.max("shown"), fill=False)


def slice_totals(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of each slice of the path table and its share of all."""
    summed = paths.groupBy(*keys).agg(F.sum("n_pairs").alias("n_pairs"))
    return summed.withColumn("pct", share(F.col("n_pairs"), F.sum("n_pairs").over(Window.partitionBy())))
