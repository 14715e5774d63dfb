"""The domain's functions for SQL: plain expressions, so the optimizer sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from verdictlake.functions import enums as E


def _cases(column: str, table: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


def register(spark: SparkSession) -> None:
    """Make ``status_code(s)``, ``language_of(ext)`` and ``group_of(letter)`` known to the session."""
    groups = dict(zip(E.LETTERS, E.GROUPS, strict=True))
    for name, body in (("status_code", _cases("s", E.STATUS_CODES, f"'{E.OTHER}'")), ("language_of", _cases("s", E.LANGUAGES, f"'{E.OTHER}'")), ("group_of", _cases("s", groups, "s"))):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS STRING RETURN {body}")
