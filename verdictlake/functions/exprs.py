"""Column expressions of the domain; all of them are built-in functions, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdictlake.functions import enums as E


def lookup(c: Column, table: Mapping[str, str]) -> Column:
    """The table's value, null where the key is missing or null."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def status_code(c: Column) -> Column:
    """Short verdict; unknown and null verdicts are ``Other``."""
    return F.coalesce(lookup(c, E.STATUS_CODES), F.lit(E.OTHER))


def language_of(c: Column) -> Column:
    """Language of a file extension, case kept; unknown and null ones are ``Other``."""
    return F.coalesce(lookup(c, E.LANGUAGES), F.lit(E.OTHER))


def group_of(letter: Column) -> Column:
    """Proficiency group of the hardest letter solved; null and unknown letters pass through."""
    return F.coalesce(lookup(letter, dict(zip(E.LETTERS, E.GROUPS, strict=True))), letter)


def rounded(c: Column, digits: int = 2) -> Column:
    """Half-even rounding of the binary value: the same IEEE steps in every engine (not of its decimal text)."""
    scale = 10**digits
    return F.rint(c * scale) / scale


def share(part: Column, whole: Column, digits: int | None = 2) -> Column:
    """Per cent, in the order of operations that the results are compared under."""
    value = part / whole * 100
    return value if digits is None else rounded(value, digits)


def share_within(n: str, prefix: Iterable[str], digits: int = 2) -> Column:
    """Per cent of ``n`` in the total of its ``prefix`` group: a window over counts instead of a self-join."""
    return share(F.col(n), F.sum(n).over(Window.partitionBy(*prefix)), digits)


def place(c: Column, order: list[str]) -> Column:
    """Sort key of a presentation order; what it lacks comes last."""
    at = F.array_position(F.array(*map(F.lit, order)), c)
    return F.when(at > 0, at).otherwise(F.lit(len(order) + 1))


def contest_of(name: Column) -> Column:
    """Text before the last " - "; the whole name if there is none."""
    return F.regexp_replace(name, r"(?s)^(.*) - .*$", "$1")


def score_in(html: Column) -> Column:
    """Points of a problem statement: digits of the first ``var`` after a score label, in either language."""
    digits = F.regexp_extract(html, r"(?isU)(?:Score|配点).*?<var>(\d+)</var>", 1)
    plain = F.translate(digits, "０１２３４５６７８９", "0123456789")
    return F.nullif(plain, F.lit("")).try_cast("int")


def error_combination(path: Column) -> Column:
    """Distinct errors of a path in canonical order, without ``AC`` and ``Other``; null if none is left."""
    steps = F.split(path, E.ARROW)
    known = F.filter(F.array(*map(F.lit, E.COMBINATION_ORDER)), lambda e: F.array_contains(steps, e))
    return F.nullif(F.array_join(known, ", "), F.lit(""))


def arrows(path: Column) -> Column:
    """Number of steps from one attempt to the next."""
    return F.size(F.split(path, E.ARROW)) - 1
