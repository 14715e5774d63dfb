"""Explicit schemas: no inference pass over the files, and no drift between them."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k, True) for n, k in kinds.items()])


_S, _L = T.StringType(), T.LongType()
PROBLEMS = _struct(id=_S, name=_S, dataset=_S, time_limit=_L, memory_limit=_L, rating=_S, tags=_S, complexity=_S)
SUBMISSIONS = _struct(
    submission_id=_S, problem_id=_S, user_id=_S, date=_S, language=_S, original_language=_S, filename_ext=_S, status=_S, cpu_time=_L, memory=_L, code_size=_L, accuracy=_S
)
SCORES = _struct(problem_id=_S, score=T.IntegerType())
