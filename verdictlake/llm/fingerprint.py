"""Document fingerprints: canonical text, 128 bits of xxhash, bytes compared inside equal buckets.

Everything here is DataFrame and SQL functions. Unicode work is done by the ICU library that ships
with Spark, called through ``reflect`` as the built-in functions have no normaliser.

Defined cases: a null text is the empty text; empty and white-space-only texts share the fingerprint
of the empty text; repeated rows are kept and get equal fingerprints; null ids sort first; an empty
table gives an empty result; ties of the id go by the text, then by its fingerprint; whole texts are read,
however long; other columns may have any name and pass through untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdictlake.llm.common import materialise, maybe_broadcast

#: Rows that one ordered slice should hold.
SLICE_ROWS = 4096
#: Most quantile bounds; finer slices come from splitting each interval evenly.
MOST_BOUNDS = 1024
#: Slices that are linked in one task; runs of them are few enough for one.
RUN_SLICES = 65536


def canonical(text: Column) -> Column:
    """NFC, full case folding, NFC again, white space runs to one space, trimmed."""
    compose = lambda c: F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    fold = lambda c: F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    plain = F.octet_length(text) == F.char_length(text)
    folded = F.when(plain, F.lower(text)).otherwise(compose(fold(compose(text))))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """128 bits as 32 hexadecimal digits: two xxhash64 chains that start apart."""
    half = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return F.concat(half(F.xxhash64(canon, F.lit("low"))), half(F.xxhash64(F.lit("high"), canon)))


def fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add ``out`` to ``docs``; equal canonical texts, and only those, get equal values."""
    canon = "__canon"
    rows = docs.withColumn(canon, canonical(F.coalesce(F.col(text_col), F.lit("")))).withColumn(out, digest(F.col(canon)))
    clash = collisions(rows.select(F.col(out).alias("fp"), F.col(canon).alias("canon")))
    return _apart(rows, clash, out, canon).drop(canon)


def collisions(rows: DataFrame) -> DataFrame | None:
    """Texts that share a digest but not their bytes: (fp, canon, branch), or None if there are none.

    Digests are counted first, on 32 bytes a row; only texts in buckets of two or more are compared,
    by their least and greatest bytes, which combine before the shuffle however large a bucket is.
    """
    many = materialise(rows.groupBy("fp").count().where("count > 1").select("fp"), "fp-many")
    shared = rows.join(maybe_broadcast(many, 64), "fp", "left_semi")
    unequal = materialise(
        shared.groupBy("fp").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).where("lo <> hi").select("fp"), "fp-unequal"
    )
    if unequal.isEmpty():
        return None
    texts = rows.join(unequal, "fp", "left_semi").distinct()
    branch = F.dense_rank().over(Window.partitionBy("fp").orderBy("canon")) - 1
    return materialise(texts.withColumn("branch", branch).where("branch > 0"), "fp-branches")


def _apart(rows: DataFrame, clash: DataFrame | None, fp: str, canon: str) -> DataFrame:
    if clash is None:
        return rows
    other = clash.select(F.col("fp").alias("__fp"), F.col("canon").alias("__text"), F.col("branch").alias("__branch"))
    joined = rows.join(other, (F.col(fp) == F.col("__fp")) & (F.col(canon) == F.col("__text")), "left")
    named = F.when(F.col("__branch").isNotNull(), F.concat(F.col(fp), F.lit("-"), F.col("__branch").cast("string"))).otherwise(F.col(fp))
    return joined.withColumn(fp, named).drop("__fp", "__text", "__branch")


def with_next(docs: DataFrame, order_col: str, carry: list[str], prefix: str = "next_") -> DataFrame:
    """Add the ``carry`` columns of the row that follows in ascending ``order_col`` (the last gets the first's).

    The order is cut into slices by quantiles of the key, so no task sees more than a slice; the first
    row of each slice is sent to the slice before as a sentinel, and one window over slices does the rest.
    Rows of one key are one slice, as are all rows of a narrow run of keys where few bounds fall. Ties are ordered by the carried columns.
    """
    n, lo, hi = docs.agg(F.count("*"), F.min(order_col), F.max(order_col)).first()
    if not n:
        return docs.select("*", *(F.col(c).alias(prefix + c) for c in carry))
    slices = max(1, math.ceil(n / SLICE_ROWS))
    cuts = min(slices, MOST_BOUNDS)
    bounds = []
    if lo is not None and cuts > 1:
        bounds = docs.select(F.percentile_approx(order_col, [i / cuts for i in range(1, cuts)], 10 * cuts)).first()[0]
        bounds = sorted(set(bounds))
    edges = [lo if lo is not None else 0, *[b + 1 for b in bounds if b + 1 <= (hi or 0)], (hi if hi is not None else 0) + 1]
    fine = max(1, math.ceil(slices / max(1, len(edges) - 1)))
    key = F.coalesce(F.col(order_col).cast("long"), F.lit(edges[0]))
    known = F.array(*[F.lit(int(e)).cast("long") for e in edges])
    at = F.greatest(F.size(F.filter(known, lambda e: e <= key)), F.lit(1))
    at = F.least(at, F.lit(len(edges) - 1))
    start, end = F.element_at(known, at), F.element_at(known, at + 1)
    part = F.floor((key - start).cast("double") * fine / (end - start).cast("double"))
    rows = docs.withColumn("__slice", (at - 1) * F.lit(fine).cast("long") + part.cast("long"))

    order = F.struct(order_col, *carry)
    least = F.coalesce(F.col(order_col).cast("long"), F.lit(-(2**63)))
    heads = materialise(rows.groupBy("__slice").agg(F.min(least).alias("__least")), "slice-heads")
    # slices are linked within runs of them, then run to run: no task sees all slices
    run = F.floor(F.col("__slice") / RUN_SLICES).alias("__run")
    linked = heads.withColumn("__run", run).withColumn("__to", F.lag("__slice").over(Window.partitionBy("__run").orderBy("__slice")))
    runs = linked.groupBy("__run").agg(F.max("__slice").alias("__last"))
    runs = runs.select("__run", F.lag("__last").over(Window.orderBy("__run")).alias("__before"), F.max("__last").over(Window.partitionBy()).alias("__last"))
    linked = linked.join(F.broadcast(runs), "__run")  # as many rows as slices over RUN_SLICES
    linked = linked.select("__slice", "__least", F.coalesce("__to", "__before", "__last").alias("__to"))
    linked = materialise(linked, "slice-links")
    first = (
        rows.withColumn("__least", least)
        .join(maybe_broadcast(linked, 48), ["__slice", "__least"])
        .groupBy("__to")
        .agg(F.min(order).alias("o"))
        .select(F.col("__to").alias("__slice"), F.col(f"o.{order_col}").alias(order_col), *(F.col(f"o.{c}").alias(c) for c in carry), F.lit(True).alias("__sentinel"))
    )
    all_rows = rows.withColumn("__sentinel", F.lit(False)).unionByName(first, allowMissingColumns=True)
    w = Window.partitionBy("__slice").orderBy("__sentinel", order_col, *carry)
    out = all_rows.select("*", *(F.lead(c).over(w).alias(prefix + c) for c in carry))
    return out.where(~F.col("__sentinel")).drop("__slice", "__sentinel")


def edited_against_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit, as the query's contract lays down.

    The edit replaces the last quarter of the code points by the start of the next document.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    canon = base.withColumn("canon", canonical(F.col("text"))).withColumn("fp", digest(F.col("canon")))
    clash = collisions(canon.select("fp", "canon"))
    rows = with_next(base.withColumn("fp", digest(canonical(F.col("text")))), "doc_id", ["text", "fp"])
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 4) as int))"), F.substring(F.col("next_text"), F.lit(1), cut)))
    rows = rows.withColumn("edited_canon", canonical(F.col("edited"))).withColumn("edited_fp", digest(F.col("edited_canon")))
    same_edit = F.when(F.col("fp") == F.col("edited_fp"), canonical(F.col("text")) == F.col("edited_canon")).otherwise(F.lit(False))
    same_next = F.when(F.col("fp") == F.col("next_fp"), canonical(F.col("text")) == canonical(F.col("next_text"))).otherwise(F.lit(False))
    rows = rows.withColumn("near_edited", same_edit.cast("double")).withColumn("near_next", same_next.cast("double"))
    if clash is not None:
        rows = _apart(rows.withColumn("__own", canonical(F.col("text"))), clash, "fp", "__own")
        rows = _apart(rows, clash, "edited_fp", "edited_canon")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next"
    )
