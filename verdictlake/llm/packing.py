"""Packing documents into token sequences by cutting-stock column generation.

Every document is tokenised once and cut at multiples of the sequence length; full pieces are
sequences of their own. The remainders form a histogram of length classes. On the driver a linear
program over patterns (which classes share a sequence) is solved by column generation: a revised
simplex gives prices per class, knapsack dynamic programming finds the pattern worth most, until no
pattern pays. The rounded patterns are then given to the documents by their rank within their class:
ranks come from counts per class and hash bucket, so no task or driver ever lists the documents.

Sizes on the driver depend on the number of classes only, never on the data.

Defined cases: a null or empty text is the single end id; repeated rows are each packed; null ids are
kept; an empty table gives an empty result; very long texts become many full pieces; other columns are
not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from verdictlake.llm import bpe
from verdictlake.llm.common import materialise, maybe_broadcast, ship, slices, texts_of

SEQUENCE = 2048
END_ID = 1
#: Lengths are rounded up to a multiple of this for the linear program only.
GRAIN = 8
#: Most length classes in the linear program; where lengths crowd, classes are narrow.
CLASSES = 192
#: Pieces that one bucket of a class should hold.
BUCKET_ROWS = 8192
#: Relative distance from the linear program's optimum at which generation ends.
GAP = 5e-3
#: Most columns generated; the plan is whole and right wherever generation ends.
_ROUNDS = 1500

PIECES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
)


def pieces_of(docs: DataFrame, vocab_path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: cut at multiples of ``sequence``. One narrow pass over the texts."""
    ship(docs.sparkSession)
    spec = bpe.vocabulary(docs.sparkSession, vocab_path)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.loaded(spec)
        for b in slices(batches, 1):
            rows: list[tuple] = []
            for doc, raw in zip(b.column(0).to_pylist(), coder.encode_batch(texts_of(b.column(1))), strict=True):
                raw += end
                total = len(raw) // 4
                for at in range(0, total, sequence):
                    part = raw[4 * at : 4 * (at + sequence)]
                    rows.append((doc, at, len(part) // 4, zlib.crc32(part), total))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, names=PIECES.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


# -- the linear program -----------------------------------------------------------------------


@dataclass(frozen=True)
class Pattern:
    """``items``: class (in grains) to how many of it; ``count``: how many sequences are so made."""

    items: tuple[tuple[int, int], ...]
    count: int


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern worth most at these prices, by dynamic programming over capacity."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        fits = int(np.searchsorted(sizes, room, "right"))
        if fits:
            worth = value[room - sizes[:fits]] + prices[:fits]
            k = int(worth.argmax())
            if worth[k] > value[room] + 1e-12:
                value[room], choice[room] = worth[k], k
    column, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            column[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(value[capacity]), column


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and fractional counts that cover ``demand`` with the fewest sequences."""
    basis = np.diag(np.maximum(1, capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    times = lambda v: np.einsum("ij,j->i", inverse, v)  # noqa: E731  matrices this small only lose by threads
    x = times(demand)
    for _ in range(_ROUNDS):
        prices = np.maximum(inverse.sum(axis=0), 0)
        worth, column = best_pattern(prices, sizes, capacity)
        if worth <= 1 + GAP:  # prices over worth are dual feasible: the sum is within GAP of the optimum
            break
        step = times(column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not math.isfinite(ratio[out]):
            break
        basis[:, out] = column
        pivot = inverse[out] / step[out]
        inverse -= step[:, None] * pivot
        inverse[out] = pivot
        x = np.maximum(times(demand), 0)
    return basis, x


def merged_classes(histogram: dict[int, int], capacity: int, most: int = CLASSES) -> dict[int, int]:
    """Each class to the class it is counted in: at most ``most`` of about equal numbers of documents."""
    below = [c for c in sorted(histogram) if c < capacity]
    total, share, tops = sum(histogram[c] for c in below), 0, []
    for c in reversed(below):
        if not tops or share >= total / most:
            tops.append(c)
            share = 0
        share += histogram[c]
    tops = sorted(tops)
    return {c: (tops[int(np.searchsorted(tops, c))] if c < capacity else capacity) for c in histogram}


def cutting_plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Whole patterns that use up the histogram exactly; class ``capacity`` fills a sequence alone."""
    left = {c: n for c, n in histogram.items() if n > 0}
    plan: list[Pattern] = []
    if full := left.pop(capacity, 0):
        plan.append(Pattern(((capacity, 1),), full))
    if not left:
        return plan
    sizes = np.array(sorted(left))
    basis, x = column_generation(sizes, np.array([left[int(c)] for c in sizes], float), capacity)
    for k in np.argsort(-x, kind="stable"):
        items = [(int(sizes[i]), int(a)) for i, a in enumerate(basis[:, k]) if a > 0.5]
        count = min([int(x[k] + 1e-6), *(left[c] // a for c, a in items)])
        if items and count > 0:
            plan.append(Pattern(tuple(items), count))
            for c, a in items:
                left[c] -= a * count
    return plan + _fill(left, capacity)


def _fill(left: dict[int, int], capacity: int) -> list[Pattern]:
    """What rounding leaves over: the largest first, then whatever still fits, largest first."""
    plan: list[Pattern] = []
    left = {c: n for c, n in left.items() if n}
    while left:
        room, items = capacity, []
        for c in sorted(left, reverse=True):
            if a := min(left[c], room // c):
                items.append((c, a))
                room -= a * c
        count = min(left[c] // a for c, a in items)
        plan.append(Pattern(tuple(items), count))
        for c, a in items:
            left[c] -= a * count
            if not left[c]:
                del left[c]
    return plan


# -- from patterns to documents ---------------------------------------------------------------


def pack(pieces: DataFrame, sequence: int = SEQUENCE, grain: int = GRAIN) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a materialised table of pieces."""
    spark = pieces.sparkSession
    n = pieces.count()
    buckets = max(1, math.ceil(n / BUCKET_ROWS))
    sized = pieces.withColumn("class", F.ceil(F.col("length") / grain).cast("int")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = materialise(sized.groupBy("class", "bucket").agg(F.count("*").alias("n")), "pack-counts")
    exact = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # one row a class
    merged = merged_classes(exact, sequence // grain)
    histogram: dict[int, int] = {}
    for c, top in merged.items():
        histogram[top] = histogram.get(top, 0) + exact[c]
    tops = F.broadcast(spark.createDataFrame(list(merged.items()), "class int, top int"))  # one row a class
    retop = lambda df: df.join(tops, "class").drop("class").withColumnRenamed("top", "class")
    sized, counts = retop(sized), retop(counts).groupBy("class", "bucket").agg(F.sum("n").alias("n"))
    plan = cutting_plan(histogram, sequence // grain)
    rows, first, taken = [], 0, dict.fromkeys(histogram, 0)
    for p in plan:
        slot = 0
        for c, a in p.items:
            rows.append((c, taken[c], taken[c] + a * p.count, a, first, slot))
            taken[c] += a * p.count
            slot += a
        first += p.count
    lots = spark.createDataFrame(rows, "class int, lo long, hi long, each int, first long, slot int")
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(counts.select("class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "pack-starts")
    order = Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = sized.withColumn("r", F.row_number().over(order) - 1).join(maybe_broadcast(starts, 24), ["class", "bucket"]).withColumn("r", F.col("r") + F.col("base"))
    placed = (
        ranked.join(F.broadcast(lots), "class")  # rows: classes times patterns, whatever the input
        .where("r >= lo and r < hi")
        .withColumn("sequence_id", F.col("first") + F.floor((F.col("r") - F.col("lo")) / F.col("each")))
        .withColumn("slot", F.col("slot") + (F.col("r") - F.col("lo")) % F.col("each"))
    )
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*PIECES.names, "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))


def pack_documents(docs: DataFrame, vocab_path: str, sequence: int = SEQUENCE) -> DataFrame:
    """Tokenise, cut and pack: one row a piece, as the query's contract lays down."""
    return pack(materialise(pieces_of(docs, vocab_path, sequence), "pack-pieces"), sequence)
