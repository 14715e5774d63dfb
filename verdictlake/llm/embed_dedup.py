"""Embedding near-duplicates through an inverted multi-index.

Vectors are scaled to length one and cut in halves. Each half has a codebook of its own, trained by
k-means on a bounded sample; a pair of codes is a cell, and every vector is filed under its label and
cell. A search walks the cells in the order of the sum of both halves' distances (multi-sequence
traversal) and stops after as many cells as the calibration found to reach the target recall; what it
meets is verified by cosine in double precision. Vectors of a label are only met by vectors of that label.

Equal vectors of a label collapse first, with their number as weight, and get a key of their own, so ids may
repeat. A pair is counted whichever of the two reaches the other's cell. Codes grow with the square root of
the largest label, so cells keep their size; a cell of many close vectors is dealt in blocks, and every
vector leaves a cell with one row: its count and one edge of a spanning forest. Counts go back to the rows
by the vectors that have copies only, the most frequent ones by broadcast.

Defined cases: null vectors or labels, zero vectors, and vectors that hold a null or a component that is
not finite link with nothing and are kept, as are vectors with a null id, which have a null component;
vectors of different lengths never link; repeated rows count as links of each other; rows of one id with
unequal vectors are vectors of their own, each with its links; a row is kept if its id is the least of its
component, so all rows with that id and vector stay; links at exactly the bound count; an empty table gives
an empty result; other columns may have any name, ``deduplicate`` keeps them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictlake.llm.common import materialise, maybe_broadcast, ship
from verdictlake.llm.graph import Forest, components

COSINE = 0.98
#: Vectors that the codebooks and the calibration are fitted on, by lowest hash: at least so many, ten a code, at most so many.
SAMPLE_ROWS, MOST_SAMPLE = 8192, 65536
#: Sampled vectors whose links the calibration looks up by brute force.
PROBES = 1024
#: Share of links between sampled vectors that the traversal must reach.
TARGET_RECALL = 0.995
#: Codes of a half, at most; as many as make cells of about so many vectors of the largest label. Beyond
#: that bound (400 million vectors of one label) cells grow, and are dealt in more blocks.
CODES, CELL_ROWS = 4096, 24
#: Vectors of one block of a cell, and the guests that it meets at a time.
BLOCK_ROWS, GUESTS = 4096, 1024
#: Vectors with more copies than this are joined back to their rows by broadcast.
HOT_COPIES = 4096


@dataclass(frozen=True)
class Index:
    """Codebooks of both halves and the number of cells that a search walks."""

    left: np.ndarray
    right: np.ndarray
    cells: int


def _distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ codes.T + (codes**2).sum(1), 0)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means: farthest-first seeds by a fixed generator, then Lloyd's rounds."""
    k = max(1, min(k, len(np.unique(x, axis=0))))
    rng = np.random.default_rng(7)
    codes = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _distances(x, codes).argmin(1)
        for c in range(k):
            if (own == c).any():
                codes[c] = x[own == c].mean(0)
    return codes


def traverse(left: np.ndarray, right: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The ``most`` nearest cells of one vector, given its distances to the codes of each half.

    The multi-sequence algorithm: both halves' codes are sorted, and a heap over the grid of ranks
    yields pairs by increasing sum; a pair enters once its neighbours below it in either half are out.
    """
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, out, seen = [(left[a[0]] + right[b[0]], 0, 0)], [], {(0, 0)}
    while heap and len(out) < most:
        _, i, j = heapq.heappop(heap)
        out.append((int(a[i]), int(b[j])))
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (left[a[p]] + right[b[q]], p, q))
    return out


def _nearer(left: np.ndarray, right: np.ndarray, i: int, j: int) -> int:
    """How many cells of the grid come before cell (i, j) in the walk of a vector with these distances."""
    return int(np.searchsorted(np.sort(right), (left[i] - left) + right[j], "left").sum())


def fit(sample: np.ndarray, codes: int) -> Index:
    """Codebooks from the sample, then the shortest walk that reaches the target recall on it."""
    half = sample.shape[1] // 2
    left, right = codebook(sample[:, :half], codes), codebook(sample[:, half:], codes)
    n_cells = len(left) * len(right)
    probes = min(PROBES, len(sample))
    at = lambda x: (_distances(x[:, :half], left), _distances(x[:, half:], right))
    dl, dr = at(sample[:probes])
    ranks: list[int] = []
    noise = np.random.default_rng(11)
    for i in range(probes):
        linked = np.flatnonzero(sample @ sample[i] >= COSINE)
        # a link that lies exactly at the bound, in a random direction, stands for links the sample lacks
        turn = noise.normal(size=sample.shape[1])
        turn -= (turn @ sample[i]) * sample[i]
        far = COSINE * sample[i] + np.sqrt(1 - COSINE**2) * turn / max(np.linalg.norm(turn), 1e-12)
        others = np.concatenate([far[None], sample[linked[linked != i][:64]]])
        ol, orr = at(others)
        home = int(dl[i].argmin()), int(dr[i].argmin())
        for fl, fr in zip(ol, orr, strict=True):
            # found if either vector's walk reaches the other's cell
            ranks.append(min(_nearer(dl[i], dr[i], int(fl.argmin()), int(fr.argmin())), _nearer(fl, fr, *home)))
    need = int(np.quantile(ranks, TARGET_RECALL, method="higher")) + 1
    return Index(left, right, min(n_cells, need))


def can_link() -> Column:
    """Whether a row has an id, a label and a vector of finite numbers that is not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return F.coalesce(whole & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0), F.lit(False))


def usable(rows: DataFrame, *carry: str) -> DataFrame:
    """(id, label, v): the vectors that can link; the label also holds their length."""
    good = rows.where(can_link())
    return good.select(*carry, F.col("vec_id").cast("long").alias("id"), F.concat_ws(":", F.size("embedding").cast("string"), F.col("label").cast("string")).alias("label"), F.col("embedding").alias("v"))


def unit(flat: np.ndarray, n: int) -> np.ndarray:
    """Rows of length one in double precision; scaled by the largest component first, so nothing overflows."""
    x = flat.astype(float).reshape(n, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def filed(vectors: DataFrame, indexes: dict[int, Index]) -> DataFrame:
    """A row for each vector and each cell that it is filed in (``walk`` is set) or visits (it is null)."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(indexes)  # two codebooks of at most CODES rows for each length
    kind = dict(vectors.dtypes)["v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            cells: list[list[int]] = [[0]] * b.num_rows  # a length that the sample lacks has one cell
            for d, index in shared.value.items():
                rows = np.flatnonzero(sizes == d)
                if len(rows):
                    x = unit(b.column(2).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), len(rows))
                    half, wide = d // 2, len(index.right)
                    dl, dr = _distances(x[:, :half], index.left), _distances(x[:, half:], index.right)
                    for i, r in enumerate(rows.tolist()):
                        cells[r] = [p * wide + q for p, q in traverse(dl[i], dr[i], index.cells)]
            at = np.repeat(np.arange(b.num_rows), [len(c) for c in cells])
            home = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(1).take(take),
                    pa.array([c for walk in cells for c in walk], pa.int64()),
                    pa.array([cells[r][0] for r in at.tolist()], pa.int64()),
                    b.column(0).take(take),
                    b.column(3).take(take),
                    b.column(2).take(take),
                    pa.array([cells[r] if h else None for r, h in zip(at.tolist(), home.tolist(), strict=True)], pa.list_(pa.int64())),
                ],
                names=["label", "cell", "own", "id", "weight", "v", "walk"],
            )

    return vectors.select("id", "label", "v", "weight").mapInArrow(run, f"label string, cell long, own long, id long, weight long, v {kind}, walk array<long>")


class _Cell:
    """One block of a cell: its vectors, against which every later row of the group is held."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, weights: np.ndarray, own: int, walks: list[list[int]]):
        self.x, self.ids, self.weights, self.own = x, ids, weights, own
        self.walks = [set(w) for w in walks]
        self.counts = np.zeros(len(ids), np.int64)
        self.forest, self.edges = Forest(len(ids)), []
        for a in range(0, len(x), GUESTS):
            linked = x[a : a + GUESTS] @ x.T >= COSINE
            linked[np.arange(len(linked)), a + np.arange(len(linked))] = False
            self.counts[a : a + GUESTS] += linked @ weights
            for i in np.flatnonzero(linked.any(axis=1)).tolist():
                # a link to the first of them, and theirs among each other by way of this row
                for j in np.flatnonzero(linked[i]).tolist():
                    if self.forest.root(a + i) != self.forest.root(j):
                        self._join(a + i, j)

    def _join(self, i: int, j: int) -> None:
        if self.forest.join(i, j):
            self.edges.append((self.ids[i], self.ids[j]))

    def meet(self, x: np.ndarray, ids: np.ndarray, weights: np.ndarray, owns: np.ndarray) -> np.ndarray:
        """Count guests' links, and the residents' links to guests whose cells those do not visit."""
        linked = x @ self.x.T >= COSINE
        for g in np.flatnonzero(linked.any(axis=1)).tolist():
            met = np.flatnonzero(linked[g]).tolist()
            self.edges.append((ids[g], self.ids[met[0]]))
            for m in met[1:]:
                self._join(met[0], m)
            for m in met:
                if owns[g] == self.own or owns[g] not in self.walks[m]:
                    self.counts[m] += weights[g]
        return linked @ self.weights


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams groups (label, cell, block) in order, residents before guests."""
    now: tuple | None = None
    waiting: list[pa.RecordBatch] = []
    cell: _Cell | None = None
    out: list[list] = [[], [], []]

    def emit(ids, counts, edges) -> None:
        some = np.flatnonzero(counts)
        out[0].extend(np.asarray(ids)[some].tolist())
        out[1].extend(counts[some].tolist())
        out[2].extend([None] * len(some))
        for a, b in edges:
            out[0].append(int(a))
            out[1].append(0)
            out[2].append(int(b))

    def settle() -> None:
        nonlocal cell, waiting
        if waiting:
            t = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            x = unit(t.column("v").flatten().to_numpy(zero_copy_only=False), t.num_rows)
            cell = _Cell(x, t.column("id").to_numpy(), t.column("weight").to_numpy(), t.column("own")[0].as_py(), t.column("walk").to_pylist())
            waiting = []

    def close() -> None:
        nonlocal cell
        settle()
        if cell is not None:
            emit(cell.ids, cell.counts, cell.edges)
        cell = None

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["id", "n", "dst"])
        for c in out:
            c.clear()
        return made

    for b in batches:
        if not b.num_rows:
            continue
        keys = list(zip(b.column("label").to_pylist(), b.column("cell").to_pylist(), b.column("block").to_pylist(), b.column("guest").to_pylist(), strict=True))
        starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        for a, e in zip(starts, [*starts[1:], len(keys)], strict=True):
            group, guest = keys[a][:3], keys[a][3]
            if group != now:
                close()
                now = group
            part = b.slice(a, e - a)
            if not guest:
                waiting.append(part)
                continue
            settle()
            if cell is None:
                continue
            for at in range(0, part.num_rows, GUESTS):
                p = part.slice(at, GUESTS)
                ids = p.column("id").to_numpy()
                x = unit(p.column("v").flatten().to_numpy(zero_copy_only=False), p.num_rows)
                emit(ids, cell.meet(x, ids, p.column("weight").to_numpy(), p.column("own").to_numpy()), [])
        if len(out[0]) > 20_000:
            yield flush()
    close()
    yield flush()


def links(vectors: DataFrame) -> DataFrame:
    """(id, n, dst) of distinct vectors (id, label, v, weight): counts to sum by id where ``dst`` is null, else edges."""
    ship(vectors.sparkSession)
    largest = vectors.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    codes = int(np.clip(np.sqrt(largest / CELL_ROWS), 1, CODES))
    rows = int(np.clip(10 * codes, SAMPLE_ROWS, MOST_SAMPLE))
    sample = [r["v"] for r in vectors.orderBy(F.xxhash64("v"), "v").limit(rows).select("v").collect()]
    indexes: dict[int, Index] = {}
    for d in {len(v) for v in sample}:
        some = np.array([v for v in sample if len(v) == d], float)
        indexes[d] = fit(unit(some.ravel(), len(some)), codes if d > 1 else 1)
    rows = materialise(filed(vectors, indexes), "imi-filed")
    sizes = rows.where("walk is not null").groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("long").alias("blocks"))
    sizes = materialise(sizes, "imi-cells")
    dealt = rows.join(maybe_broadcast(sizes, 64), ["label", "cell"])  # cells that hold nothing need no visit
    mine = F.pmod(F.xxhash64("id"), F.col("blocks"))
    # a resident is at home in its block and a guest of the blocks before it; a visitor is a guest of all
    seats = F.when(F.col("walk").isNotNull(), F.sequence(F.lit(0).cast("long"), mine)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = dealt.withColumn("mine", mine).withColumn("block", F.explode(seats)).withColumn("guest", F.col("walk").isNull() | (F.col("block") != F.col("mine")))
    ordered = dealt.select("label", "cell", "block", "guest", "id", "own", "weight", "v", "walk").repartition("label", "cell", "block").sortWithinPartitions("label", "cell", "block", "guest")
    return ordered.mapInArrow(_search, "id long, n long, dst long")


def _told(good: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct vectors (key, label, v, id, weight), and of each key (id, weight, n_links, component_id)."""
    reps = good.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("weight")).withColumn("key", F.monotonically_increasing_id())
    reps = materialise(reps, "imi-vectors")
    found = materialise(links(reps.select(F.col("key").alias("id"), "label", "v", "weight")), "imi-links")
    counts = found.where("dst is null").groupBy(F.col("id").alias("key")).agg(F.sum("n").alias("n"))
    joined = components(found.where("dst is not null").select(F.col("id").alias("src"), "dst")).withColumnRenamed("node", "key")
    joined = materialise(joined.join(reps.select("key", "id"), "key"), "imi-components")
    least = materialise(joined.groupBy("component").agg(F.min("id").alias("least")), "imi-least")
    joined = joined.join(maybe_broadcast(least, 32), "component").select("key", "least")
    told = reps.select("key", "id", "weight").join(counts, "key", "left").join(joined, "key", "left")
    told = told.select("key", "id", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    return reps, materialise(told, "imi-told")


def _with_links(good: DataFrame, reps: DataFrame, told: DataFrame, least: int) -> DataFrame:
    """The rows of ``good`` whose vector has at least ``least`` copies, with n_links and component_id.

    Rows meet their vector under its hash and are compared in full; the few vectors of very many copies are
    broadcast, as they would be one key.
    """
    marks = reps.where(F.col("weight") >= least).select("key", "weight", F.xxhash64("label", "v").alias("hash"), F.col("label").alias("__label"), F.col("v").alias("__v"))
    marks = marks.join(told.select("key", "n_links", "component_id"), "key").drop("key")
    rows = good.withColumn("hash", F.xxhash64("label", "v"))
    hot = materialise(marks.where(F.col("weight") > HOT_COPIES), "imi-hot")
    width = 64 + 16 * (hot.agg(F.max(F.size("__v"))).first()[0] or 0)
    same = (F.col("label") == F.col("__label")) & (F.col("v") == F.col("__v"))
    out = rows.join(marks.where(F.col("weight") <= HOT_COPIES), "hash").where(same)
    if not hot.isEmpty():
        out = out.unionByName(rows.join(maybe_broadcast(hot, width), "hash").where(same))
    return out.drop("hash", "weight", "__label", "__v")


def report(embeddings: DataFrame) -> DataFrame:
    """Links and components of every row, as the query's contract lays down."""
    rows = embeddings.select("vec_id", "label", "embedding")
    good = usable(rows)
    reps, told = _told(good)
    # a vector without copies stands for its only row
    once = told.where("weight = 1").select(F.col("id").alias("vec_id"), "n_links", "component_id")
    more = _with_links(good, reps, told, 2).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    lone = rows.where(~can_link()).select(F.col("vec_id").cast("long"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return once.unionByName(more).unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def deduplicate(embeddings: DataFrame) -> DataFrame:
    """``embeddings`` without the vectors that are not the least of their component, row by row, all columns kept."""
    packed = embeddings.select("vec_id", "label", "embedding", F.struct("*").alias("__row"))
    good = usable(packed, "__row")
    reps, told = _told(good.drop("__row"))
    stay = _with_links(good, reps, told, 1).where(F.col("id") == F.col("component_id")).select("__row")
    return stay.unionByName(packed.where(~can_link()).select("__row")).select("__row.*")
