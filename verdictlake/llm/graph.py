"""Connected components and grouping with bounded groups, for the near-duplicate operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictlake.llm.common import discard, materialise, maybe_broadcast


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from each node of ``edges`` (src, dst long).

    Large-star and small-star steps in turn: each point all neighbours at the least one, so long paths
    fold up in a logarithmic number of rounds. Every round is written to the shared folder, and the one before
    deleted. A star's centre is one key of the joins, with one row on the other side: skew that the runtime
    re-planner splits; minima combine before their shuffle.
    """
    now = materialise(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u > v").distinct(), "cc-start")
    mark = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = materialise(large, "cc-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        old, now = now, materialise(small, "cc-small")
        discard(old)
        discard(large)
        before, mark = mark, _state(now)
        if mark == before:
            break
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.lit(0))).first())


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


#: A group whose leaders are more than this share of it is taken for one of strangers.
SHRINK = 0.7
#: Given the payloads of a group and, where rows are known to be linked already, their labels in ascending
#: order: the edges that link it further (pairs of positions) and its leaders.
Linker = Callable[[list, "np.ndarray | None"], tuple[list[tuple[int, int]], list[int]]]


def linked_groups(rows: DataFrame, payload: str, weight: str | None, most: int, linker: Linker, label: str) -> DataFrame:
    """Edges (src, dst) found by ``linker`` inside groups of ``rows`` (key long, id long, payload, weight).

    Groups are streamed from partitions sorted by key. A group heavier than ``most`` is salted into
    blocks; each block is linked by itself and hands its leaders to the next round, where they meet
    again under the group's key, until every group fits in one block or stops shrinking. The rounds only
    join early what is easily joined: afterwards every two rows of a split group that are not yet in one
    component meet (see ``_rest``), leaders or not, so each link of a group is found or implied.
    """
    extra = [weight] if weight else []
    found: list[DataFrame] = []
    whole, split = rows, None
    before: DataFrame | None = None
    turn = 0
    while True:
        size = F.sum(weight) if weight else F.count("*")
        heavy = materialise(rows.groupBy("key").agg(size.cast("long").alias("size")).where(F.col("size") > most), f"{label}-heavy-{turn}")
        hot = not heavy.isEmpty()
        if hot and split is None:
            split = heavy.select("key")
        if hot and before is not None:
            stuck = materialise(heavy.join(before.select("key", F.col("size").alias("was")), "key").where(F.col("size") > SHRINK * F.col("was")).select("key"), f"{label}-stuck-{turn}")
            if not stuck.isEmpty():
                rows = rows.join(maybe_broadcast(stuck, 32), "key", "left_anti")
                heavy = heavy.join(stuck, "key", "left_anti")
                hot = not heavy.isEmpty()
        salted = rows.join(maybe_broadcast(heavy, 32), "key", "left") if hot else rows.withColumn("size", F.lit(None).cast("long"))
        blocks = F.coalesce(F.ceil(F.col("size") / most).cast("long"), F.lit(1))
        salted = salted.withColumn("block", F.pmod(F.xxhash64("id", F.lit(turn)), blocks)).withColumn("split", blocks > 1)
        out = _linked(salted, payload, extra, linker, f"{label}-round-{turn}")
        found.append(out.where("not leader").select("src", "dst"))
        if not hot:
            break
        rows = out.where("leader").select("key", F.col("src").alias("id"), payload, *extra)
        before = heavy
        turn += 1
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    if split is None:
        return edges
    return edges.unionByName(_rest(whole.join(maybe_broadcast(split, 16), "key"), edges, payload, extra, most, linker, label))


def _rest(rows: DataFrame, edges: DataFrame, payload: str, extra: list[str], most: int, linker: Linker, label: str) -> DataFrame:
    """Edges between rows of one group that ``edges`` leave in different components.

    In each group the heaviest component is set against all others, and these against each other, by pairs
    of blocks: the cost is that of the comparisons still open, and a group in one component has none.
    """
    known = materialise(components(edges), f"{label}-known").select(F.col("node").alias("id"), "component")
    weigh = F.col(extra[0]) if extra else F.lit(1)
    light = rows.select("key", "id", weigh.cast("long").alias("w")).join(maybe_broadcast(known, 32), "id", "left")
    sizes = materialise(light.groupBy("key", F.coalesce("component", "id").alias("own")).agg(F.sum("w").alias("size")), f"{label}-components")
    groups = sizes.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.max(F.struct("size", "own")).alias("main")).where("n > 1")
    half = max(1, most // 2)  # two blocks meet in a task
    mains = F.greatest(F.ceil(F.col("main.size") / half).cast("long"), F.lit(1))
    others = F.greatest(F.ceil((F.col("total") - F.col("main.size")) / half).cast("long"), F.lit(1))
    groups = materialise(groups.select("key", F.col("main.own").alias("main"), mains.alias("mains"), others.alias("others")), f"{label}-open")
    if groups.isEmpty():
        return edges.limit(0)
    dealt = rows.join(maybe_broadcast(groups, 48), "key").join(maybe_broadcast(known, 32), "id", "left").withColumn("own", F.coalesce("component", "id"))
    far = F.col("own") != F.col("main")
    mine = F.pmod(F.xxhash64("id"), F.when(far, F.col("others")).otherwise(F.col("mains")))
    # blocks of the others are numbered first; a pair of blocks (a, b) meets under a * all + b, a <= b
    all_ = F.col("others") + F.col("mains")
    dealt = dealt.withColumn("mine", F.when(far, mine).otherwise(mine + F.col("others")))
    partners = F.sequence(F.lit(0).cast("long"), F.when(far, all_).otherwise(F.col("others")) - 1)
    dealt = dealt.withColumn("with", F.explode(partners)).withColumn("block", F.least("mine", "with") * all_ + F.greatest("mine", "with")).withColumn("split", F.lit(False))
    return _linked(dealt, payload, extra, linker, f"{label}-rest", "own").select("src", "dst")


def _linked(rows: DataFrame, payload: str, extra: list[str], linker: Linker, label: str, own: str | None = None) -> DataFrame:
    kind = dict(rows.dtypes)[payload]
    schema = f"key long, src long, dst long, leader boolean, {payload} {kind}" + "".join(f", {c} long" for c in extra)
    labels = [own] if own else []
    dealt = rows.select("key", "block", "split", "id", payload, *extra, *labels).repartition("key", "block").sortWithinPartitions("key", "block", *labels, "id")
    return materialise(dealt.mapInArrow(_stream(payload, extra[0] if extra else None, linker, own), schema), label)


def _stream(payload: str, weight: str | None, linker: Linker, own: str | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            key, block = t.column("key").to_numpy(), t.column("block").to_numpy()
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
            held = t.slice(starts[-1])
            if len(starts) > 1:
                yield from link(t.slice(0, starts[-1]), np.r_[starts])
        if held is not None and held.num_rows:
            yield from link(held, np.array([0, held.num_rows]))

    def link(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(starts)
        split = t.column("split").to_numpy()
        ids, keys = t.column("id").to_numpy(), t.column("key").to_numpy()
        src, dst, key, lead, at = [], [], [], [], []
        for k in np.flatnonzero((sizes > 1) | split[starts[:-1]]):
            a, n = int(starts[k]), int(sizes[k])
            labels = t.column(own).slice(a, n).to_numpy() if own else None
            if labels is not None and labels[0] == labels[-1]:
                continue
            pairs, leaders = linker(t.column(payload).slice(a, n).to_pylist(), labels)
            for i, j in pairs:
                src.append(ids[a + i])
                dst.append(ids[a + j])
                key.append(keys[a])
                lead.append(False)
                at.append(None)
            if split[a]:
                for i in leaders:
                    src.append(ids[a + i])
                    dst.append(ids[a + i])
                    key.append(keys[a])
                    lead.append(True)
                    at.append(a + i)
        if src:
            where = pa.array(at, pa.int64())
            cols = [pa.array(key, pa.int64()), pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(lead, pa.bool_())]
            names = ["key", "src", "dst", "leader", payload, *([weight] if weight else [])]
            cols += [t.column(c).combine_chunks().take(where) for c in names[4:]]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run
