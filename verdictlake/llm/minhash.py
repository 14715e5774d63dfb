"""Near-duplicate documents by order MinHash, verified by banded alignment.

Words are runs of letters, marks and digits in lower case; k-mers are five words, each labelled by its
occurrence in the document. A signature samples the ``PICKS`` least k-mers under one hash and keeps them
in text order, so documents must share k-mers *and* their order to agree. Documents that agree in any of
``HASHES`` signatures meet in a bucket. Within a bucket a small sketch keeps apart what is far from
similar; what is left is verified on the texts: matching k-mers inside a diagonal band are chained by
their longest increasing run, and the chain's share of all k-mers, |chain| / (|a| + |b| - |chain|),
must reach ``SIMILARITY``.

Steps: equal word sequences collapse to one representative first, so groups of exact copies cost one
row; sketches and signatures travel, texts only for the documents in some candidate group. Groups too
heavy for a task are salted, meet again by their leaders, and then all rows that this leaves in different
components are compared (see ``graph.linked_groups``).

Defined cases: a null text is the empty text; texts without any word are copies only of texts equal to
them; texts of fewer than five words have one k-mer, all of them; a similarity of exactly the bound links;
repeated rows and ids fall in one class, whose name is its least id; an id on unequal texts holds them
together; rows with a null id are never linked and are kept, with a null class; very long texts are read
whole, in blocks of their own; an empty table gives an empty result; other columns may have any name, and
``deduplicate`` keeps them.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictlake.llm.common import materialise, maybe_broadcast, ship, slices
from verdictlake.llm.graph import components, linked_groups

WORDS = 5
SIMILARITY = 0.8
#: Signatures of a document, and k-mers in each: two documents of similarity 0.8 miss each other in all
#: of them in about one case in 25,000.
HASHES, PICKS = 10, 2
#: Bins of the sketch that travels, and the estimate below which a pair is no candidate (five deviations).
BINS, CANDIDATE = 64, 0.55
#: The same for the finer sketch made where texts are at hand (four deviations).
FINE_BINS, FINE_CANDIDATE = 256, 0.7
#: Documents in a block of a bucket; k-mers in a block of a candidate group.
BLOCK_ROWS, BLOCK_KMERS = 2048, 4_000_000
#: Leaders that a block of a split group hands on for each of its clusters in the rounds that join early.
LEADERS = 4
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(2**64 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: shifts and odd products."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the end of each text."""
    plain = pc.utf8_lower(pc.fill_null(texts, ""))
    plain = pc.utf8_trim(pc.replace_substring_regex(plain, r"[^\pL\pM\pN]+", " "), " ")
    parts = pc.split_pattern(plain, " ")
    flat = parts.flatten().dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in flat.dictionary.to_pylist()], np.uint64)
    words = known[flat.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.uint64)
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    some = words != 0  # a text without words splits into one empty string
    ends = np.r_[0, np.cumsum(some)][np.cumsum(counts)]
    return words[some], ends


def kmers(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mers of all documents in a row, and the end of each document."""
    starts = np.r_[0, ends[:-1]]
    sizes = ends - starts
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    for k in range(WORDS):
        term = words[k:] if k else words
        rolled[: n - k] = mix(rolled[: n - k] + _GOLD) + term
    counts = np.where(sizes >= WORDS, sizes - WORDS + 1, np.minimum(sizes, 1))
    for d in np.flatnonzero((sizes > 0) & (sizes < WORDS)):
        value = np.zeros(1, np.uint64)
        for w in words[starts[d] : ends[d]]:
            value = mix(value + _GOLD) + w
        rolled[starts[d]] = value[0] + np.uint64(sizes[d])
    doc = np.repeat(np.arange(len(sizes)), counts)
    first = np.cumsum(counts) - counts
    at = np.arange(len(doc)) - np.repeat(first, counts) + np.repeat(starts, counts)
    h = rolled[at]
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    fresh = np.r_[True, (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])] if len(hs) else np.zeros(0, bool)
    nth = np.arange(len(hs)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hs)), 0))
    label = np.empty(len(h), np.uint64)
    label[order] = nth.astype(np.uint64)
    return mix(h + label * _GOLD), np.cumsum(counts)


def sketches(h: np.ndarray, ends: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash, a byte a bin; 255 is an empty bin."""
    n = len(ends)
    doc = np.repeat(np.arange(n), np.diff(np.r_[0, ends]))
    g = mix(h ^ np.uint64(0x5DEECE66D))
    least = np.full(n * bins, _TOP)
    np.minimum.at(least, doc * bins + (g % np.uint64(bins)).astype(np.int64), g // np.uint64(bins))
    byte = (mix(least) % np.uint64(255)).astype(np.uint8)
    byte[least == _TOP] = 255
    return byte.reshape(n, bins)


def signatures(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order MinHash signatures, (documents, HASHES); rows of documents without k-mers are zero."""
    out = np.zeros((len(ends), HASHES), np.uint64)
    starts = np.r_[0, ends[:-1]]
    has = np.flatnonzero(ends > starts)
    if not len(has):
        return out
    begin, sizes = starts[has], (ends - starts)[has]
    doc = np.repeat(np.arange(len(has)), sizes)
    for j in range(HASHES):
        g = mix(h ^ np.uint64((j + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
        places = np.empty((PICKS, len(has)), np.int64)
        for pick in range(PICKS):
            least = np.minimum.reduceat(g, begin)
            hits = np.flatnonzero(g == least[doc])
            places[pick, doc[hits[::-1]]] = hits[::-1]
            g[places[pick]] = _TOP
        places.sort(axis=0)
        value = np.full(len(has), np.uint64(j))
        for pick in range(PICKS):
            value = mix(value + _GOLD) + h[places[pick]]
        out[has, j] = value
    return out


def likeness(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated similarity of a sketch with each of many."""
    same, full = (many == one) & (one != 255), (many != 255) | (one != 255)
    return same.sum(axis=1) / np.maximum(full.sum(axis=1), 1)


def aligned(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two documents' k-mer sequences by banded alignment.

    k-mers are distinct within a document, so an alignment is a chain of matches increasing in both.
    Documents as similar as asked differ in few k-mers, which bounds how far a match may stray.
    """
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return 0.0
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b[order], a), len(b) - 1)
    there = order[at]
    hit = np.flatnonzero(b[there] == a)
    band = int((1 - 2 * SIMILARITY / (1 + SIMILARITY)) * (len(a) + len(b))) + 1
    there = there[hit]
    near = np.abs(there - hit) <= band
    there = there[near]
    total = len(a) + len(b)
    if len(there) / max(total - len(there), 1) < SIMILARITY:
        return 0.0
    chain = len(there) if (np.diff(there) > 0).all() else _increasing(there)
    return chain / (total - chain)


def _increasing(values: np.ndarray) -> int:
    """Length of the longest increasing run of a sequence."""
    tails: list[int] = []
    for v in values.tolist():
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
        else:
            tails[k] = v
    return len(tails)


class _Clusters:
    """Clusters of a group as an array of labels, and the edges that made them.

    ``labels`` in ascending order name what is linked beforehand: such rows do not meet again.
    """

    def __init__(self, n: int, labels: np.ndarray | None = None):
        self.first = np.arange(n) if labels is None else np.searchsorted(labels, labels)
        self.own = self.first.copy()
        self.edges: list[tuple[int, int]] = []

    def meets(self, i: int) -> slice:
        """The earlier rows that row ``i`` is to be compared with."""
        return slice(0, int(self.first[i]))

    def strangers(self, i: int, near: np.ndarray, least: float, below: float) -> list[int]:
        """Earlier rows of other clusters whose likeness to row ``i`` lies in the range, likeliest first."""
        found = np.flatnonzero((near >= least) & (near < below) & (self.own[: len(near)] != self.own[i]))
        return found[np.argsort(-near[found], kind="stable")].tolist()

    def link(self, i: int, j: int) -> None:
        a, b = sorted((self.own[i], self.own[j]))
        self.own[self.own == b] = a
        self.edges.append((i, j))

    def leaders(self) -> list[int]:
        """The best linked rows of each cluster."""
        n = len(self.own)
        degree = np.bincount([k for e in self.edges for k in e], minlength=n) if self.edges else np.zeros(n, int)
        by: dict[int, list[int]] = {}
        for i in np.argsort(-degree, kind="stable").tolist():
            held = by.setdefault(int(self.own[i]), [])
            if len(held) < LEADERS:
                held.append(i)
        return [i for held in by.values() for i in held]


def link_by_sketch(group: list[bytes], labels: np.ndarray | None = None) -> tuple[list[tuple[int, int]], list[int]]:
    """Edges that span what the travelling sketches hold similar; leaders: a few of each cluster."""
    s = np.frombuffer(b"".join(group), np.uint8).reshape(len(group), BINS)
    c = _Clusters(len(s), labels)
    for i in range(1, len(s)):
        for j in c.strangers(i, likeness(s[i], s[c.meets(i)]), CANDIDATE, 2):
            if c.own[i] != c.own[j]:
                c.link(i, j)
    return c.edges, c.leaders()


def link_by_text(group: list[str], labels: np.ndarray | None = None) -> tuple[list[tuple[int, int]], list[int]]:
    """Edges that span the verified links of a group.

    The likelier pairs come first, in a round of their own: what they link needs no more verifying.
    """
    words, ends = word_hashes(pa.array(group, pa.string()))
    h, ends = kmers(words, ends)
    docs = np.split(h, ends[:-1])
    s = sketches(h, ends, FINE_BINS)
    c = _Clusters(len(docs), labels)
    for least, below in ((SIMILARITY, 2), (FINE_CANDIDATE, SIMILARITY)):
        for i in range(1, len(docs)):
            for j in c.strangers(i, likeness(s[i], s[c.meets(i)]), least, below):
                if c.own[i] != c.own[j] and aligned(docs[i], docs[j]) >= SIMILARITY:
                    c.link(i, j)
    return c.edges, c.leaders()


def profiles(docs: DataFrame) -> DataFrame:
    """(id, digest, n_kmers, signatures, sketch) of every row: one narrow pass over whole texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            words, ends = word_hashes(b.column(1))
            digests = []
            for a, e, t in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), b.column(1), strict=True):
                raw = words[a:e].tobytes() if e > a else b"text:" + (t.as_py() or "").encode()
                digests.append(hashlib.blake2b(raw, digest_size=16).digest())
            h, kends = kmers(words, ends)
            sig = signatures(h, kends).view(np.int64)
            sk = sketches(h, kends, BINS)
            sizes = np.diff(np.r_[0, kends])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * HASHES, pa.int32()), pa.array(sig.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists, pa.array([r.tobytes() for r in sk], pa.binary())], names=["id", "digest", "n_kmers", "signatures", "sketch"])

    return docs.mapInArrow(run, "id long, digest binary, n_kmers long, signatures array<long>, sketch binary")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id): the least id of the near-duplicate class of every row with an id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    known = materialise(profiles(rows), "omh-profiles")
    alike = known.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n_kmers").alias("n_kmers"), F.first("signatures").alias("signatures"), F.first("sketch").alias("sketch"))
    alike = materialise(alike, "omh-representatives")
    # an id on several rows holds its texts together
    shared = known.select("id", "digest").distinct().groupBy("id").count().where("count > 1").select("id")
    reps = alike.where("n_kmers > 0")
    buckets = reps.select(F.col("rep").alias("id"), "sketch", F.posexplode("signatures").alias("nth", "sig")).select(F.xxhash64("nth", "sig").alias("key"), "id", "sketch")
    loose = linked_groups(buckets, "sketch", None, BLOCK_ROWS, link_by_sketch, "omh-bucket")
    group = materialise(components(loose).join(reps.select(F.col("rep").alias("node"), "n_kmers").distinct(), "node"), "omh-groups")
    texts = rows.join(maybe_broadcast(group.select(F.col("node").alias("id"), "component", "n_kmers"), 40), "id").select(F.col("component").alias("key"), "id", "text", "n_kmers")
    firm = linked_groups(texts, "text", "n_kmers", BLOCK_KMERS, link_by_text, "omh-verify")
    several = known.join(shared, "id").join(alike.select("digest", "rep"), "digest").select(F.col("id").alias("src"), F.col("rep").alias("dst"))
    linked = materialise(components(firm.unionByName(several)).withColumnRenamed("node", "rep"), "omh-classes")
    named = alike.select("digest", "rep").join(maybe_broadcast(linked, 32), "rep", "left")
    named = materialise(named.select("digest", F.coalesce("component", "rep").alias("class_id")), "omh-named")
    return known.select("id", "digest").join(maybe_broadcast(named, 48), "digest").select(F.col("id").alias(id_col), "class_id")


def report(docs: DataFrame) -> DataFrame:
    """One row a document: its class (the least id in it) and whether it is the one that stays."""
    found = classes(docs).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    none = docs.where("doc_id is null").select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return found.unionByName(none)


def _least(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row of each id: an aggregation that combines before its shuffle, however often an id is repeated."""
    rest = [c for c in columns if c not in ("doc_id", "text")]
    order = F.struct(F.col("text").isNotNull(), "text", F.xxhash64(*rest) if rest else F.lit(0))
    return rows.groupBy("doc_id").agg(F.min_by(F.struct(*columns), order).alias("__row")).select("__row.*")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, all columns kept: of rows with the class's id the one of least text,
    then of least hash of the other columns."""
    found = materialise(classes(docs), "omh-kept")
    stay = found.where("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("__n"))
    stay = materialise(stay, "omh-stay")
    kept = docs.join(maybe_broadcast(stay, 32), "doc_id").select(*docs.columns, "__n")
    once, often = kept.where("__n = 1"), kept.where("__n > 1")
    out = once if often.isEmpty() else once.select(*docs.columns).unionByName(_least(often, docs.columns))
    return out.select(*docs.columns).unionByName(docs.where("doc_id is null"))
