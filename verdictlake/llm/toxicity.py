"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text, one on toxic text. A window of a text
that the toxic dictionary shortens more than the ordinary one is suspect; how strongly and how often
that happens in a text is weighed by a calibrated threshold.

A toxic text is ordinary prose for the most part, and a trainer that sees one corpus only would spend its
dictionary on that. So what toxic texts share with ordinary ones is cut out of the toxic samples first:
a span stays if its byte strings of about the trainer's own length stand in ``LIFT`` times the share of
toxic texts (``residues``). No words are told apart, and no text is read as words. For the same reason both
sides hold the dictionary of ordinary text, the toxic side adds its own: chance likeness to ordinary prose
cancels out. With dictionaries on their own, entropy tables and all, the noise of such likeness is larger
than what a toxic passage gains (figures in README).

The model is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS`` of each label, lowest hash of
the id first, ``SAMPLE_BYTES`` of UTF-8 at most), on the driver; scoring is one narrow pass over whole texts.

Defined cases: null and empty texts score as texts without suspect windows; repeated rows are each
scored; null ids are kept and count as not held out; an id labelled both ways is not learned from; ties
in the sample's order go by id, then by the text's hash; with no labelled text of either kind every score
is 0; an empty table gives an empty result; very long texts are read in full, window by window, in slices
of bounded size; of other columns none is read, so their names do not matter, and ``reject`` keeps them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictlake.llm.common import materialise, ship, slices, texts_of

#: Most labelled rows of each label, and most bytes of each label's text, that the model is fitted on.
SAMPLE_ROWS = {1: 2000, 0: 5000}
SAMPLE_BYTES = {1: 8 << 20, 0: 16 << 20}
#: Bytes of a window and from one window to the next.
WINDOW, STRIDE = 48, 24
LEVEL = 3
GROUND_BYTES, TOXIC_BYTES = 32768, 1536
#: Bytes of ordinary text, evenly taken from the sample, that the ordinary dictionary is trained on.
GROUND_SAMPLE = 10 << 20
#: A span stays in the toxic samples if its strings of these lengths stand in at least so many toxic texts,
#: in at least this share of them, and in so many times the share of ordinary ones.
GRAMS, LEAST_TEXTS, LEAST_SHARE, LIFT = (5, 6), 3, 0.005, 5
#: Bytes of one sample for the toxic dictionary.
PIECE = 128
#: Gains, in bytes, at which windows are counted.
STEPS = (1, 2, 3, 4, 5, 6, 8, 10)
#: Windows compressed in one call.
SLICE = 16384
#: One row in so many is held out of training, by the checksum of its id.
FOLDS = 5


@dataclass(frozen=True)
class Model:
    """Dictionaries and the weights of the calibrated threshold; no bytes: a model that knows nothing."""

    ground: bytes = b""
    toxic: bytes = b""
    centre: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()


class Scorer:
    """A model with its dictionaries digested."""

    def __init__(self, model: Model):
        self.model = model
        if model.toxic:
            self.ordinary = _compressor(model.ground)
            self.toxic = _compressor(model.ground + model.toxic)

    def gains(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that the toxic dictionary saves over the ordinary one for each window, and each text's number of windows."""
        data = [t.lower().encode() for t in texts]
        sizes = np.array([len(d) for d in data], np.int64)
        counts = np.where(sizes > 0, np.maximum(0, -(-(sizes - WINDOW) // STRIDE)) + 1, 0)
        flat, begin = b"".join(data), np.cumsum(sizes) - sizes
        inside = STRIDE * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
        at = np.stack([np.repeat(begin, counts) + inside, np.minimum(WINDOW, np.repeat(sizes, counts) - inside)], axis=1)
        out = [np.zeros(0, np.int64)]
        for i in range(0, len(at), SLICE):
            part = at[i : i + SLICE] - [at[i, 0], 0]
            windows = zstandard.BufferWithSegments(flat[at[i, 0] : at[i, 0] + part[-1].sum()], part.astype(np.uint64).tobytes())
            a, b = (c.multi_compress_to_buffer(windows, threads=1) for c in (self.ordinary, self.toxic))
            out.append(np.array([len(a[k]) - len(b[k]) for k in range(len(a))], np.int64))
        return np.concatenate(out), counts

    def features(self, texts: list[str]) -> np.ndarray:
        """One row a text: the three largest gains, their mean, how many and what share reach each step, and the windows' number."""
        gains, counts = self.gains(texts)
        own = np.repeat(np.arange(len(texts)), counts)
        n = np.maximum(1, counts)
        top = np.zeros((len(texts), 3))
        order = np.lexsort((-gains, own))
        rank = np.arange(len(gains)) - np.repeat(np.cumsum(counts) - counts, counts)
        for k in range(3):
            at = order[rank == k]
            top[own[at], k] = gains[at]
        reach = np.stack([np.bincount(own, gains >= s, len(texts)) for s in STEPS], axis=1)
        return np.c_[top, np.bincount(own, gains, len(texts)) / n, np.log1p(reach), reach / n[:, None], np.log(n)]

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.model.toxic or not texts:
            return np.zeros(len(texts))
        m = self.model
        x = (self.features(texts) - m.centre) / m.scale
        return 1 / (1 + np.exp(-np.clip(x @ np.array(m.weights[1:]) + m.weights[0], -30, 30)))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def fit(toxic: list[str], ordinary: list[str], parts: int = 3) -> Model:
    """Dictionaries from all texts; the threshold from each part seen through a toxic dictionary of the others."""
    if min(len(toxic), len(ordinary)) < 2 * parts:
        return Model()
    pieces = [p for t in ordinary for p in _cut(t.lower().encode(), 256)]
    ground = _train(pieces[:: max(1, -(-len(pieces) * 256 // GROUND_SAMPLE))], GROUND_BYTES, 64, 8)
    spans = residues(toxic, ordinary, parts)
    own = [_train(_cut(b" ".join(found), PIECE), TOXIC_BYTES, 16, 6) for found in spans]
    if not all(own):
        return Model()
    rows, y = [], []
    for k in range(parts):
        scorer = Scorer(Model(ground, own[k]))
        for label, texts in ((1, toxic), (0, ordinary)):
            part = texts[k::parts]
            rows += [scorer.features(part[i : i + 256]) for i in range(0, len(part), 256)]
            y += [label] * len(part)
    x, y = np.concatenate(rows), np.array(y, float)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - centre) / scale]
    w = _logistic(z, y)
    w[0] -= _threshold(z @ w, y)
    return Model(ground, own[parts], tuple(centre), tuple(scale), tuple(w))


def _strings(texts: list[str], length: int, most: int = 2 << 20) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Texts joined in slices of about ``most`` bytes: the bytes, the string (at most six bytes) that begins
    at each place, as a number, and the number of the place's text."""
    data = [t.lower().encode() + b"\0" for t in texts]
    first = 0
    while first < len(data):
        end, size = first, 0
        while end < len(data) and (size == 0 or size + len(data[end]) <= most):
            size += len(data[end])
            end += 1
        raw = b"".join(data[first:end])
        flat = np.frombuffer(raw + b"\0" * length, np.uint8)
        at = np.zeros(len(raw), np.uint64)
        for j in range(length):
            at <<= np.uint64(8)
            at |= flat[j : j + len(raw)]
        yield raw, at, np.repeat(np.arange(first, end), [len(d) for d in data[first:end]])
        first = end


def residues(toxic: list[str], ordinary: list[str], parts: int) -> list[list[bytes]]:
    """The spans of toxic texts that ordinary text does not account for, in text order: without each part, then of all."""
    out: list[list[bytes]] = [[] for _ in range(parts + 1)]
    for length in GRAMS:
        known = _repeated(toxic, length)
        n, m = (_holders(texts, length, known, parts) for texts in (toxic, ordinary))
        own = []
        for k in range(parts + 1):
            counted = [(x.sum(axis=1) - x[:, k], len(t) - len(t[k::parts])) if k < parts else (x.sum(axis=1), len(t)) for x, t in ((n, toxic), (m, ordinary))]
            own.append(known[_marking(*counted[0], *counted[1])])
        for raw, at, text in _strings(toxic, length):
            for k in range(parts + 1):
                hit = _find(own[k], at)[1]
                if k < parts:
                    hit &= text % parts != k
                begin = np.flatnonzero(hit)
                if len(begin):
                    gap = np.diff(begin) > length
                    out[k] += [raw[a : e + length] for a, e in zip(begin[np.r_[True, gap]].tolist(), begin[np.r_[gap, True]].tolist(), strict=True)]
    return out


def _marking(n: np.ndarray, toxic: int, m: np.ndarray, ordinary: int) -> np.ndarray:
    """Which strings toxic texts hold far more often than ordinary ones."""
    return (n >= max(LEAST_TEXTS, LEAST_SHARE * toxic)) & (n / max(1, toxic) >= LIFT * (m + 0.5) / max(1, ordinary))


def _pairs(at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Distinct pairs of a string and a text that holds it, in order; the text's number takes the low 16 bits beside six bytes."""
    both = np.sort((at << np.uint64(16)) | text.astype(np.uint64))
    return both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both


def _repeated(texts: list[str], length: int) -> np.ndarray:
    """The strings that at least ``LEAST_TEXTS`` texts hold, in order."""
    value = np.sort(np.concatenate([np.zeros(0, np.uint64), *(_pairs(at, text) for _, at, text in _strings(texts, length))])) >> np.uint64(16)
    first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, np.int64)
    return value[first[np.diff(np.r_[first, len(value)]) >= LEAST_TEXTS]]


def _holders(texts: list[str], length: int, known: np.ndarray, parts: int) -> np.ndarray:
    """How many texts of each part hold each known string, (strings, parts)."""
    out = np.zeros(len(known) * parts, np.int64)
    for _, at, text in _strings(texts, length):
        pairs = _pairs(at, text)
        k, there = _find(known, pairs >> np.uint64(16))
        out += np.bincount(k[there] * parts + (pairs[there] & np.uint64(0xFFFF)).astype(np.int64) % parts, minlength=len(out))
    return out.reshape(-1, parts)


def _find(known: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each string stands in the sorted ``known``, and whether it does."""
    if not len(known):
        return np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    k = np.minimum(np.searchsorted(known, at), len(known) - 1)
    return k, known[k] == at


def _cut(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size) if len(data[i : i + size]) >= 16]


def _train(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A trained dictionary; too few samples for the trainer serve as they are."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _logistic(z: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(z.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + penalty, z.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _threshold(margin: np.ndarray, y: np.ndarray) -> float:
    """Where to part the calibration texts for the best F-measure that prefers precision a little (beta 0.7)."""
    order = np.argsort(-margin, kind="stable")
    hits = np.cumsum(y[order])
    f = 1.49 * hits / (np.arange(1, len(y) + 1) + 0.49 * y.sum())
    best = int(f.argmax())
    after = margin[order[min(best + 1, len(y) - 1)]]
    return float((margin[order[best]] + after) / 2)


def held_out(doc_id: str = "doc_id"):
    """Whether a row belongs to the fold that is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample of labelled rows outside the held-out fold.

    The sizes of the sampled texts come first; which texts fit into ``SAMPLE_BYTES`` is settled by them, so
    no more than that reaches the driver.
    """
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other")
    order = F.xxhash64("doc_id")
    ids = [known.where(F.col("toxic") == label).select("doc_id", "toxic").orderBy(order, "doc_id").limit(most) for label, most in SAMPLE_ROWS.items()]
    ids = F.broadcast(ids[0].unionByName(ids[1]))  # at most SAMPLE_ROWS ids
    texts = docs.select("doc_id", "text").where("text is not null")
    sizes = texts.join(ids, "doc_id").groupBy("doc_id", F.xxhash64("text").alias("mark")).agg(F.min("toxic").alias("toxic"), F.max(F.octet_length("text")).alias("size"))
    sizes = materialise(sizes, "toxicity-sizes")
    chosen = []
    for label, most in SAMPLE_ROWS.items():
        room = SAMPLE_BYTES[label]
        for r in sizes.where(F.col("toxic") == label).orderBy(order, "doc_id", "mark").limit(most).collect():
            if r["size"] <= room:
                room -= r["size"]
                chosen.append((r["doc_id"], r["mark"], label, len(chosen)))
    if not chosen:
        return Model()
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, mark long, toxic int, nth int"))  # as many rows as the sample
    same = texts.join(wanted, "doc_id").where(F.xxhash64("text") == F.col("mark"))
    found = {r["nth"]: r for r in same.groupBy("nth").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")).collect()}
    return fit(*([r["text"] for _, r in sorted(found.items()) if r["toxic"] == label] for label in (1, 0)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: one narrow pass."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # dictionaries of fixed size
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.scores(texts_of(b.column(1))), pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every row as the query's contract lays down."""
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows judged toxic, all columns and repeated rows kept."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(learn(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in slices(batches, at):
            yield b.filter(pa.array(scorer.scores(texts_of(b.column(at))) < 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
