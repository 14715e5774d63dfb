"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

Texts are cut into pre-tokens; pre-tokens not met before are encoded together. Their symbols lie in
one flat array; in each round the lowest-ranked pair of every word is found by binary search over the
sorted pair keys and merged, for all words at once, until no word has a pair left.

Defined cases: a null text is the empty text and gives no ids; repeated rows are each encoded; null
ids of rows are kept; an empty table gives an empty result; very long texts are held whole, other texts in
slices of bounded bytes; of pairs of one rank the leftmost merges first, as ties go in the tokenizers
library; a special token's string in a text becomes that token, as there; other columns are not read, so
their names do not matter.
"""

from __future__ import annotations

import gc
import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.llm.common import ship, slices, texts_of

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of pre-tokens and of pieces between spaces that a worker remembers (with their ids, and ``ENTRY`` for the
#: objects); beyond it the memory starts anew after the slice.
CACHE_BYTES, ENTRY = 96 << 20, 180
_NONE = np.int64(1) << 40


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Bpe:
    """One vocabulary, compiled; ``spec`` is the JSON text of a tokenizers file."""

    def __init__(self, spec: str):
        read = json.loads(spec)
        model, letters = read["model"], byte_alphabet()
        vocab = model["vocab"]
        back = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in read["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.split = regex.compile(PATTERN).findall
        self.at_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.room = {"words": CACHE_BYTES, "pieces": CACHE_BYTES}

    # -- merge rounds -------------------------------------------------------------------------

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge_rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and where each word ends, by rounds over one flat array of symbols."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        wid = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(sym), _NONE)
        if len(sym) > 1:
            inside = wid[1:] == wid[:-1]
            rank[:-1][inside] = self._rank(sym[:-1][inside], sym[1:][inside])
        done_sym, done_wid = [], []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, wid[1:] != wid[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            least = np.minimum.reduceat(rank, starts)
            open_ = least < _NONE
            if not open_.all():
                live = np.repeat(open_, sizes)
                done_sym.append(sym[~live])
                done_wid.append(wid[~live])
                sym, wid, rank = sym[live], wid[live], rank[live]
                least, sizes = least[open_], sizes[open_]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            # hits that overlap (a run of one pair) merge from the left, every other one
            run = np.r_[True, np.diff(hit) != 1]
            first = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            sym[hit] = self.merged[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            sym, wid, rank = sym[keep], wid[keep], rank[keep]
            hit = moved[hit]
            stale = np.concatenate((hit, hit[hit > 0] - 1))
            rank[stale] = _NONE
            stale = stale[stale + 1 < len(sym)]
            stale = stale[wid[stale] == wid[stale + 1]]
            rank[stale] = self._rank(sym[stale], sym[stale + 1])
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        all_sym, all_wid = np.concatenate(done_sym), np.concatenate(done_wid)
        order = np.argsort(all_wid, kind="stable")
        return all_sym[order], np.cumsum(np.bincount(all_wid, minlength=len(words)))

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.words]
        if not new:
            return
        ids, ends = self.merge_rounds([w.encode() for w in new])
        raw, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        self.words.update(zip(new, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        self.room["words"] -= len(raw) + sum(map(len, new)) + ENTRY * len(new)

    # -- texts --------------------------------------------------------------------------------

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.

        A text is cut at single spaces first, as pre-tokens never reach over a space that follows a
        character which is no white space; pieces that start with white space or are empty send
        their text to the pattern as a whole.
        """
        watched = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and each pass of the collector walks all that is remembered
        try:
            return self._encode_batch(texts)
        finally:
            for name in ("words", "pieces"):
                if self.room[name] < 0:
                    getattr(self, name).clear()
                    self.room[name] = CACHE_BYTES
            if watched:
                gc.enable()

    def _encode_batch(self, texts: list[str]) -> list[bytes]:
        get = self.pieces.get
        cut = [self._sections(t) for t in texts]
        plans: list[list] = []  # of each text: bytes, or [lists of words, pieces, what is known of them]
        unknown: set[str] = set()
        whole: set[str] = set()
        for sections in cut:
            plan: list = []
            for s in sections:
                if isinstance(s, bytes):
                    plan.append(s)
                    continue
                head, *rest = s.split(" ")
                known = list(map(get, rest))
                if None in known:
                    lost = {c for c, k in zip(rest, known) if k is None}  # noqa: B905
                    if "" in lost or any([c[0].isspace() for c in lost]):
                        words = self.split(s)
                        whole.update(words)
                        plan.append((words, [], []))
                        continue
                    unknown.update(lost)
                words = self.split(head)
                whole.update(words)
                plan.append((words, rest, known))
            plans.append(plan)
        parts = {c: self._pretokens(c) for c in unknown}
        for words in parts.values():
            whole.update(words)
        self._learn(whole)
        ids = self.words
        for c, words in parts.items():
            self.pieces[c] = b"".join([ids[w] for w in words])
            self.room["pieces"] -= len(c) + len(self.pieces[c]) + ENTRY
        pieces = self.pieces
        out = []
        for plan in plans:
            flat: list[bytes] = []
            for part in plan:
                if isinstance(part, bytes):
                    flat.append(part)
                    continue
                words, rest, known = part
                flat += [ids[w] for w in words]
                flat += [pieces[c] if k is None else k for c, k in zip(rest, known)] if None in known else known  # noqa: B905
            out.append(b"".join(flat))
        return out

    def _pretokens(self, piece: str) -> list[str]:
        """Pre-tokens of a space and ``piece``; plain words, with or without a mark behind, need no pattern."""
        if piece.isalpha():
            return [" " + piece]
        if piece[-1] in ".,;:!?" and piece[:-1].isalpha():
            return [" " + piece[:-1], piece[-1]]
        return self.split(" " + piece)

    def _sections(self, text: str) -> list:
        if self.at_special is None or not any(s in text for s in self.special):
            return [text] if text else []
        return [int(self.special[s]).to_bytes(4, "little") if s in self.special else s for s in self.at_special(text) if s]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[int, Bpe] = {}


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file, read once by the driver; a file of fixed size, 1 to 2 MB."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def loaded(spec: Broadcast) -> Bpe:
    """The compiled vocabulary of this worker."""
    key = zlib.crc32(spec.value.encode())
    if key not in _LOADED:
        _LOADED[key] = Bpe(spec.value)
    return _LOADED[key]


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the whole text of every row as an array of ids. One narrow pass."""
    ship(docs.sparkSession)
    spec, kind = vocabulary(docs.sparkSession, vocab_path), dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec)
        for b in slices(batches, 1):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode_batch(texts_of(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids; null ids give the empty text."""
    ship(encoded.sparkSession)
    spec, kind = vocabulary(encoded.sparkSession, vocab_path), dict(encoded.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec)
        for b in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Encode, decode, and give the digests that the query's contract lays down, in one pass."""
    ship(docs.sparkSession)
    spec = vocabulary(docs.sparkSession, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec)
        decimal = bpe.decimal.__getitem__
        for b in slices(batches, 1):
            n, ids_sha, text_sha = [], [], []
            for raw in bpe.encode_batch(texts_of(b.column(1))):
                ids = np.frombuffer(raw, "<u4").tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
