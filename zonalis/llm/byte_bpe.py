"""Byte-level BPE encoding and decoding.

A pre-token is encoded once per task and remembered. New pre-tokens go into padded matrices by length: in each round
every row looks up its neighbouring pairs in a hash table, merges its leftmost pair of least rank, and closes the gap.
Long pre-tokens, where a merge a round would take quadratic time, merge all places of that pair which come before any
newly formed pair of lower or equal rank; that is the same order of merges.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from zonalis.llm.shared import small_batches

#: Ranks of pairs that don't merge; also the padding.
NONE = np.int64(1 << 40)
#: Rows longer than this are merged one by one, many places a round.
LONG = 128
#: Pre-tokens remembered by a task, and the characters of one that is remembered at most.
REMEMBERED, REMEMBERED_BYTES = 200_000, 64
#: Characters of text that are split together.
CHUNK = 2_000_000


class Ranks:
    """A table of ranks (bytes -> id) with the pairs of ids that merge, as an open-addressed hash table."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.rank.values()) + 1)
        for token, i in self.rank.items():
            self.bytes_of[i] = token
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        pairs: dict[int, int] = {}
        for token, i in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = i
        keys = np.fromiter(pairs, np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int64, len(pairs))
        bits = max(4, int(np.ceil(np.log2(max(2 * len(keys), 2)))))
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int64)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        self.probes = 0
        while len(left):  # each round places one key a free slot; the others move on
            self.probes += 1
            free = self.keys[slot] == -1
            chosen, first = np.unique(slot[free], return_index=True)
            who = np.flatnonzero(free)[first]
            self.keys[chosen], self.ranks[chosen] = keys[left[who]], ranks[left[who]]
            stay = np.ones(len(left), bool)
            stay[who] = False
            left, slot = left[stay], (slot[stay] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE without one or next to padding."""
        keys = (left << 20) | right
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1) & (keys >= 0))
        at = slot[open_]
        for _ in range(self.probes + 1):
            if not len(open_):
                break
            at = (at + 1) & self.mask
            hit, empty = self.keys[at] == keys[open_], self.keys[at] == -1
            out[open_[hit]] = self.ranks[at[hit]]
            more = ~hit & ~empty
            open_, at = open_[more], at[more]
        return out


def merge_matrix(ranks: Ranks, rows: np.ndarray) -> np.ndarray:
    """rows: ids, padded with -1 at the end. Every row merges its leftmost pair of least rank each round."""
    done = np.full_like(rows, -1)
    live = np.arange(len(rows))
    while len(rows) and rows.shape[1] > 1:
        pair = ranks.lookup(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(len(rows), -1)
        at = pair.argmin(axis=1)
        best = pair[np.arange(len(rows)), at]
        ended = best == NONE
        if ended.any():
            done[live[ended], : rows.shape[1]] = rows[ended]
            rows, live, at, best = rows[~ended], live[~ended], at[~ended], best[~ended]
            if not len(rows):
                break
        cols = np.arange(rows.shape[1] - 1)
        rows[np.arange(len(rows)), at] = best
        rows = np.where(cols[None, :] > at[:, None], rows[:, 1:], rows[:, :-1])
    done[live, : rows.shape[1]] = rows
    return done


def merge_long(ranks: Ranks, ids: np.ndarray) -> np.ndarray:
    """One row: each round merges the least pair at all places from the left that don't depend on a newly formed pair."""
    while len(ids) > 1:
        pair = ranks.lookup(ids[:-1].copy(), ids[1:].copy())
        best = pair.min()
        if best == NONE:
            break
        places = np.flatnonzero(pair == best)
        if len(places) > 1:  # of overlapping places every other one, from the left of each run
            runs = np.concatenate([[True], np.diff(places) > 1])
            start = places[np.maximum.accumulate(np.where(runs, np.arange(len(places)), 0))]
            places = places[(places - start) % 2 == 0]
        # The new neighbours of each place, those merged before it being merged: if one has a rank that isn't higher, stop after it.
        merged = ids.copy()
        merged[places] = best
        keep = np.ones(len(ids), bool)
        keep[places + 1] = False
        after = merged[keep]
        where = np.cumsum(keep)[places] - 1
        left = np.where(where > 0, ranks.lookup(after[np.maximum(where - 1, 0)], after[where]), NONE)
        # What stands to the right isn't merged yet when this place is.
        right_id = np.where(places + 2 < len(ids), ids[np.minimum(places + 2, len(ids) - 1)], -1)
        right = ranks.lookup(after[where], right_id)
        low = np.flatnonzero((left <= best) | (right <= best))
        if len(low) and low[0] + 1 < len(places):
            places = places[: low[0] + 1]
            merged = ids.copy()
            merged[places] = best
            keep = np.ones(len(ids), bool)
            keep[places + 1] = False
        ids = merged[keep]
    return ids


def encode_words(ranks: Ranks, new: list[bytes]) -> list[bytes]:
    """The ids of each pre-token, as little-endian unsigned 32-bit integers."""
    out = [b""] * len(new)
    lengths = np.fromiter(map(len, new), np.int64, len(new))
    for k in np.flatnonzero(lengths > LONG):
        whole = ranks.rank.get(new[k])
        ids = merge_long(ranks, ranks.byte_id[np.frombuffer(new[k], np.uint8)]) if whole is None else np.array([whole])
        out[k] = ids.astype("<u4").tobytes()
    width = 1
    while width <= LONG:
        which = np.flatnonzero((lengths > width // 2) & (lengths <= width))
        for at in range(0, len(which), 4096):
            some = which[at : at + 4096]
            rows = np.full((len(some), width), -1, np.int64)
            rows[np.arange(width)[None, :] < lengths[some, None]] = ranks.byte_id[np.frombuffer(b"".join([new[k] for k in some]), np.uint8)]
            rows = merge_matrix(ranks, rows)
            ends = np.cumsum((rows >= 0).sum(axis=1) * 4).tolist()
            flat = rows[rows >= 0].astype("<u4").tobytes()
            for k, start, end in zip(some.tolist(), [0, *ends], ends, strict=False):
                out[k] = flat[start:end]
        width *= 2
    for k, w in enumerate(new):  # a pre-token that is in the table is one id, whatever its merges are
        if (i := ranks.rank.get(w)) is not None and len(out[k]) > 4:
            out[k] = i.to_bytes(4, "little")
    return out


@lru_cache(maxsize=4)
def _ranks(path: str) -> Ranks:
    return Ranks(path)


class Encoder:
    def __init__(self, path: str, pattern: str):
        self.ranks, self.split = _ranks(path), regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, little-endian unsigned 32-bit. Texts are taken together up to CHUNK characters."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            parts = [self.split.findall(t) for t in texts[at:end]]
            new = list({w for p in parts for w in p if w not in self.known})
            extra: dict[str, bytes] = {}
            for w, ids in zip(new, encode_words(self.ranks, [w.encode() for w in new]), strict=True):
                (self.known if len(w) <= REMEMBERED_BYTES else extra)[w] = ids
            for p in parts:
                yield b"".join([self.known.get(w) or extra[w] for w in p] if extra else map(self.known.__getitem__, p))
            if len(self.known) > REMEMBERED:
                self.known.clear()
            at = end

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.bytes_of.__getitem__, memoryview(ids).cast("I")))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per row of docs: doc_id, ids (binary: little-endian unsigned 32-bit). path: a file of ranks on each executor.

    Null text counts as empty and has no ids. Columns other than doc_id and text are ignored; equal texts get equal ids;
    an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = pa.array(list(encoder.encode(texts)), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes each text: doc_id, n_tokens, ids_sha256, decoded_sha256. As encode() for odd rows."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in batches:
            rows = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(encoder.decode(i)).hexdigest()) for i in encoder.encode([t or "" for t in batch.column("text").to_pylist()])]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
