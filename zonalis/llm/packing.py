"""Packing by deficit round-robin: every window holds each source's share of the tokens, and windows are cut into sequences.

A source's documents, in the order in which they are read, are its queue. In each window every queue is owed its share of
the window; it gives whole tokens, and what it is owed beyond them is carried to the next window. As queues never run dry
before the last window, what queue j has given before window k is known without going through the windows: with the
queues one after another on a line of length 1, each queue gives the tokens between its borders, and a border before
window k lies at floor(border * k * window). So documents are placed where they are: one pass tokenizes them and notes how
many tokens of the source came before in the same task; sums over tasks say where a task's part of a queue starts; a second
pass places each document and cuts it. Tokens are shuffled only if the table of these starts is too large to broadcast.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis.llm.shared import small_batches, written

#: Ids per sequence, and the id after each document.
LENGTH, END = 2048, 1
#: Texts of more characters are tokenized by the slower library, which has no bound on runs of white space.
LONG_TEXT = 100_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tokens:
    """The ids of a byte-level BPE file of the tokenizers library; the strings of special tokens are ordinary text.

    tiktoken gives the same ids from the same file's vocabulary in a fourth of the time.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        special = {t["content"] for t in content["added_tokens"]}
        # Printable bytes stand for themselves in such a file, the others for the letters from 256 on, in order.
        itself = {*range(33, 127), *range(161, 173), *range(174, 256)}
        byte_of = {chr(b): b for b in itself} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in itself)}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in content["model"]["vocab"].items() if word not in special}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if len(text) > LONG_TEXT:
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=2)
def _tokens(path: str, pattern: str) -> Tokens:
    return Tokens(path, pattern)


def tokenized(docs: DataFrame, path: str, pattern: str, end: int = END) -> DataFrame:
    """doc_id, source, part, before, n, ids (little-endian unsigned 32-bit): before counts the source's tokens earlier in the task called part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = _tokens(path, pattern), TaskContext.get().partitionId()
        given: dict[str | None, int] = {}
        for batch in batches:
            rows = []
            for source, text in zip(batch.column("source").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*tokens.ids(text or ""), end], "<u4")
                rows.append((given.get(source, 0), len(ids), ids.tobytes()))
                given[source] = given.get(source, 0) + len(ids)
            before, n, ids = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [batch.column("doc_id").cast(pa.int64()), batch.column("source").cast(pa.string()), pa.array([part] * len(rows), pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "part", "before", "n", "ids"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, part int, before long, n long, ids binary")


class Schedule:
    """Where the tokens of each queue go. sizes: tokens of each queue, each at least one in a window of so many ids."""

    def __init__(self, sizes: list[int], window: int, length: int):
        self.total, self.window, self.length = sum(sizes), window, length
        # Products of two positions must not overflow: Python's own integers where they would.
        kind = np.int64 if self.total < 1 << 31 else object
        self.borders = np.array([0, *np.cumsum(np.array(sizes, object))], kind)

    def border(self, j: np.ndarray, k: np.ndarray) -> np.ndarray:
        """What the queues before number j give before window k."""
        return self.borders[j] * np.minimum(k * self.window, self.total) // max(self.total, 1)

    def given(self, j: np.ndarray, k: np.ndarray) -> np.ndarray:
        return self.border(j + 1, k) - self.border(j, k)

    def window_of(self, j: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The window of the queue's token number at."""
        k = at * self.total // ((self.borders[j + 1] - self.borders[j]) * self.window)
        while (late := self.given(j, k) > at).any():
            k = k - late
        while (early := self.given(j, k + 1) <= at).any():
            k = k + early
        return k

    def pieces(self, j: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cuts runs of n tokens from number first of queue j: (run, tokens of the run before the piece, length, sequence, offset)."""
        j, first, n = (np.asarray(x).astype(self.borders.dtype) if x is not j else np.asarray(x) for x in (j, first, n))
        low, high = self.window_of(j, first), self.window_of(j, first + n - 1)
        run, k = _spread(low, high)
        start, stop = np.maximum(first[run], self.given(j[run], k)), np.minimum(first[run] + n[run], self.given(j[run], k + 1))
        held = stop > start
        run, k, start, stop = run[held], k[held], start[held], stop[held]
        at = k * self.window + self.border(j[run], k + 1) - self.border(j[run], k) + start - self.given(j[run], k)
        # Cut once more, where sequences end.
        (one, offset), (last, _) = self.sequence(at), self.sequence(at + stop - start - 1)
        piece, sequence = _spread(one, last)
        begins = self.starts(sequence)
        begin, end = np.maximum(at[piece], begins), np.minimum(at[piece] + stop[piece] - start[piece], self.starts(sequence + 1))
        return run[piece], start[piece] + begin - at[piece] - first[run[piece]], end - begin, sequence, begin - begins

    @property
    def full(self) -> int:
        return self.total // self.length

    def starts(self, sequence: np.ndarray) -> np.ndarray:
        """The first token of each sequence. What is left after the full ones has lengths that are powers of two, largest first."""
        left, tail = self.total - self.full * self.length, [0]
        for bit in reversed(range(self.length.bit_length())):
            if left >> bit & 1:
                tail.append(tail[-1] + (1 << bit))
        tail = np.array(tail, self.borders.dtype)
        return np.minimum(sequence, self.full) * self.length + tail[np.clip(sequence - self.full, 0, len(tail) - 1).astype(np.int64)]

    def sequence(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence of each token, and its place there."""
        tail = self.starts(np.arange(self.full, self.full + self.length.bit_length() + 1).astype(self.borders.dtype))
        number = np.where(at < self.full * self.length, at // self.length, self.full + np.searchsorted(np.unique(tail), at, "right") - 1)
        number = number.astype(self.borders.dtype)
        return number, at - self.starts(number)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from low to high of each row: (row, number)."""
    counts = (high - low + 1).astype(np.int64)
    row = np.repeat(np.arange(len(low)), counts)
    return row, low[row] + (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts))


def pack(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, window: int | None = None, end: int = END) -> DataFrame:
    """Pieces of docs in sequences of length ids, a power of two: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every window (one sequence, unless window names a multiple of its length) holds each source's share of all tokens,
    within two tokens, and what a source is owed never reaches two; a longer window cuts documents less often. Nothing is padded: after the last full sequence the
    rest goes to sequences whose lengths are powers of two. A source that is owed less than one token a window has no
    queue of its own: its documents stand between those of the largest source. So there are at most as many queues as ids
    in a window, and only their sizes come to the driver.

    Null text counts as empty and has the id after a document only; null source is a source; null doc_id stays null.
    Rows of one doc_id are documents of their own, repeated rows too. Columns other than doc_id, source and text are
    ignored; an empty table gives an empty result. A document's ids are in memory at once.
    """
    window = window or length
    if length & (length - 1) or window % length:
        raise ValueError(f"length {length} must be a power of two, and window {window} a multiple of it")
    spark = docs.sparkSession
    rows = written(tokenized(docs, path, pattern, end), "packed-ids")
    key = [F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("unnamed")]
    parts = written(rows.groupBy("part", *key).agg(F.sum("n").alias("n")), "packed-parts")
    sources = parts.groupBy("name", "unnamed").agg(F.sum("n").alias("n"))
    total = sources.agg(F.sum("n")).first()[0] or 0
    own = sources.where(F.col("n") * window >= F.lit(total)).orderBy(F.col("n").desc(), "unnamed", "name").collect()
    if not own:  # no rows, or sources that are all tiny
        own = sources.orderBy(F.col("n").desc(), "unnamed", "name").limit(1).collect()
    sizes = [r.n for r in own]
    if own:
        sizes[0] += total - sum(sizes)  # what has no queue of its own
    schedule = Schedule(sizes, window, length)
    queues = spark.createDataFrame([(r.name, r.unnamed, j) for j, r in enumerate(own)], "name string, unnamed boolean, queue int")
    parts = parts.join(queues, ["name", "unnamed"], "left").withColumn("queue", F.coalesce("queue", F.lit(0)))
    before = W.partitionBy("queue").orderBy("part", "unnamed", "name").rowsBetween(W.unboundedPreceding, -1)
    starts = written(parts.select("part", "name", "unnamed", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("starts")), "packed-starts")
    placed = rows.select("doc_id", "part", "before", "n", "ids", *key).join(starts, ["part", "name", "unnamed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            n = number("n")
            row, start, size, sequence, offset = schedule.pieces(number("queue").astype(np.int64), number("first"), n)
            ids = [memoryview(x.as_buffer()) for x in batch.column("ids")]
            crc = [zlib.crc32(ids[r][4 * a : 4 * (a + m)]) for r, a, m in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
            whole = lambda x: pa.array(np.asarray(x).astype(np.int64), pa.int64())
            columns = [batch.column("doc_id").take(pa.array(row)), whole(start), whole(size), pa.array(crc, pa.int64()), whole(n[row]), whole(sequence), whole(offset)]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PIECES.split(", ")])

    return placed.select("doc_id", "n", "ids", "queue", (F.col("starts") + F.col("before")).alias("first")).mapInArrow(run, PIECES)
