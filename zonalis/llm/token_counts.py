"""Token counts that follow edits.

Each document keeps a segment tree. Its leaves are buckets of neighbouring pre-tokens, of which the lengths and the
token counts are kept; its nodes are the sums of both below them. An edit finds its place by the sums of lengths, goes
back to the last pre-token that could not see it, and splits the text again from there, only until a new boundary meets
an old one beyond the edit: what follows is the same text from the same place, so its pre-tokens are as they were. Only
the pre-tokens between are encoded again, and only the sums above their buckets change.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.llm.byte_bpe import CHUNK, REMEMBERED, REMEMBERED_BYTES, Ranks, _ranks, encode_words
from zonalis.llm.shared import small_batches

#: Pre-tokens of a bucket; one that has grown to GROWN is cut into buckets again.
BUCKET, GROWN = 64, 256
#: Code points that the pattern looks at, at most, behind the end of a match: a run of white space leaves one for the
#: next word, and an apostrophe tries two letters.
CONTEXT = 2

#: A document with its tree: leaves in order of the text, how many each bucket has, then the sums, root at 1 and the
#: children of k at 2k and 2k + 1.
TREE = "doc_id long, text string, lengths array<int>, counts array<int>, buckets array<int>, node_chars array<long>, node_tokens array<long>"


class Counts:
    """Tokens of pre-tokens; short ones are remembered."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self.known: dict[str, int] = {}
        self.passing: list[str] = []

    def of(self, words: set[str]) -> dict[str, int]:
        """A table with at least these words, until the next call."""
        for w in self.passing:
            del self.known[w]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        self.passing = [w for w in new if len(w) > REMEMBERED_BYTES]
        for w, ids in zip(new, encode_words(self.ranks, [w.encode() for w in new]), strict=True):
            self.known[w] = len(ids) // 4
        return self.known


def even(leaves: int) -> np.ndarray:
    """The sizes of buckets of so many leaves: BUCKET, and what is left in the last."""
    return np.diff(np.append(np.arange(0, leaves, BUCKET), leaves)).astype(np.int32)


def node_sums(leaves: np.ndarray) -> np.ndarray:
    """The nodes over even buckets of leaves, as a heap with a power of two of buckets."""
    n = -(-len(leaves) // BUCKET)
    width = 1
    while width < n:
        width *= 2
    nodes = np.zeros(2 * width, np.int64)
    if n:
        nodes[width : width + n] = np.add.reduceat(leaves, np.arange(0, len(leaves), BUCKET), dtype=np.int64)
    while width > 1:
        nodes[width // 2 : width] = nodes[width : 2 * width : 2] + nodes[width + 1 : 2 * width : 2]
        width //= 2
    return nodes


class Tree:
    """One document's tree. The words of a bucket are cut from the text when an edit first needs them."""

    def __init__(self, text: str, lengths: np.ndarray, counts: np.ndarray, buckets: np.ndarray, chars: np.ndarray, tokens: np.ndarray):
        self._start(text, lengths, counts, buckets, chars, tokens)
        self.encoded = 0

    def _start(self, text, lengths, counts, buckets, chars, tokens) -> None:
        self.text, self.lengths, self.counts, self.chars, self.tokens = text, lengths, counts, chars.copy(), tokens.copy()
        self.width = len(chars) // 2
        sizes = np.zeros(self.width, np.int64)
        sizes[: len(buckets)] = buckets
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.opened: dict[int, tuple[list[str], list[int | None]]] = {}
        self.at_start = self.chars.copy()

    def _before(self, nodes: np.ndarray, b: int) -> int:
        """The sum of the buckets before b."""
        total, k = 0, b + self.width
        while k > 1:
            if k & 1:
                total += int(nodes[k - 1])
            k >>= 1
        return total

    def _bucket(self, b: int) -> tuple[list[str], list[int | None]]:
        if b not in self.opened:
            here = slice(int(self.first[b]), int(self.first[b + 1]))
            lengths = self.lengths[here].tolist()
            at, words = self._before(self.at_start, b), []
            for n in lengths:
                words.append(self.text[at : at + n])
                at += n
            self.opened[b] = (words, self.counts[here].tolist())
        return self.opened[b]

    def _find(self, place: int) -> tuple[int, int]:
        """The bucket of the code point at place, and where the bucket starts; the last place is in the last bucket with text."""
        place = max(0, min(place, int(self.chars[1]) - 1))
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if place - start >= self.chars[k]:
                start += int(self.chars[k])
                k += 1
        return k - self.width, start

    def _set(self, b: int, words: list[str], counts: list[int | None]) -> None:
        self.opened[b] = (words, counts)
        change = sum(map(len, words)) - int(self.chars[b + self.width])
        k = b + self.width
        while k:
            self.chars[k] += change
            k >>= 1

    def edit(self, split: regex.Pattern, start: int, removed: int, inserted: str) -> None:
        """Replaces removed code points from start by inserted. What lies outside of the text counts as its end."""
        size = int(self.chars[1])
        start = max(0, min(start, size))
        stop = max(start, min(start + removed, size))
        if stop == start and not inserted:
            return
        # The first pre-token that may have seen the edit: the first that ends after start - CONTEXT.
        first, at = self._find(start - CONTEXT)
        words, counts = self._bucket(first)
        keep = 0
        while keep < len(words) and at + len(words[keep]) <= start - CONTEXT:
            at += len(words[keep])
            keep += 1
        head = (words[:keep], counts[:keep])
        # Old pre-tokens from there on, taken as needed; ends are places in the old text.
        old: list[tuple[str, int | None]] = []
        ends: list[int] = []
        last, shift = first - 1, len(inserted) - (stop - start)

        def more() -> bool:
            nonlocal last
            if last + 1 >= self.width:
                return False
            last += 1
            got = self._bucket(last)
            for pair in list(zip(*got, strict=True))[keep if last == first else 0 :]:
                old.append(pair)
                ends.append((ends[-1] if ends else at) + len(pair[0]))
            return True

        while (not ends or ends[-1] < stop + CONTEXT + 1) and more():
            pass
        while True:  # with more old text each time, until the boundaries meet or the text ends
            region = "".join([w for w, _ in old])
            region = region[: start - at] + inserted + region[stop - at :]
            whole = last + 1 >= self.width
            met = {at + shift: 0} | {end + shift: k + 1 for k, end in enumerate(ends)}
            new, place, same = [], at, None
            for m in split.finditer(region):
                if place >= start + len(inserted) and place in met:
                    same = met[place]
                    break
                if not whole and m.end() + CONTEXT >= len(region):
                    break
                new.append(m.group())
                place += len(new[-1])
            if same is not None or whole:
                break
            for _ in range(last - first + 1):
                more()
        self.encoded += len(new)
        tail = old[len(old) if same is None else same :]
        for b in range(first + 1, last + 1):
            self._set(b, [], [])
        self._set(first, head[0] + new + [w for w, _ in tail], head[1] + [None] * len(new) + [c for _, c in tail])
        if len(self.opened[first][0]) > GROWN:
            self._again()

    def _again(self) -> None:
        """Cuts the leaves into buckets again. New ones keep a count of -1 until they are encoded."""
        text, lengths, counts, _ = self.leaves()
        self._start(text, lengths, counts, even(len(lengths)), node_sums(lengths), node_sums(np.maximum(counts, 0)))
        for b in np.unique(np.flatnonzero(counts < 0) // BUCKET).tolist():
            words, some = self._bucket(b)
            self.opened[b] = (words, [None if c < 0 else c for c in some])

    def pending(self) -> Iterator[str]:
        return (w for words, counts in self.opened.values() for w, c in zip(words, counts, strict=True) if c is None)

    def fill(self, table: dict[str, int]) -> None:
        """Puts in the counts of what was encoded, and the sums above."""
        for b, (words, counts) in self.opened.items():
            filled = [table[w] if c is None else c for w, c in zip(words, counts, strict=True)]
            self.opened[b] = (words, filled)
            change = sum(filled) - int(self.tokens[b + self.width])
            k = b + self.width if change else 0
            while k:
                self.tokens[k] += change
                k >>= 1

    def leaves(self) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """The text now, its leaves (lengths and counts, -1: not encoded yet), and how many each bucket has."""
        sizes = np.diff(self.first).astype(np.int32)
        if not self.opened:
            return self.text, self.lengths, self.counts, sizes
        texts, lengths, counts, at, done = [], [], [], 0, 0
        for b in sorted(self.opened):
            start = self._before(self.at_start, b)
            texts.append(self.text[at:start])
            lengths.append(self.lengths[done : self.first[b]])
            counts.append(self.counts[done : self.first[b]])
            words, some = self.opened[b]
            texts += words
            lengths.append(np.fromiter(map(len, words), np.int32, len(words)))
            counts.append(np.fromiter((-1 if c is None else c for c in some), np.int32, len(some)))
            at, done, sizes[b] = start + int(self.at_start[b + self.width]), int(self.first[b + 1]), len(words)
        texts.append(self.text[at:])
        lengths.append(self.lengths[done:])
        counts.append(self.counts[done:])
        return "".join(texts), np.concatenate(lengths), np.concatenate(counts), sizes


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """Texts that are encoded together: up to CHUNK code points, or one that is longer."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def _tree_columns(ids: pa.Array, texts: list[str], lengths: list[np.ndarray], counts: list[np.ndarray], buckets: list[np.ndarray], chars: list[np.ndarray], tokens: list[np.ndarray]) -> list[pa.Array]:
    small, large = pa.int32(), pa.int64()
    return [ids.cast(large), pa.array(texts, pa.string()), _lists(lengths, small), _lists(counts, small), _lists(buckets, small), _lists(chars, large), _lists(tokens, large)]


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def with_trees(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per row of docs with its tree (TREE). path: a file of ranks on each executor.

    Null text counts as empty: no leaves, and a root of 0. Equal texts get equal trees; columns other than doc_id and
    text are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, split = Counts(_ranks(path)), regex.compile(pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            lengths, counts = [], []
            for some in chunks(texts):
                words = [split.findall(t) for t in some]
                table = counter.of(set(chain.from_iterable(words)))
                lengths += [np.fromiter(map(len, w), np.int32, len(w)) for w in words]
                counts += [np.fromiter(map(table.__getitem__, w), np.int32, len(w)) for w in words]
            columns = _tree_columns(batch.column("doc_id"), texts, lengths, counts, [even(len(x)) for x in lengths], [node_sums(x) for x in lengths], [node_sums(x) for x in counts])
            yield pa.RecordBatch.from_arrays(columns, _names(TREE))

    return docs.select("doc_id", "text").mapInArrow(run, TREE)


def apply_edits(trees: DataFrame, path: str, pattern: str) -> DataFrame:
    """The trees after their edits: TREE, tokens_before and pretokens_encoded (how many were encoded again).

    trees: TREE and edits array<struct<start int, removed int, inserted string>>, applied in order, each to the text that
    those before it left; places are code points. A null array or edit changes nothing; a null start or removed is 0, a
    null inserted is empty; places outside of the text are its ends. An empty table gives an empty result.
    """
    small_batches(trees.sparkSession)
    schema = TREE + ", tokens_before long, pretokens_encoded long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, split = Counts(_ranks(path)), regex.compile(pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            parts = []
            for name in _names(TREE)[2:]:
                column = batch.column(name)
                ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
                parts.append([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
            trees_ = [Tree(*row) for row in zip(texts, *parts, strict=True)]
            before = [int(t.tokens[1]) for t in trees_]
            for tree, edits in zip(trees_, batch.column("edits").to_pylist(), strict=True):
                for e in edits or []:
                    if e:
                        tree.edit(split, e["start"] or 0, e["removed"] or 0, e["inserted"] or "")
            table = counter.of(set(chain.from_iterable(t.pending() for t in trees_)))
            for tree in trees_:
                tree.fill(table)
            leaves = [t.leaves() for t in trees_]
            new_texts, lengths, counts, buckets = map(list, zip(*leaves, strict=True)) if leaves else ([], [], [], [])
            columns = _tree_columns(batch.column("doc_id"), new_texts, lengths, counts, buckets, [t.chars for t in trees_], [t.tokens for t in trees_])
            columns += [pa.array(before, pa.int64()), pa.array([t.encoded for t in trees_], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, _names(schema))

    return trees.select(*_names(TREE), "edits").mapInArrow(run, schema)


def revision(doc_id: Column, text: Column) -> Column:
    """Three edits of each document: a note goes in, 40 code points go, and 12 give way to others, at places spread by doc_id."""
    spot = F.crc32(doc_id.cast("string").cast("binary"))
    size = F.length(F.coalesce(text, F.lit(""))) + 1

    def one(factor: int, removed: int, inserted: Column) -> Column:
        return F.struct(F.pmod(spot * factor, size).cast("int").alias("start"), F.lit(removed).alias("removed"), inserted.alias("inserted"))

    note = F.concat(F.lit(" (revision of "), F.coalesce(doc_id.cast("string"), F.lit("none")), F.lit(") "))
    return F.array(one(1, 0, note), one(7, 40, F.lit("")), one(13, 12, F.lit("it's  been\n\nread")))


def totals(trees: DataFrame) -> DataFrame:
    """doc_id, n_tokens (before the edits), n_tokens_edited, n_chars_edited, n_pretokens_encoded: the roots' sums."""
    return trees.select(
        "doc_id",
        F.col("tokens_before").alias("n_tokens"),
        F.col("node_tokens")[1].alias("n_tokens_edited"),
        F.col("node_chars")[1].alias("n_chars_edited"),
        F.col("pretokens_encoded").alias("n_pretokens_encoded"),
    )
