"""Grouping spelling variants: words at edit distance 1, by an index of grams of variable length.

The gram dictionary is a trie pruned by frequency: a gram that many words hold is no leaf but is made longer, up to a
bound. Only the frequent inner grams have to be known; their number is bounded by the threshold, so they are broadcast. A
word is decomposed into the leaves that start at its places, without those that lie within an earlier one. For each word,
all single edits are gone through, with an unknown letter standing for any, to count the grams that one edit can change.
A word near it holds the others; so of both words' grams, rarest first, the first ones (one more than can change) have one
in common. Their lists are merged, and pairs are verified.

Words all of whose grams one edit can change are merged once more among themselves, with shorter grams. Words of lists that
are longer than HOT are not compared with each other but by what is left of them without one letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.llm.shared import narrow, partitions, small_batches, written

#: Runs of letters, a multiplication and a division sign among them; only runs that can give words are taken.
LETTERS = r"A-Za-zÀ-ÿ"
#: Code points of the shortest word, and occurrences of the rarest.
SHORTEST, RAREST = 6, 5
#: Every so many-th word of a document loses a letter.
SLIPS = 199
#: Distinct words counted by a task before it hands them on.
COUNTED = 200_000
#: Shortest and longest gram; a gram is frequent if it stands at more than one in INNER places. So a length has at most INNER frequent grams.
GRAMS, INNER = (2, 4), 16_384
#: Words of a longer list are compared by what is left without one letter.
HOT = 128
#: Words that a task decomposes at most: little to read, but much to do.
TASK_WORDS = 20_000
#: Stands for any letter; no word holds it.
ANY = "\0"


def slip(word: str, seed: int) -> str:
    """word without one code point, if seed says so."""
    if seed % SLIPS:
        return word
    at = seed % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """(word, n): runs of letters with A-Z in lower case, slipped by the CRC-32 of doc_id:run; null doc_id counts as empty.

    A task counts its words before they are shuffled, and hands on what it has once it has COUNTED different ones.
    """
    small_batches(docs.sparkSession)
    upper = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[{LETTERS}]{{{shortest},}}")
        total: Counter[str] = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                text = text.lower() if text.isascii() else text.translate(upper)
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(runs.findall(text)).items():
                    seed = zlib.crc32(word.encode(), start)
                    total[slip(word, seed) if seed % SLIPS == 0 else word] += n
            if len(total) > COUNTED:
                yield flush()
                total.clear()
        if total:
            yield flush()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= rarest) & (F.length("word") >= shortest))


def frequent_grams(words: DataFrame, grams: tuple[int, int] = GRAMS, inner: int = INNER) -> dict[str, int]:
    """The trie's inner grams with their counts: those at more than one in inner places of all words. At most inner of each length."""
    low, high = grams
    lengths = F.explode(F.sequence(F.lit(low), F.lit(high - 1))) if high > low else F.explode(F.array().cast("array<int>"))
    sized = words.select("word", lengths.alias("size")).where(F.length("word") >= F.col("size"))
    cut = F.transform(F.sequence(F.lit(1), F.length("word") - F.col("size") + 1), lambda i: F.substring("word", i, F.col("size")))
    counts = sized.select(F.explode(cut).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    places = words.agg(F.sum(F.length("word"))).first()[0] or 0
    return {r.gram: r.n for r in counts.where(F.col("n") * inner > places).collect()}


class Grams:
    """Decomposes words. inner: the frequent grams with their counts."""

    def __init__(self, inner: dict[str, int], grams: tuple[int, int] = GRAMS):
        self.low, self.high, self.inner = *grams, inner
        self.wild = {g[:k] + ANY + g[k + 1 :] for g in inner for k in range(len(g))}

    def end(self, word: str, at: int, high: int) -> int:
        """Where the gram that starts at a place ends: the first end at which it isn't frequent. With ANY, the last such end of all letters."""
        end, last = at + self.low, min(at + high, len(word))
        while end < last:
            gram = word[at:end]
            if gram not in (self.wild if ANY in gram else self.inner):
                break
            end += 1
        return end

    def ends(self, word: str, high: int) -> list[int]:
        return [self.end(word, p, high) for p in range(len(word) - self.low + 1)]

    def grams(self, word: str, high: int) -> list[tuple[int, int]]:
        """(start, end) of the word's grams, without those that lie within an earlier one."""
        out, far = [], 0
        for start, end in enumerate(self.ends(word, high)):
            if end > far:
                out.append((start, end))
                far = end
        return out

    def affected(self, word: str, found: list[tuple[int, int]], high: int) -> int:
        """How many of the word's grams one inserted, deleted or replaced letter can change at most.

        An edit reaches grams that start less than high places from it; three times as much text around it decides on them.
        """
        most, first, starts = 0, 0, [start for start, _ in found]
        for at in range(len(word) + 1):
            low = max(0, at - 2 * high)
            text, place = word[low : at + 3 * high], at - low
            edits = [(text[:place] + ANY + text[place:], at, 1)]
            if at < len(word):
                edits += [(text[:place] + text[place + 1 :], at + 1, -1), (text[:place] + ANY + text[place + 1 :], at + 1, 0)]
            while first < len(starts) and starts[first] < at - high:
                first += 1
            for other, after, shift in edits:
                ends, far, lost = self.ends(other, high), [0], 0
                for end in ends:
                    far.append(max(far[-1], end))
                for k in range(first, len(found)):
                    start, end = found[k]
                    if start > at + high:
                        break
                    if end > at and start < after:  # it holds the edited place
                        lost += 1
                        continue
                    move = (shift if start >= after else 0) - low
                    lost += not (start + move < len(ends) and ends[start + move] == end + move > far[start + move])
                most = max(most, lost)
        return most

    def rarest(self, word: str) -> Iterator[tuple[int, list[tuple[str, int]]]]:
        """(length of the longest gram, (gram, start) of the grams to be merged) for each round that the word takes part in."""
        for high in range(self.high, self.low - 1, -1):
            found = self.grams(word, high)
            affected = self.affected(word, found, high)
            # An order of all grams, rarer ones first as far as the frequent grams tell; the same for all words.
            rank = lambda g: (self.inner.get(g) or min(self.inner.get(g[1:], 0), self.inner.get(g[:-1], 0)), g)
            listed = sorted((rank(word[a:b]), a) for a, b in found)[: affected + 1]
            yield high, [(gram, start) for (_, gram), start in listed]
            if affected < len(found):
                return


def near_words(words: DataFrame, grams: tuple[int, int] = GRAMS, inner: int = INNER, hot: int = HOT) -> DataFrame:
    """(a, b): pairs of words, both ways, that one inserted, deleted or replaced code point makes equal.

    words: distinct words without null, of at least two code points more than the shortest gram has; a written table, as
    it is read several times.
    """
    spark = words.sparkSession
    known = spark.sparkContext.broadcast(frequent_grams(words, grams, inner))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Grams(known.value, grams)
        for batch in batches:
            # side 0 is what is listed; 1 looks for words with one letter more.
            rows = []
            for word in batch["word"]:
                for high, listed in index.rarest(word):
                    for gram, start in listed:
                        rows.append((f"{high} {gram} {len(word)} {start}", 0, word))
                        rows += [(f"{high} {gram} {len(word) + 1} {start + k}", 1, word) for k in (0, 1)]
            yield pd.DataFrame(rows, columns=["list", "side", "word"])

    tasks = max(partitions(spark), -(-words.count() // TASK_WORDS))
    listed = words.select("word").repartition(tasks, "word").mapInPandas(run, "list string, side int, word string")
    lists = written(listed.select(F.xxhash64("list").alias("list"), "side", "word"), "gram-lists")
    sizes = written(lists.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot), "hot-lists")
    short, near = lists, None
    if not sizes.isEmpty():
        short = lists.join(sizes, "list", "left_anti")
        near = _by_deletion(lists.join(sizes, "list", "left_semi").select("word").distinct())
    here, there = short.where("side = 0").select("list", F.col("word").alias("a")), short.select("list", "side", F.col("word").alias("b"))
    one = (F.levenshtein("a", "b", 1) == 1) & ((F.col("side") == 1) | (F.col("a") < F.col("b")))
    merged = here.join(there.hint("merge"), (here["list"] == there["list"]) & one).select("a", "b")
    both = (merged if near is None else merged.unionByName(near)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = written(narrow(both), "near-words")
    return both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _by_deletion(words: DataFrame) -> DataFrame:
    """Near words (a, b) by what is left without one letter: a group holds the words that differ in one place, at most one for each letter."""
    at = F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("at")
    rest = F.xxhash64(F.concat(F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)")))
    cut = words.select("word", at).select(F.col("word").alias("a"), "at", rest.alias("rest"))
    whole = words.select(F.xxhash64("word").alias("rest"), F.col("word").alias("b"))
    replaced = cut.join(cut.withColumnRenamed("a", "b"), ["at", "rest"]).where("a < b")
    # Words of repeated letters are found at many places: each pair once, before it is verified.
    found = replaced.select("a", "b").unionByName(cut.join(whole, "rest").select("a", "b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("places"))
    return found.where(F.when(F.col("places") > 0, F.levenshtein("a", "b", 1)) == 1).select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root): forms are followed to the last. A form is more frequent than its word, so there are no circles.

    Each round doubles the steps taken, so there are as many rounds as the longest chain's length has binary digits.
    """
    at = written(narrow(forms.select("word", F.col("form").alias("root"))), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = at.join(step, "root", "left")
        new = written(narrow(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))), "roots")
        at = new.select("word", "root")
        if new.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST, factor: int = 5) -> DataFrame:
    """One row per word of the texts: word, form, root, n, n_near, form_n.

    Two words are near at edit distance 1. A word's form is its most frequent near word (of equal ones the first in code
    point order), if that is factor times as frequent; root is the last form reached, or the word itself. Null and empty
    texts have no words; repeated rows count each; null doc_id counts as an empty one. Columns other than doc_id and text are
    ignored; an empty table gives an empty result. A word may be as long as a text; a task has
    one such word, or what is left of it without one letter, in memory at a time.
    """
    words = written(word_counts(docs, shortest, rarest), "words")
    near = near_words(words).join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    # The least of (-count, word): the greatest count, and of equal counts the first word.
    best = near.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("word"))).alias("best"))
    known = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    fits = -F.col("best.n") >= F.lit(factor) * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.n")).alias("form_n"))
    known = written(known, "forms")
    last = roots(known.where("form IS NOT NULL"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
