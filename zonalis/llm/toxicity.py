"""Toxicity from nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, and weighted votes.

Terms are lower-cased runs of letters and their starts of four to six letters. The index holds a bounded sample of
labelled rows (SAMPLE) over the terms that set toxic rows apart (at most TERMS), found by counting each term in that
sample with Spark. Examples are numbered in blocks; for each term the index keeps, beside its postings, the greatest
weight in each block. A text's blocks are visited in order of their bound until no other block can hold a nearer
example than the K found, so the neighbours are exact. The share of toxic votes becomes a probability by isotonic
regression over the learning rows, each scored without its own example.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.llm.shared import small_batches, written

#: Labelled rows that are indexed at most (those with the least md5 of doc_id), and terms.
SAMPLE, TERMS = 12_000, 4096
#: Neighbours that vote, and examples in a block.
K, BLOCK = 15, 64
#: A term needs so many toxic rows, and such an excess over the rate of the others.
LEAST_ROWS, LEAST_CHI2 = 3, 20.0
#: The vote of the prior, in units of a neighbour of cosine 1.
PRIOR_VOTES = 0.5
LETTERS = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n))


def row_terms(text: str | None, heads: set[str] | None = None) -> Counter:
    """Occurrences of each term; null and empty texts have none. heads: only of words whose first four letters these hold."""
    words, out = Counter(LETTERS.findall((text or "").lower())), Counter()
    for word in words if heads is None else [w for w in words if w[:4] in heads]:
        for term in terms_of(word):
            out[term] += words[word]
    return out


@dataclass
class BlockMaxIndex:
    """Postings of unit-length TF-IDF vectors, by term: examples in order, their weights, and block maxima."""

    idf: dict[str, float]
    postings: dict[str, tuple[np.ndarray, np.ndarray]]
    maxima: dict[str, tuple[np.ndarray, np.ndarray]]
    labels: np.ndarray
    ids: np.ndarray
    prior: float
    heads: set[str]
    #: Shares and the toxic rates that they stand for, both increasing.
    curve: tuple[np.ndarray, np.ndarray] | None = None

    @staticmethod
    def build(examples: list[tuple[int, int, dict[str, int]]], idf: dict[str, float], prior: float, block: int = BLOCK) -> BlockMaxIndex:
        by_term: dict[str, list[tuple[int, float]]] = {}
        for at, (_, _, counts) in enumerate(examples):
            for t, w in unit(counts, idf).items():
                by_term.setdefault(t, []).append((at, w))
        postings = {t: (np.array([a for a, _ in p], np.int64), np.array([w for _, w in p])) for t, p in by_term.items()}
        maxima = {}
        for t, (at, w) in postings.items():
            blocks, first = np.unique(at // block, return_index=True)
            maxima[t] = (blocks, np.maximum.reduceat(w, first))
        return BlockMaxIndex(idf, postings, maxima, np.array([y for _, y, _ in examples], np.int64), np.array([d for d, _, _ in examples], np.int64), prior, {t[:4] for t in idf})

    def nearest(self, query: dict[str, float], k: int = K, block: int = BLOCK, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine over 0, ties by lower number: numbers and cosines. without: an id to leave out."""
        found = [(q, *self.postings[t], *self.maxima[t]) for t, q in query.items() if t in self.postings]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        bound = np.bincount(np.concatenate([f[3] for f in found]), np.concatenate([f[0] * f[4] for f in found]))
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        numbers, parts = np.concatenate([f[1] for f in found]), np.concatenate([f[0] * f[2] for f in found])
        blocks = numbers // block
        best_at, best = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, max(4, len(order) // 8)
        # A bound is a sum in another order than the cosines' own; the margin keeps ties.
        while at < len(order) and not (len(best) == k and bound[order[at]] < best[-1] - 1e-9):
            taken = np.zeros(len(bound), bool)
            taken[order[at : at + step]] = True
            here = taken[blocks]
            sums = np.bincount(numbers[here], parts[here])
            who = np.flatnonzero(sums)
            if without is not None:
                who = who[self.ids[who] != without]
            best_at, best = np.concatenate([best_at, who]), np.concatenate([best, sums[who]])
            top = np.lexsort((best_at, -np.round(best, 9)))[:k]
            best_at, best = best_at[top], best[top]
            at, step = at + step, step * 2
        return best_at, best

    def share(self, counts: dict[str, int], without: int | None = None) -> tuple[float, list[tuple[int, float]]]:
        """The share of toxic votes, a vote being the cosine squared, and the voters' ids and cosines.

        A text near no example gets the share of toxic rows among the examples without any term.
        """
        at, cos = self.nearest(unit(counts, self.idf), without=without)
        votes = cos * cos
        share = (float(votes @ self.labels[at]) + PRIOR_VOTES * self.prior) / (float(votes.sum()) + PRIOR_VOTES)
        return min(1.0, max(0.0, share)), list(zip(self.ids[at].tolist(), np.round(cos, 6).tolist(), strict=True))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float]]]:
        """The rate of toxic rows that the share of votes stands for, and the voters' ids and cosines."""
        share, voters = self.share(row_terms(text, self.heads))
        return (share if self.curve is None else float(np.interp(share, *self.curve))), voters


def isotonic(shares: list[float], labels: list[int]) -> tuple[np.ndarray, np.ndarray] | None:
    """Increasing rates that fit the labels best, by pooling neighbours that fall: mean share and rate of each pool.

    A pool counts one row more, of the mean label, so that a small pool doesn't stand for certainty. The ends are 0 and 1.
    None without rows of both labels.
    """
    if len(set(labels)) < 2:
        return None
    mean = sum(labels) / len(labels)
    ties: dict[float, list[float]] = {}
    for share, label in zip(shares, labels, strict=True):
        pool = ties.setdefault(round(share, 9), [0.0, 0.0, 0.0])
        pool[0], pool[1], pool[2] = pool[0] + share, pool[1] + label, pool[2] + 1
    pools: list[list[float]] = []
    for share in sorted(ties):
        pools.append(ties[share])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    at = np.array([0.0, *(s / n for s, _, n in pools), 1.0])
    return at, np.maximum.accumulate(np.array([0.0, *((y + mean) / (n + 1) for _, y, n in pools), 1.0]))


def unit(counts: dict[str, int], idf: dict[str, float]) -> dict[str, float]:
    weights = {t: (1 + math.log(n)) * idf[t] for t, n in counts.items() if t in idf}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    return {t: w / norm for t, w in weights.items()} if norm else {}


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 3, is 1: these rows' labels are never used."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> BlockMaxIndex:
    """Learns from at most sample labelled rows that aren't held out. What reaches the driver is bounded by sample and terms."""
    small_batches(docs.sparkSession)
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(sample)
    picked = F.broadcast(chosen.sparkSession.createDataFrame(chosen.collect(), "doc_id long, toxic int"))
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(picked, "doc_id"), "labelled-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        rows_of = [0, 0]

        def out() -> pa.RecordBatch:
            both = list(seen[0].keys() | seen[1].keys())
            columns = [["", *both], [rows_of[0], *(seen[0][t] for t in both)], [rows_of[1], *(seen[1][t] for t in both)]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["term", "clean", "toxic"])

        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[y].update(row_terms(text).keys())
                rows_of[y] += 1
                if len(seen[0]) + len(seen[1]) > 100_000:
                    yield out()
                    seen[0].clear(), seen[1].clear()
                    rows_of[:] = 0, 0
        yield out()

    table = rows.select("text", "toxic").mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    table = table.persist()
    totals = table.where("term = ''").head()
    clean, toxic = (totals["clean"], totals["toxic"]) if totals else (0, 0)
    n, df = float(clean + toxic), F.col("clean") + F.col("toxic")
    excess = F.col("toxic") * F.lit(float(clean)) - F.col("clean") * F.lit(float(toxic))
    chi2 = F.try_divide(F.lit(n) * excess * excess, df * (F.lit(n) - df) * F.lit(float(clean) * float(toxic)))
    best = table.where((F.col("term") != "") & (F.col("toxic") >= LEAST_ROWS) & (excess > 0)).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2)
    idf = {r["term"]: math.log(1 + n / (r["clean"] + r["toxic"])) for r in best.orderBy(F.desc("chi2"), "term").limit(terms).collect()}
    table.unpersist()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [{t: n for t, n in row_terms(text).items() if t in idf} for text in batch.column("text").to_pylist()]
            arrays = [batch.column("doc_id"), batch.column("toxic"), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "toxic", "terms", "n"])

    vectored = rows.select("doc_id", "toxic", "text").mapInArrow(vectors, "doc_id long, toxic int, terms array<string>, n array<long>")
    examples = [(r["doc_id"], r["toxic"], dict(zip(r["terms"], r["n"], strict=True))) for r in vectored.collect()]
    bare = [y for _, y, c in examples if not c]
    prior = (sum(bare) + 0.5) / (len(bare) + 1.0)
    index = BlockMaxIndex.build(sorted((e for e in examples if e[2]), key=lambda e: e[0]), idf, prior)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
            shares = [own.share(row_terms(text, own.heads), doc_id)[0] for doc_id, text in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shares, pa.float64()), batch.column("toxic")], ["share", "toxic"])

    pairs = rows.select("doc_id", "text", "toxic").mapInArrow(left_out, "share double, toxic int").collect()
    index.curve = isotonic([r["share"] for r in pairs], [r["toxic"] for r in pairs])
    return index


def score(docs: DataFrame, index: BlockMaxIndex) -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1), evidence array<struct<doc_id, cosine>>.

    The score depends on the text alone. Null and empty texts are near no example. Columns other than doc_id and text are
    ignored; repeated rows get the same score; an empty table gives an empty result; an index of no labelled rows gives 0.5.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scored = [own.score(text) for text in batch.column("text").to_pylist()]
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))
            evidence = pa.array([[{"doc_id": d, "cosine": c} for d, c in e] for _, e in scored], kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([s for s, _ in scored], pa.float64()), evidence], ["doc_id", "score", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double>>")


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """fit() and score() together: doc_id, held_out, score, predicted, evidence."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs without the rows that are predicted toxic. Each row's text decides, with or without a doc_id of its own."""
    index = fit(docs, labels)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            yield batch.filter(pa.array([own.score(text)[0] < threshold for text in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
