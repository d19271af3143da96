"""N-gram Jaccard join and its groups, by vertical partitioning.

1. Documents of one text are one class; its smallest doc_id stands for it.
2. All n-grams are counted, in a table of hash buckets of fixed size. The global order puts n-grams of rare buckets first:
   by level (how far the bucket's count is above chance), then by hash. An n-gram and its place in the order are
   one 64-bit number, the token.
3. The order is cut into fragments. A document's leading tokens, as many as any partner must share one of, go to
   their fragments; there the documents of each token that has several are its posting.
4. Two documents of a posting are a candidate pair. A sketch of each set, a bit for the parity of each hash slot, bounds
   how many n-grams one of them has alone; a pair goes where that is too many. The others' sets are cut into fragments, the overlap is counted in each
   fragment apart, and the counts are summed per pair; the sum decides.

Only what can change a group is counted. In a few turns each document is compared with the hub of its postings that
seems nearest and is in another component; documents that are linked are one component. Then all pairs of a posting
that are in different components are compared. So no link between components is lost, while a group of near copies costs
some comparisons for each of its documents, not their square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis.llm.components import components
from zonalis.llm.grams import gram_sets, packed, unpacked
from zonalis.llm.shared import bucketed_copy, join_groups, keeps_columns, keyed, narrow, partitions, small_batches, written

#: Words of an n-gram, and the similarity in hundredths.
SPAN, LEAST = 5, 75
#: The count table has 2**MAX_BITS buckets at most, a byte each where it is broadcast: 8 MB.
MAX_BITS, BLOCK = 23, 1 << 15
#: Leading tokens a fragment of the order holds, about; fragments in which a pair's overlap is counted.
FRAGMENT_TOKENS, PARTS = 1 << 18, 4
#: A posting is split by a hash of doc_id so that a part has some this many documents; a hub has as many partners in one group.
POSTING, PARTNERS = 1 << 17, 256
#: Turns that compare components by single documents, before all open pairs are compared; such a turn looks at one posting in SHARE.
TURNS, SHARE = 2, 4
#: Documents a component sends to a posting's comparison in a turn, and hubs of one kind there; documents of a posting that meet in one group.
HUBS, BLOCK_DOCS = 8, 1024
#: 64-bit words of the sketch that goes along with a posting's documents.
BRIEF = 16
#: Buffered leading tokens of a task.
FLUSH = 1 << 19


@dataclass
class Order:
    """The global order: levels of the count table's buckets, and where it is cut."""

    bits: int
    levels: np.ndarray
    most: np.ndarray
    fragment_bits: int

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        level = self.levels[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.uint64)
        return np.sort((level << np.uint64(58)) | (hashes >> np.uint64(6)))

    def fragment(self, tokens: np.ndarray) -> np.ndarray:
        level, place = (tokens >> np.uint64(58)).astype(np.int64), tokens & np.uint64((1 << 58) - 1)
        rare = (place >> np.uint64(58 - self.fragment_bits)).astype(np.int64)
        return np.where(level == 0, rare, (1 << self.fragment_bits) + 16 * (level - 1) + (place >> np.uint64(54)).astype(np.int64))

    def salts(self, tokens: np.ndarray) -> np.ndarray:
        """Parts that postings of each token's level are split into."""
        return np.maximum(1, self.most[(tokens >> np.uint64(58)).astype(np.int64)] // POSTING)


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, int, bool]:
    """(doc_id, digest), (digest, rep, number, bytes, rows), the bytes of all different texts, and whether a doc_id has several texts.

    A class of equal texts stands under a number, which is rep, its smallest doc_id, unless some doc_id has several texts: then
    rep tells neither texts nor classes apart, and classes are numbered. Rows without doc_id have no class.
    """
    text = F.coalesce("text", F.lit(""))
    rows = written(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("bytes")), "digests")
    twins = not rows.groupBy("doc_id").agg((F.min("digest") < F.max("digest")).alias("several")).where("several").isEmpty()
    reps = rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    reps = written(reps.withColumn("number", F.monotonically_increasing_id() if twins else F.col("rep")), "classes")
    return rows, reps, reps.agg(F.sum("bytes")).head()[0] or 0, twins


def rep_texts(docs: DataFrame, reps: DataFrame, size: int, twins: bool) -> tuple[DataFrame, Callable[[], None]]:
    """doc_id (the class's number), rep and text of a row for each class, bucketed by doc_id: the later joins leave the texts in place. And what removes them."""
    spark = docs.sparkSession
    # At least as many as a shuffle has, or the join would deal the texts out a second time.
    buckets = max(partitions(spark), -(-size // (64 << 20)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if twins:
        named = rows.where("doc_id IS NOT NULL").withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
        first = named.join(reps.select("digest", F.col("rep").alias("doc_id"), "number"), ["digest", "doc_id"])
        rows = first.select(F.col("number").alias("doc_id"), F.col("doc_id").alias("rep"), "text")
    else:
        rows = rows.select("doc_id", F.col("doc_id").alias("rep"), "text")
    return bucketed_copy(rows, reps.select(F.col("number").alias("doc_id")), "texts", "doc_id", buckets)


def count_buckets(texts: DataFrame, span: int, bits: int) -> DataFrame:
    """Rows (doc_id, n, sketch, brief) for each text, and (block, counts) of each task's count table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.int64 if bits < 16 else np.int32)
        for batch in batches:
            sizes, sketches, briefs = np.zeros(batch.num_rows, np.int64), [b""] * batch.num_rows, np.zeros((batch.num_rows, BRIEF), np.int64)
            some = [np.zeros(0, np.int64)]
            for k, found in gram_sets(batch.column("text"), span):
                sizes[k], sketches[k], briefs[k] = len(found), sketch(found), np.frombuffer(parities(found, 64 * BRIEF), np.int64)
                some.append((found >> np.uint64(64 - bits)).astype(np.int64))
            at, n = np.unique(np.concatenate(some), return_counts=True)
            table[at] += n.astype(table.dtype)
            none = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            words = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BRIEF), pa.array(briefs.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(sketches, pa.binary()), words, *none], names)
        for block in range(-(-len(table) // BLOCK)):
            part = table[block * BLOCK : (block + 1) * BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.list_(pa.int64())), pa.array([block], pa.int32()), pa.array([short_counts(part)], pa.binary())], names)

    names = ["doc_id", "n", "sketch", "brief", "block", "counts"]
    return texts.mapInArrow(run, "doc_id long, n long, sketch binary, brief array<long>, block int, counts binary")


def short_counts(part: np.ndarray) -> bytes:
    """A byte for each count; where it is 255 or more, the place and the rest follow."""
    over = np.flatnonzero(part >= 255)
    return np.minimum(part, 255).astype(np.uint8).tobytes() + packed(over.astype("<u2"), (part[over] - 255).astype("<u4"))


def whole_counts(blob: bytes, size: int) -> np.ndarray:
    counts = np.frombuffer(blob, np.uint8, size).astype(np.int64)
    over, rest = unpacked(blob[size:], "<u2", "<u4")
    counts[over] += rest
    return counts


def parities(hashes: np.ndarray, slots: int) -> bytes:
    """A bit for each slot: whether an odd number of hashes has it."""
    return np.packbits(np.bincount((hashes & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1, bitorder="little").tobytes()


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of at least four slots an n-gram; slots are a power of two."""
    return parities(hashes, 1 << max(6, int(4 * max(1, len(hashes)) - 1).bit_length()))


def plausible(pairs: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose sketches differ in no more bits than two linked sets can differ in n-grams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True):
                u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                while len(u) > len(v):
                    u = u[: len(u) // 2] ^ u[len(u) // 2 :]
                while len(v) > len(u):
                    v = v[: len(v) // 2] ^ v[len(v) // 2 :]
                kept.append(int(np.bitwise_count(u ^ v).sum()) * (100 + least) <= (100 - least) * (na + nb))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    one, other = (sketches.select(F.col("doc_id").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}")) for s in "ab")
    return pairs.join(one, "a").join(other, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def sum_blocks(blocks: DataFrame, size: int) -> DataFrame:
    """(block, short counts) to (block, total, counts of eight bytes), in a stream: a task holds its blocks' sums only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + whole_counts(counts, size)
        for block, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([int(counts.sum())]), pa.array([counts.astype("<i8").tobytes()], pa.binary())], ["block", "total", "counts"])

    return blocks.repartition(partitions(blocks.sparkSession), "block").mapInArrow(run, "block int, total long, counts binary")


def levels_of(counts: np.ndarray, mean: float) -> np.ndarray:
    """Levels are steps of a count's distance from the mean, in standard deviations of chance: 0 below two, then four steps a doubling."""
    spread = max(1.0, float(np.sqrt(mean)))
    far = np.maximum((counts - mean) / (2 * spread), 2.0**-0.25)
    return np.clip(1 + np.floor(4 * np.log2(far)), 0, 63).astype(np.uint8)


def block_levels(sums: DataFrame, mean: float) -> DataFrame:
    """(block, levels, most): a byte for each bucket of a block, and the largest count of each of the 64 levels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                counts, most = np.frombuffer(blob, "<i8"), np.zeros(64, np.int64)
                levels = levels_of(counts, mean)
                np.maximum.at(most, levels, counts)
                rows.append((block, levels.tobytes(), most.tolist()))
            columns = zip(*rows, strict=True) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.list_(pa.int64())), strict=True)], ["block", "levels", "most"])

    return sums.select("block", "counts").mapInArrow(run, "block int, levels binary, most array<long>")


def learn_order(counted: DataFrame, bits: int, grams: int) -> Order:
    """The order of counted's n-grams. Tasks make the levels; the driver gets a byte for each bucket, and holds no counts."""
    sums = written(sum_blocks(counted.where("block IS NOT NULL").select("block", "counts"), min(BLOCK, 1 << bits)), "sums")
    mean = (sums.agg(F.sum("total")).first()[0] or 0) / (1 << bits)
    empty = levels_of(np.zeros(1, np.int64), mean)[0]
    levels, most = np.full(1 << bits, empty, np.uint8), np.zeros(64, np.int64)
    for row in block_levels(sums, mean).toLocalIterator():
        part = np.frombuffer(row["levels"], np.uint8)
        levels[row["block"] * BLOCK : row["block"] * BLOCK + len(part)] = part
        most = np.maximum(most, row["most"])
    # Leading tokens are a quarter of all, and stand in the first quarter or so of the fragments.
    fragment_bits = int(np.clip(np.ceil(np.log2(max(1, grams / FRAGMENT_TOKENS))), 4, 16))
    return Order(bits, levels, most, fragment_bits)


def has_partner(tokens: np.ndarray, sizes: np.ndarray, lefts: np.ndarray, least: int) -> np.ndarray:
    """Of entries in order of token and size: whether another one of the token has a size with which a link is possible."""
    posting = np.cumsum(np.concatenate([[False], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    key = (posting << 33) + sizes
    low, high = -(-least * sizes // 100), lefts * (100 + least) // least - sizes
    first, end = (np.searchsorted(key, (posting << 33) + bound, side) for bound, side in ((low, "left"), (np.maximum(high, 0), "right")))
    return end - first > (sizes <= high)


def postings(texts: DataFrame, shared: Broadcast, span: int, least: int) -> DataFrame:
    """(token, docs, sizes, lefts): the documents among whose leading tokens the token is, two or more, by size.

    lefts: how many tokens of the document the order has from this one on. At the first token that two documents share,
    the smaller of theirs bounds the overlap.
    """
    spark = texts.sparkSession

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tokens, docs, sizes, lefts, held = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            t, d, n, left = (np.concatenate(c) for c in (tokens, docs, sizes, lefts))
            salts = own.salts(t)
            salt = np.where(salts > 1, (d * np.int64(2654435761) >> 7) % salts, 0)
            key = own.fragment(t) * (1 << 20) + salt
            by = np.lexsort((t, key))
            t, d, n, left, key = t[by], d[by], n[by], left[by], key[by]
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            blobs = [packed(t[i:j], d[i:j], n[i:j], left[i:j]) for i, j in zip(cuts, [*cuts[1:], len(key)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(key[cuts]), pa.array(blobs, pa.binary())], ["key", "blob"])

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for k, found in gram_sets(batch.column("text"), span):
                lead = own.tokens(found)[: len(found) - -(-least * len(found) // 100) + 1] if len(found) else found
                tokens.append(lead), docs.append(np.full(len(lead), ids[k], np.int64)), sizes.append(np.full(len(lead), len(found), np.uint32))
                lefts.append((len(found) - np.arange(len(lead))).astype(np.uint32))
                held += len(lead)
            if held >= FLUSH:
                yield out()
                tokens, docs, sizes, lefts, held = [], [], [], [], 0
        if held:
            yield out()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key: a fragment at a time."""
        own = shared.value

        def out(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            t, d, n, left = (np.concatenate(c) for c in zip(*(unpacked(b, "<u8", "<i8", "<u4", "<u4") for b in blobs), strict=True))
            by = np.lexsort((d, n, t))
            t, d, n, left = t[by], d[by], n[by], left[by]
            split = own.salts(t) > 1
            kept = split | has_partner(t, n.astype(np.int64), left.astype(np.int64), least)
            t, d, n, left, split = t[kept], d[kept], n[kept], left[kept], split[kept]
            starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
            sizes = np.diff(np.concatenate([starts, [len(t)]])).astype(np.int64)
            kept = (sizes > 1) | split[starts]
            inside = np.repeat(kept, sizes)
            offsets = np.concatenate([[0], np.cumsum(sizes[kept])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(c[inside])) for c in (d, n.astype(np.int32), left.astype(np.int32))]
            whole = pa.RecordBatch.from_arrays([pa.array(t[starts[kept]].view(np.int64)), *lists], ["token", "docs", "sizes", "lefts"])
            for at in range(0, whole.num_rows, 4096):
                yield whole.slice(at, 4096)

        key, blobs = None, []
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key and blobs:
                    yield from out(blobs)
                    blobs = []
                key = k
                blobs.append(blob)
        if blobs:
            yield from out(blobs)

    lead = texts.mapInArrow(emit, "key long, blob binary")
    return lead.repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(gather, "token long, docs array<long>, sizes array<int>, lefts array<int>")


def linked(texts: DataFrame, candidates: DataFrame, sketches: DataFrame, shared: Broadcast, span: int, least: int) -> DataFrame:
    """The candidates (a, b) whose similarity is at least least hundredths.

    Each pair's documents meet in PARTS groups, one for each part of the order; a hub with many partners is in several
    groups for each, and a partner of many hubs is read once for each PARTNERS of them, about. The groups count the overlap in their part, and the counts are summed per pair.
    """
    spark = texts.sparkSession
    pairs = written(plausible(candidates, sketches, least), "plausible")
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("salts"))
    turns = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("turns"))
    partner = pairs.join(salts, "a").join(turns, "b").select(F.col("b").alias("doc_id"), F.pmod(F.xxhash64("a"), F.col("turns")).alias("some"), F.struct(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")).alias("to"))
    hub = salts.select(F.col("a").alias("doc_id"), F.lit(0).cast("long").alias("some"), F.explode(F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: F.struct(F.col("a").alias("hub"), s.alias("salt")))).alias("to"))
    need = partner.unionByName(hub).groupBy("doc_id", "some").agg(F.collect_list("to").alias("to"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        # Quarters of the tokens of level 0, by hash; the other levels go with the last.
        cuts = (np.arange(1, PARTS, dtype=np.uint64) << np.uint64(58)) // np.uint64(PARTS)
        names = ["hub", "salt", "part", "partner", "doc_id", "n", "tokens"]
        for batch in batches:
            ids, to = batch.column("doc_id").to_pylist(), batch.column("to").to_pylist()
            rows: list[tuple] = []
            size = 0
            for k, found in gram_sets(batch.column("text"), span):
                tokens = own.tokens(found)
                bounds = [0, *np.searchsorted(tokens, cuts).tolist(), len(tokens)]
                parts = [tokens[bounds[p] : bounds[p + 1]].tobytes() for p in range(PARTS)]
                for t in to[k]:
                    rows += [(t["hub"], t["salt"], p, int(t["hub"] != ids[k]), ids[k], len(found), parts[p]) for p in range(PARTS)]
                    size += 8 * len(found)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A group's hub comes first, then its partners."""
        hub_tokens, hub_n = np.zeros(0, np.uint64), 0
        for batch in batches:
            a, b, na, nb, shared_ = [], [], [], [], []
            for hub, partner, doc, n, blob in zip(*(batch.column(c).to_pylist() for c in ("hub", "partner", "doc_id", "n", "tokens")), strict=True):
                tokens = np.frombuffer(blob, np.uint64)
                if not partner:
                    hub_tokens, hub_n = tokens, n
                    continue
                at = np.searchsorted(hub_tokens, tokens)
                inside = at < len(hub_tokens)
                a.append(hub), b.append(doc), na.append(hub_n), nb.append(n)
                shared_.append(int((hub_tokens[at[inside]] == tokens[inside]).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, na, nb, shared_)], ["a", "b", "na", "nb", "overlap"])

    cut = texts.join(need, "doc_id").select("doc_id", "text", "to").mapInArrow(emit, "hub long, salt int, part int, partner int, doc_id long, n long, tokens binary")
    met = cut.repartition(partitions(spark), "hub", "salt", "part").sortWithinPartitions("hub", "salt", "part", "partner")
    partial = met.mapInArrow(count, "a long, b long, na long, nb long, overlap long")
    sums = partial.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), (F.max("na") + F.max("nb")).alias("total"))
    return narrow(sums.where(F.col("overlap") * 100 >= (F.col("total") - F.col("overlap")) * least).select("a", "b"))


def open_entries(found: DataFrame, groups: DataFrame | None, share: int = 1, turn: int = 0) -> DataFrame:
    """(token, size, doc, n, left, root): entries of the postings that hold size documents, of several components; of one posting in share."""
    some = found.where(F.pmod(F.xxhash64("token"), F.lit(share)) == turn % share) if share > 1 else found
    entries = some.select("token", F.explode(F.arrays_zip("docs", "sizes", "lefts")).alias("e"))
    entries = entries.select("token", F.col("e.docs").alias("doc"), F.col("e.sizes").alias("n"), F.col("e.lefts").alias("left"))
    if groups is None:
        entries = entries.withColumn("root", F.col("doc"))
    else:
        entries = entries.join(groups.select(F.col("node").alias("doc"), "root"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    several = entries.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token", "size")
    return written(entries.join(several, "token"), "open-postings").select("token", "size", "doc", "n", "left", "root")


def nearest_hubs(entries: DataFrame, sketches: DataFrame, turn: int, least: int) -> DataFrame:
    """(a, b): open pairs of documents that are likely to be linked, two for each b at most; others each turn.

    In a posting every component sends HUBS documents at most. Some of these are hubs: of the component that has most there,
    and of all. Each document takes the hub of another component whose brief sketch is nearest. Large postings are dealt
    into blocks, each with hubs of its own. What this leaves out, open_pairs() finds.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("e")
            sizes = np.diff(column.offsets.to_numpy())
            fields = column.values
            doc, root, draw = (fields.field(c).to_numpy() for c in ("doc", "root", "draw"))
            n, left = (fields.field(c).to_numpy().astype(np.int64) for c in ("n", "left"))
            brief = fields.field("brief").values.to_numpy().view(np.uint64).reshape(-1, BRIEF)
            posting = np.repeat(np.arange(len(sizes)), sizes)
            starts = np.cumsum(sizes) - sizes
            by_root = np.lexsort((root, posting))
            new = np.ones(len(doc), bool)
            new[1:] = (root[by_root][1:] != root[by_root][:-1]) | (posting[by_root][1:] != posting[by_root][:-1])
            heads = np.flatnonzero(new)
            many = np.empty(len(doc), np.int64)
            many[by_root] = np.repeat(np.diff(np.append(heads, len(doc))), np.diff(np.append(heads, len(doc))))
            best, near = np.full(len(doc), np.iinfo(np.int64).max), np.full(len(doc), -1)
            for order in (np.lexsort((draw, root, -many, posting)), np.lexsort((draw, posting))):
                for k in range(min(HUBS, int(sizes.max(initial=0)))):
                    who = np.flatnonzero(sizes[posting] > k)
                    hub = order[starts[posting[who]] + k]
                    total = n[who] + n[hub]
                    fits = (root[who] != root[hub]) & (np.minimum(left[who], left[hub]) * (100 + least) >= least * total)
                    who, hub, total = who[fits], hub[fits], total[fits]
                    differ = np.bitwise_count(brief[who] ^ brief[hub]).sum(axis=1, dtype=np.int64)
                    far = differ * 10000 // total
                    better = (differ * (100 + least) <= total * (100 - least)) & (far < best[who])
                    best[who[better]], near[who[better]] = far[better], hub[better]
            found = near >= 0
            yield pa.RecordBatch.from_arrays([pa.array(doc[near[found]]), pa.array(doc[found]), pa.array(best[found])], ["a", "b", "far"])

    some = entries.withColumn("draw", F.xxhash64("doc", F.lit(turn)))
    some = some.withColumn("at", F.row_number().over(W.partitionBy("token", "root").orderBy("draw", "doc"))).where(F.col("at") <= HUBS).drop("at", "size")
    blocks = some.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).alias("blocks")).where("blocks > 1")
    some = some.join(blocks, "token", "left").withColumn("block", F.pmod("draw", F.coalesce("blocks", F.lit(1))))
    some = some.join(sketches.select(F.col("doc_id").alias("doc"), "brief"), "doc")
    met = some.groupBy("token", "block").agg(F.collect_list(F.struct("doc", "n", "left", "root", "draw", "brief")).alias("e"))
    near = met.select("e").mapInArrow(run, "a long, b long, far long")
    two = near.groupBy("b").agg(F.min(F.struct("far", "a")).alias("nearest"), F.min(F.struct(F.xxhash64("a", F.lit(turn)), "a")).alias("other"))
    pairs = two.select(F.explode(F.array_distinct(F.array("nearest.a", "other.a"))).alias("a"), "b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def open_pairs(entries: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """(a, b): all pairs of a posting in different components whose sizes, places and brief sketches allow a link.

    A large posting is dealt into blocks, and each pair of blocks meets in a group of its own.
    """
    blocks = F.ceil(F.col("size") / BLOCK_DOCS).cast("int")
    entries = entries.join(sketches.select(F.col("doc_id").alias("doc"), "brief"), "doc").withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("doc"), blocks).cast("int")})
    left, right = (entries.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("doc", "n", "left", "root", "brief", "block", "blocks")]) for s in "lr")
    left = left.withColumn("other", F.explode(F.sequence("block_l", F.col("blocks_l") - 1)))
    right = right.withColumn("other", F.explode(F.sequence(F.lit(0), "block_r")))
    fits = ((F.col("block_l") < F.col("block_r")) | (F.col("doc_l") < F.col("doc_r"))) & (F.col("root_l") != F.col("root_r")) & (F.least("left_l", "left_r") * (100 + least) >= (F.col("n_l") + F.col("n_r")) * least)
    differ = sum(F.bit_count(F.col("brief_l")[k].bitwiseXOR(F.col("brief_r")[k])) for k in range(BRIEF))
    fits = fits & (differ * (100 + least) <= (F.col("n_l") + F.col("n_r")) * (100 - least))
    same = (left.token == right.token) & (left.other == right.block_r) & (right.other == left.block_l)
    return left.join(right, same & fits).select(F.least("doc_l", "doc_r").alias("a"), F.greatest("doc_l", "doc_r").alias("b")).distinct()


def stars(groups: DataFrame) -> DataFrame:
    """Edges (a, b) that hold the same components as groups."""
    return groups.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))


def near_groups(docs: DataFrame, span: int = SPAN, least: int = LEAST) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    A document's set: distinct n-grams of span words (lower-cased A-Z); with fewer words, the whole sequence. Two documents
    are linked when 100 * intersection >= least * union. component_id is the smallest doc_id reached by links. Documents
    without words, null text included, have an empty set and are linked with nothing. Rows without doc_id are in no group and
    have component_id null; repeated rows get the same answer, and different texts of one doc_id are different documents,
    each with its own set and links. Columns other than doc_id and text are ignored. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows, reps, size, twins = classes(docs)
    texts, remove_texts = rep_texts(docs, reps, size, twins)
    texts = texts.drop("rep")
    grams = max(1, size // 6)
    bits = int(np.clip(np.ceil(np.log2(grams / 4 + 1)), 10, MAX_BITS))
    counted = written(count_buckets(texts, span, bits), "counts")
    sketches = counted.where("block IS NULL").select("doc_id", "n", "sketch", "brief")
    order = learn_order(counted, bits, grams)
    shared = spark.sparkContext.broadcast(order)
    found = written(postings(texts, shared, span, least), "postings")

    groups, pairs = None, None
    for turn in range(TURNS + 1):
        entries = open_entries(found, groups, SHARE if turn < TURNS else 1, turn)
        more = nearest_hubs(entries, sketches, turn, least) if turn < TURNS else open_pairs(entries, sketches, least)
        more = written(narrow(more if pairs is None else more.join(pairs, ["a", "b"], "left_anti")), "pairs")
        links = written(linked(texts, more, sketches, shared, span, least), "links")
        groups = written(narrow(components(links if groups is None else links.unionByName(stars(groups)))), "groups")
        pairs = more if pairs is None else pairs.unionByName(more)
    shared.destroy()
    remove_texts()

    sizes = sketches.select(F.col("doc_id").alias("number"), "n")
    known = reps.select("digest", "rep", "number", "rows").join(sizes, "number").join(groups.select(F.col("node").alias("number"), "root"), "number", "left").select("digest", "rep", "rows", "n", F.coalesce("root", "number").alias("root"))
    if twins:  # numbers aren't in the order of doc_ids
        least = known.groupBy("root").agg(F.min("rep").alias("least"))
        known = known.join(least, "root").withColumn("root", F.col("least"))
    out = join_groups(rows, known.select("digest", "n", "root", "rows"), "digest", "rows").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("root")).alias("component_id"))
    nameless = docs.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nameless)


@keeps_columns
def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id, or with the smallest digest of those that share it.

    Rows without doc_id take part and stay only if their group has no other; without words they stay. Different texts of
    one doc_id are different documents; repeated rows of one doc_id and text are one document, of which all rows stay.
    Columns of any name are kept; an empty table gives an empty result. A text is in memory whole.
    """
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("doc_id IS NULL OR rows > 1").isEmpty():
        stay = near_groups(docs).where("doc_id = component_id").select("doc_id").distinct()
        return docs.join(stay, "doc_id", "left_semi").select(*docs.columns)
    # doc_id is no key: documents get numbers in its order, and are grouped by these.
    key = ["__id", "__digest"]
    named = keyed(docs)
    numbers = named.select("doc_id", *key).distinct().orderBy(F.col("doc_id").asc_nulls_last(), "__digest")
    numbers = written(numbers.select(*key, F.monotonically_increasing_id().alias("__number")), "numbers")
    numbered = written(named.join(numbers, key), "numbered")
    stay = near_groups(numbered.select(F.col("__number").alias("doc_id"), "text")).where("doc_id = component_id").select(F.col("doc_id").alias("__number")).distinct()
    return numbered.join(stay, "__number", "left_semi").select(*docs.columns)
