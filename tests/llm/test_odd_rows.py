"""The pipeline and its stages where doc_id is null or stands for several texts."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from zonalis.llm import exact_dedup, mixing, ngram_join, shared, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, source string"


def rows():
    rnd = random.Random(4)
    line = lambda: " ".join(f"w{rnd.randrange(900)}" for _ in range(60))
    a, b, c, d, e, f = (line() for _ in range(6))
    return [
        (1, a, "s"), (2, a.upper(), "s"), (2, b, "s"),  # 2 has a copy of 1's text and a text of its own
        (3, c, "s"), (3, d, "s"),  # two texts of one doc_id
        (None, e, "s"), (None, e, "s"), (None, f, "s"), (None, f + " end", "s"),  # copies and near copies without doc_id
        (None, b, "s"), (None, c + " end", "s"), (4, d + " end", "s"),  # copies and near copies of others
        (None, "short", "s"), (None, "", "s"), (5, None, "s"),
    ]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_force(found):
    """(doc_id, text) that stay: copies go, then near copies, which rows without doc_id lose to others."""
    first = {}
    for d, t, _ in found:  # the largest doc_id of equal texts stays
        t, at = (t or "").lower(), -1 if d is None else d
        first[t] = max(first.get(t, -1), at)
    left = sorted(((d, t) for t, d in first.items()), key=lambda x: (x[0] < 0, x[0], hashlib.sha256(x[1].encode()).hexdigest()))
    group = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            x, y = shingles(left[i][1]), shingles(left[j][1])
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((group[i], group[j]))
                group = [lo if g == hi else g for g in group]
    return Counter((None if d < 0 else d, t) for k, (d, t) in enumerate(left) if group[k] == k)


def plain(found):
    return Counter((r.doc_id, (r.text or "").lower()) for r in found.collect())


def test_pipeline(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = brute_force(rows())
    assert plain(ngram_join.one_of_each(exact_dedup.keep_one(docs))) == want
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    text = {hashlib.sha256(x.encode()).hexdigest(): t for t in {t for _, t in want} for x in (t, t.upper())}
    found = Counter((r.doc_id, text[r.decoded_sha256]) for r in got)
    # One source: each row with words once; of those without, as many as their place gives.
    assert {k: n for k, n in found.items() if k[1]} == {k: n for k, n in want.items() if k[1]}


def test_keep_one_keeps_each_text(spark):
    assert plain(exact_dedup.keep_one(spark.createDataFrame(rows(), SCHEMA))) == Counter((max((d for d, x, _ in rows() if (x or "").lower() == t and d is not None), default=None), t) for t in {(t or "").lower() for _, t, _ in rows()})


def test_mixed_gives_what_mix_counts(spark):
    docs = spark.createDataFrame([(d, t, s) for d, t, _ in rows() for s in ("x", "y", None)], SCHEMA)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source, r["size"]] += r.copies
    got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in mixing.mixed(docs).collect())
    assert got == +want and sum(n for (d, *_), n in got.items() if d is None) > 0


def test_toxic_rows_without_doc_id(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id for r in toxicity.predictions(documents, labels).where("predicted = 1").collect()}
    both = documents.unionByName(documents.withColumn("doc_id", F.lit(None).cast("long")))
    want = Counter(t for r in documents.collect() if r.doc_id not in toxic for t in [r.text, r.text])
    assert toxic and Counter(r.text for r in toxicity.without_toxic(both, labels).collect()) == want


CLASHING = "doc_id long, text string, source string, rep long, number long, digest string, root long, rows long, __digest string"


def clash(spark, found):
    return spark.createDataFrame([(d, t, "s", 7, 7, "x", 7, 7, "y") for d, t in found], CLASHING).repartition(3)


def grouped(found):
    """doc_id, shingles and least doc_id of the component of each row."""
    sets = [shingles(t) for _, t in found]
    group = list(range(len(found)))
    for i, (a, _) in enumerate(found):
        for j in range(i):
            if a is not None and found[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                lo, hi = sorted((group[i], group[j]))
                group = [lo if g == hi else g for g in group]
    least = {g: min(found[k][0] for k in range(len(found)) if group[k] == g and found[k][0] is not None) for k0, g in enumerate(group) if found[k0][0] is not None}
    return Counter((None, None, None) if d is None else (d, len(s), least[g] if s else d) for (d, _), s, g in zip(found, sets, group, strict=True))


def cut_down(found):
    """doc_id, bytes, bytes removed, runs and what is left of each row."""
    first = {}
    for d, t in found:
        b = (t or "").encode()
        for p in range(len(b) - 49) if d is not None else ():
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], d), d)
    want = Counter()
    for d, t in found:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49) if d is not None else ():
            if first[b[p : p + 50]] < d:
                gone[p : p + 50] = b"\1" * 50
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[d, len(b), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(left).hexdigest()] += 1
    return want


def several_texts():
    rnd = random.Random(6)
    line = lambda n: " ".join(f"w{rnd.randrange(900)}" for _ in range(n))
    a, b, c = line(20), line(60), line(80)
    small = [(5, a), (5, b), (7, b), (9, a)]
    near = [(5, a), (5, b), (7, b + " end"), (9, a + " end")]
    passage = line(15)
    many = [*near, (None, c), (None, c), (None, None), (3, c), (3, c + " more"), (3, passage), (3, f"{passage} {line(9)}"), (4, f"{line(5)} {passage}"), (4, passage), (4, passage), (8, ""), (8, None), (8, "one two"), (2, c.upper()), (11, a), (11, b), (11, a), (6, "é" * 60), (6, "é" * 61), (6, "x"), (12, b + " " + a)]
    return [small, near, many, [(k % 3, f"{line(4)} {passage} {line(rnd.randint(1, 6))}") for k in range(20)]]


@pytest.mark.parametrize("which", range(4))
def test_several_texts_of_one_id(spark, which):
    found = several_texts()[which]
    docs = clash(spark, found)
    assert Counter(map(tuple, ngram_join.near_groups(docs).collect())) == grouped(found)
    for hot in (4096, 1) if which > 1 else (4096,):
        assert Counter(map(tuple, suffix_dedup.remove_repeats(docs, hot).collect())) == cut_down(found)
    if which == 0:
        assert sorted(r.n_shingles for r in ngram_join.near_groups(docs).collect()) == [16, 16, 56, 56]


def test_hot_groups_are_joined_apart(spark, monkeypatch):
    """Large groups of copies go by a broadcast of their few keys: the same rows."""
    rnd = random.Random(2)
    line = " ".join(f"w{rnd.randrange(90)}" for _ in range(30))
    found = [(k, line) for k in range(300)] + [(1000 + k, f"{line} {k % 7}") for k in range(50)] + [(None, line)] * 40
    docs = clash(spark, found)
    first = Counter(map(tuple, ngram_join.near_groups(docs).collect())), Counter(map(tuple, suffix_dedup.remove_repeats(docs).collect()))
    monkeypatch.setattr(shared, "COOL_ROWS", 20)
    assert (Counter(map(tuple, ngram_join.near_groups(docs).collect())), Counter(map(tuple, suffix_dedup.remove_repeats(docs).collect()))) == first
    assert first[1] == cut_down(found)
    groups = spark.createDataFrame([("a", 300, 1), ("b", 5, 2)], "k string, size long, v int")
    rows = spark.createDataFrame([("a", k) for k in range(300)] + [("b", k) for k in range(5)] + [("c", 1)], "k string, x int")
    joined = shared.join_groups(rows, groups, "k", "size")
    assert Counter((r.k, r.v) for r in joined.collect()) == {("a", 1): 300, ("b", 2): 5}


OWN = "doc_id long, text string, source string, __id string, __DIGEST string, __number long, __copies int, __aside_0 string"


def test_columns_of_any_name_are_kept(spark):
    found = [(k if k % 4 else None, f"{'word ' * 8}{k} {k % 3}", "s", f"id{k}", f"digest{k}", 100 + k, 7, f"aside{k}") for k in range(12)] + [(1, f"{'word ' * 8}1 1", "s", "id1", "digest1", 101, 7, "aside1")]
    docs = spark.createDataFrame(found, OWN)
    for function in (exact_dedup.keep_one, ngram_join.one_of_each, mixing.mixed):
        got = function(docs)
        assert got.columns == docs.columns
        rows_ = got.collect()
        assert rows_ and {tuple(r) for r in rows_} <= set(found)
        assert function(docs.limit(0)).count() == 0


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_with_labels_and_sources(spark, tmp_path):
    """Toxic documents go, near and exact copies go, and what is left is mixed as mix() counts."""
    rnd = random.Random(12)
    line = lambda ws, n: " ".join(rnd.choice(ws) for _ in range(n))
    clean, vile = [f"calm{k}" for k in range(200)], [f"vile{k}" for k in range(40)]
    found = [(k, line(vile, 60) if k % 3 == 0 else line(clean, 30 + k % 50), ["a", "b", None][k % 4 % 3]) for k in range(150)]
    found += [(200 + k, found[k][1].upper(), "a") for k in (1, 2, 4)] + [(300 + k, found[k][1] + " end", "b") for k in (5, 7)]
    docs = spark.createDataFrame(found, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(150)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    toxic = {r.doc_id for r in toxicity.predictions(docs, labels).where("predicted = 1").collect()}
    assert {k for k in range(0, 150, 3)} == {d for d in toxic if d < 150}
    want = brute_force([r for r in found if r[0] not in toxic])
    source = {(d, t.lower()): s for d, t, s in found}
    left = spark.createDataFrame([(d, t, source[d, t]) for d, t in want], SCHEMA)
    copies = Counter()
    for r in mixing.mix(left).collect():
        copies[r.doc_id] += r.copies
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert set(got) <= {d for d, _ in want} and len({source[d, t] for d, t in want}) == 3
    assert got == +copies
