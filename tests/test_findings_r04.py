"""What the review of round 4 found."""

import os
import time

import numpy as np
import pytest

from zonalis.llm import shared, suffix_dedup
from zonalis.operators import clusters, models, raster
from zonalis.plans import model_queries


def test_votes_that_differ_in_their_last_bits_are_equal(spark):
    a, b = [0.1 + 0.2, 0.3, 0.4 - 1e-16], [0.3, 0.1 + 0.2 + 2e-16, 0.4]
    votes = [(x, 0, m, [p, q, 0.2], True) for x, m, p, q in ((0, "a", 0.3, 0.1 + 0.2), (0, "b", 0.3, 0.3), (1, "a", 0.4, 0.4 + 2e-9), (1, "b", 0.4, 0.4 + 2e-9))]
    votes += [(2, 0, "a", a, True), (2, 0, "b", b, True)]
    got = raster.soft_vote(spark.createDataFrame(votes, "gx long, gy long, model string, probs array<double>, valid boolean"), 2).collect()
    assert {r.gx: (r["class"], r.p) for r in got} == {0: (1, 0.3), 1: (2, 0.400000002), 2: (3, 0.4)}


def shuffled(spark, run):
    """What run() gives, and the bytes that it shuffled."""
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = written()
    return run(), written() - before


def vectors(spark, n, width=16):
    x = np.random.default_rng(4).normal(size=(n, width))
    return x, spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "key long, x array<double>")


def test_a_silhouette_shuffles_each_row_once(spark):
    """Not once for each block of rows."""
    x, rows = vectors(spark, 1500)
    own = np.arange(1500) % 3
    labels = spark.createDataFrame([(k, "given", int(c)) for k, c in enumerate(own)], "key long, labelling string, cluster int")
    got, size = shuffled(spark, lambda: clusters.silhouettes(rows, labels, 50).head())
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    means = np.stack([far[:, own == c].sum(axis=1) / np.where(own == c, 499, 500) for c in range(3)], axis=1)
    a = means[np.arange(1500), own]
    means[np.arange(1500), own] = np.inf
    b = means.min(axis=1)
    assert (got.labelling, got.n) == ("given", 1500) and got.silhouette == pytest.approx(((b - a) / np.maximum(a, b)).mean(), abs=1e-12)
    assert size < 6 * x.nbytes


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_distances_by_products(far):
    """Equal rows are at distance 0, and near ones keep their digits, also far from the origin."""
    x = np.random.default_rng(5).normal(size=(40, 8)) + far
    y = np.concatenate([x[:10], x[10:20] + 1e-6, x[::-1], -x])
    want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    got = clusters.distances(x, y)
    assert np.allclose(got, want, rtol=1e-9, atol=0) and (got[np.arange(10), np.arange(10)] == 0).all()


def test_rows_without_a_cluster_have_no_part(spark):
    rows = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [10.0]), (4, [500.0]), (5, [700.0])], "key long, x array<double>")
    labels = spark.createDataFrame([(1, 7, 0), (2, 7, 0), (3, 7, 9), (4, 7, None), (4, 8, -1), (5, 8, -1)], "key long, labelling int, cluster int")
    got = {r.labelling: (r.n, r.silhouette) for r in clusters.silhouettes(rows, labels, 2).collect()}
    assert got == {7: (3, pytest.approx((9 / 10 + 8 / 9) / 3)), 8: (2, 0.0)}


def test_sweeps_keep_each_vector_once(spark, monkeypatch):
    """Not once for each number of clusters, neither in what is kept nor in what is shuffled."""
    x, rows = vectors(spark, 1200, 8)
    x[:600] += 4
    rows = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "key long, x array<double>")
    kept, persist = [], type(rows).persist
    monkeypatch.setattr(type(rows), "persist", lambda df, *level: kept.append(df) or persist(df, *level))
    found, size = shuffled(spark, lambda: {r.k: r for r in clusters.sweep(rows, range(2, 6), 2, 5, block=50).collect()})
    assert set(found) == {2, 3, 4, 5} and found[2].silhouette > found[5].silhouette and size < 20 * x.nbytes
    mixed = {r.k: r for r in models.sweep_gmm(rows, range(2, 4), starts=1).collect()}
    assert mixed[2].silhouette == pytest.approx(found[2].silhouette, abs=0.01) and mixed[2].davies_bouldin == pytest.approx(found[2].davies_bouldin, abs=0.05)
    assert len(kept) >= 4 and all(df.count() <= 1200 for df in kept)


def test_surroundings_of_several_columns(spark):
    """Each column as if it were alone, with NULLs of its own; a cell without any value around it has NULL."""
    rnd = np.random.default_rng(2)
    rows = [(k % 9, k // 9, *(None if rnd.random() < 0.4 else float(v) for v in rnd.normal(size=2))) for k in range(90) if k % 7] + [(50, 50, None, 1.0)]
    cells = spark.createDataFrame(rows, "gx long, gy long, a double, b double")
    got, names = models.with_context(cells, ["a", "b"])
    assert names == ["a", "b", "a_mean", "a_std", "b_mean", "b_std"]
    for r in got.collect():
        for c, i in (("a", 2), ("b", 3)):
            near = [x[i] for x in rows if abs(x[0] - r.gx) <= 1 and abs(x[1] - r.gy) <= 1 and x[i] is not None]
            want = (np.mean(near), np.std(near)) if near else (None, None)
            assert (r[f"{c}_mean"], r[f"{c}_std"]) == (pytest.approx(want[0]), pytest.approx(want[1], abs=1e-7))
    assert got.count() == len(rows)


def test_votes_of_odd_rows(spark):
    """Missing probabilities, models that lack a class, a model twice, and cells without a place."""
    rows = [(0, 0, "a", [0.2, 0.8], True), (0, 0, "b", [0.6, 0.2, 0.2], True), (1, 0, "a", None, True), (1, 0, "b", [1.0], True), (2, 0, "a", [0.5, None], True), (2, 0, "b", [None, 0.9], True)]
    rows += [(3, 0, "a", [1.0], True), (3, 0, "a", [0.0], True), (4, 0, None, [1.0], True), (4, 0, "a", [1.0], True), (5, 0, "a", [1.0], None), (5, 0, "b", [1.0], True), (6, 0, "a", [], True), (6, 0, "b", [], True)]
    got = raster.soft_vote(spark.createDataFrame(rows, "gx long, gy long, model string, probs array<double>, valid boolean"), 2)
    assert got.dtypes == [("gx", "bigint"), ("gy", "bigint"), ("class", "int"), ("p", "double")]
    assert {r.gx: (r["class"], r.p) for r in got.collect()} == {0: (2, 0.5), 1: (None, None), 2: (2, 0.9), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None)}


def test_cells_to_classify_are_made_once(spark):
    """The composite isn't made anew for each pass of the forests and for each column's surroundings."""
    data = "/root/testdata/sf0.001"
    cells, once = shuffled(spark, lambda: model_queries._classed(spark, data).collect())
    got, size = shuffled(spark, lambda: model_queries.classified_cells(spark, data).collect())
    assert {(r.gx, r.gy) for r in got} == {(r.gx, r.gy) for r in cells} and len(got) == len(cells)
    assert np.mean([r["class"] == c["class"] for r, c in zip(sorted(got), sorted(cells, key=lambda c: (c.gx, c.gy)), strict=True)]) > 0.9
    assert size < 8 * once


def shuffle_bytes(spark):
    """Bytes of shuffles on disk."""
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(k) for k in range(files.size())) if f.getName().startswith("shuffle_"))


def test_suffix_dedup_leaves_nothing_of_earlier_steps_on_disk(spark, monkeypatch):
    """When the surroundings are written, the texts' and anchors' shuffles are gone; the anchors go after them, and files are dense."""
    sent, seen = {}, {}

    def watched(df, name):
        if name == "surroundings":
            for _ in range(40):
                if (found := shuffle_bytes(spark)) <= 100_000:
                    break
                time.sleep(0.25)
            seen[name] = found
        sent[name] = shared.written(df, name)
        return sent[name]

    monkeypatch.setattr(suffix_dedup, "written", watched)
    rnd = np.random.default_rng(6)
    texts = ["".join(map(chr, rnd.integers(97, 123, 4000))) for _ in range(300)]
    docs = spark.createDataFrame([(k, t + "01"[k % 2] + texts[k // 2][:200]) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {k: 200 if k else 0 for k in range(300)}
    assert seen["surroundings"] <= 100_000
    anchors, around = (sent[n].inputFiles()[0].removeprefix("file:") for n in ("anchors", "surroundings"))
    assert not os.path.exists(anchors) and ".zstd." in around and os.path.exists(around)
    assert spark.conf.get("spark.sql.parquet.compression.codec") == "snappy"
