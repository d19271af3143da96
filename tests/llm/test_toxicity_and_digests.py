"""Toxicity scores against a plain version of the whole operator, and the digest index batch by batch."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from zonalis.llm import exact_dedup, toxicity


def plain_terms(text):
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        out[word] += 1
        for n in (4, 5, 6):
            if len(word) > n:
                out[word[:n] + "*"] += 1
    return out


def plain_isotonic(pairs):
    """Rates by the greatest lower mean: for each share the maximum over starts of the minimum over ends."""
    ties = {}
    for share, label in pairs:
        ties.setdefault(round(share, 9), []).append(label)
    order = sorted(ties)
    mean = lambda a, b: sum(sum(ties[s]) for s in order[a : b + 1]) / sum(len(ties[s]) for s in order[a : b + 1])
    fitted = [round(max(min(mean(a, b) for b in range(i, len(order))) for a in range(i + 1)), 12) for i in range(len(order))]
    base = sum(y for _, y in pairs) / len(pairs)
    pools = []
    for rate in sorted(set(fitted)):
        shares = [s for s, f in zip(order, fitted, strict=True) if f == rate]
        labels = [y for s in shares for y in ties[s]]
        pools.append((sum(s * len(ties[s]) for s in shares) / len(labels), (sum(labels) + base) / (len(labels) + 1)))
    rates = np.maximum.accumulate([0.0, *(r for _, r in pools), 1.0])
    return [0.0, *(s for s, _ in pools), 1.0], rates


def plain_scores(documents, labels):
    """Scores of all documents: the same rules, all cosines by dictionaries, no index."""
    learn = [(d, t, labels[d]) for d, t in documents if d in labels and zlib.crc32(str(d).encode()) % 3 != 1]
    counts = {d: plain_terms(t) for d, t, _ in learn}
    n, toxic = len(learn), sum(y for *_, y in learn)
    clean = n - toxic
    by = [Counter(t for d, _, y in learn if y == want for t in counts[d]) for want in (0, 1)]
    chosen = []
    for t in set(by[0]) | set(by[1]):
        a, df = by[1][t], by[0][t] + by[1][t]
        excess = a * clean - by[0][t] * toxic
        chi2 = n * excess * excess / (df * (n - df) * clean * toxic) if n > df else 0
        if a >= 3 and excess > 0 and chi2 >= 20:
            chosen.append((t, math.log(1 + n / df)))
    idf = dict(chosen)

    def unit(c):
        w = {t: (1 + math.log(c[t])) * idf[t] for t in c if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()} if norm else {}

    vectors = sorted((d, y, unit(counts[d])) for d, _, y in learn if unit(counts[d]))
    bare = [y for d, _, y in learn if not unit(counts[d])]
    prior = (sum(bare) + 0.5) / (len(bare) + 1)

    def share(c, without=None):
        q = unit(c)
        found = [(-round(sum(x * v.get(t, 0) for t, x in q.items()), 9), d, y) for d, y, v in vectors if d != without]
        near = sorted(f for f in found if f[0] < 0)[:15]
        votes = sum(f[0] ** 2 for f in near)
        return (sum(f[0] ** 2 * f[2] for f in near) + 0.5 * prior) / (votes + 0.5)

    curve = plain_isotonic([(share(counts[d], d), y) for d, _, y in learn])
    return {d: float(np.interp(share(plain_terms(t)), *curve)) for d, t in documents}


def test_scores_are_those_of_a_plain_version(spark):
    rnd = random.Random(7)
    usual, rude = [f"{a}{b}" for a in "tarelomi" for b in ("nesto", "ri", "gulamento", "po")], ["grubian", "vilekin", "snotty"]
    documents, labels = [], {}
    for d in range(240):
        labels[d] = int(rnd.random() < 0.3)
        words = [rnd.choice(usual) for _ in range(rnd.randint(5, 40))]
        if labels[d] and rnd.random() < 0.9 or rnd.random() < 0.03:
            words[rnd.randrange(len(words)) :] = [rnd.choice(rude) for _ in range(rnd.randint(1, 3))]
        documents.append((d, " ".join(words)))
    documents += [(900, None), (901, ""), (902, "grubian " * 3000), (903, documents[3][1])]
    got = toxicity.predictions(spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")).collect()
    want = plain_scores(documents, labels)
    assert len(got) == len(want) and len(set(np.round(list(want.values()), 6))) > 10
    for row in got:
        assert row.score == pytest.approx(want[row.doc_id], abs=1e-6), row
        assert row.predicted == int(row.score >= 0.7)


def test_isotonic_is_the_greatest_lower_mean():
    rnd = random.Random(3)
    for _ in range(40):
        pairs = [(round(rnd.random(), 1 if rnd.random() < 0.5 else 3), rnd.randint(0, 1)) for _ in range(rnd.randint(2, 40))]
        got = toxicity.isotonic([s for s, _ in pairs], [y for _, y in pairs])
        if len({y for _, y in pairs}) < 2:
            assert got is None
            continue
        at, rates = plain_isotonic(pairs)
        assert np.allclose(got[0], at) and np.allclose(got[1], rates)
        assert np.all(np.diff(got[0]) >= 0) and np.all(np.diff(got[1]) >= 0)


def test_scores_are_calibrated(spark):
    """The mean score of each tenth of the scale is near the toxic rate of the rows whose labels were not used."""
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.predictions(documents, labels).join(labels, "doc_id").where("held_out").select("score", "toxic").collect()
    tenths: dict[int, list] = {}
    for r in rows:
        tenths.setdefault(min(9, int(r.score * 10)), []).append((r.score, int(r.toxic)))
    error = sum(abs(sum(s for s, _ in v) - sum(y for _, y in v)) for v in tenths.values()) / len(rows)
    assert error <= 0.02


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("few", [0, 256])
def test_batches_probe_earlier_runs(spark, keep, few, monkeypatch):
    """Hits of each batch, and the merged entries, are those of a dictionary; also after compaction and with an empty batch."""
    monkeypatch.setattr(exact_dedup, "FEW", few)
    rnd = random.Random(11)
    digest = lambda k: hashlib.sha256(str(k).encode()).hexdigest()
    batches = [[(rnd.randint(0, 999) if rnd.random() < 0.9 else None, digest(int(rnd.paretovariate(0.5)) % 300)) for _ in range(n)] for n in (120, 0, 200, 60, 90)]
    best = max if keep == "largest" else min
    index, seen = exact_dedup.DigestIndex(spark, keep), {}
    for k, batch in enumerate(batches):
        own = Counter(d for _, d in batch)
        want = {d for d, n in own.items() if n > 1 or d in seen}
        assert {r.digest for r in index.add(spark.createDataFrame(batch, "doc_id long, digest string")).collect()} == want
        for i, d in batch:
            seen.setdefault(d, []).append(i)
        if k in (2, 4):
            merged = {r.digest: (r.keep_id, r.group_size) for r in index.compact().collect()}
            assert merged == {d: (best((i for i in ids if i is not None), default=None), len(ids)) for d, ids in seen.items()}
            assert index.runs == 1
    asked = spark.createDataFrame([(digest(k),) for k in (1, 2, 5000)], "digest string")
    assert {r.digest for r in index.probe(asked).collect()} == {digest(k) for k in (1, 2)} & set(seen)
    index.close()


def test_hits_of_the_operator_are_the_groups(spark):
    """Copies within one task's share and across shares, a text of a third of all rows, null ids and texts."""
    rows = [(k, "hot text" if k % 3 == 0 else f"Text {k % 50}") for k in range(3000)] + [(None, "text 1"), (None, None), (5000, ""), (5001, "Alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    groups: dict[str, list] = {}
    for d, t in rows:
        groups.setdefault((t or "").lower(), []).append(d)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ids)
    assert Counter(tuple(r) for r in exact_dedup.exact_dedup(docs).collect()) == want
