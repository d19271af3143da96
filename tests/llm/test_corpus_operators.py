"""The operators against brute force, on a table with odd rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import base64
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from zonalis.llm import byte_bpe, exact_dedup, mixing, ngram_join, pii, quality, suffix_dedup, toxicity, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hub long, token string, digest string"


def texts():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = line(200)
    out = [None, "", " \t\n", "one", "a b c d", "A b C d", "x " * 300, "é" * 40, "z" * 20000, base, base.upper(), base]
    for k in range(12):  # near copies, some too far
        w = base.split()
        for _ in range(k):
            w[rnd.randrange(len(w))] = "edit"
        out.append(" ".join(w))
    passage = line(20)
    out += [f"{line(rnd.randint(3, 30))} {passage} {line(rnd.randint(3, 30))}" for _ in range(8)] + [line(rnd.randint(1, 60)) for _ in range(10)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 3 + 1, t, None if k % 4 else "en", None if k % 5 == 0 else f"s{k % 3}", k, 1, "t", "d") for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def test_near_groups(docs, nothing):
    sets, own = {}, by_id(docs)
    for d, t in own.items():
        w = WORD.findall(t.translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in own}
    for a in sorted(own):
        for b in sorted(own):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {d: lo if r == hi else r for d, r in root.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_groups(docs).collect()}
    assert got == {d: (len(sets[d]), root[d]) for d in own}
    assert ngram_join.near_groups(nothing).count() == 0


def test_split_postings(docs, monkeypatch):
    want = sorted(map(tuple, ngram_join.near_groups(docs).collect()))
    monkeypatch.setattr(ngram_join, "POSTING", 2)
    monkeypatch.setattr(ngram_join, "PARTNERS", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 2)
    for turns in (2, 0):
        monkeypatch.setattr(ngram_join, "TURNS", turns)
        assert sorted(map(tuple, ngram_join.near_groups(docs).collect())) == want


def test_short_counts():
    counts = np.array([0, 254, 255, 256, 70000, 3])
    assert ngram_join.whole_counts(ngram_join.short_counts(counts), 6).tolist() == counts.tolist()


def test_has_partner():
    rnd = np.random.default_rng(2)
    for _ in range(50):
        rows = sorted((int(t), int(n), int(rnd.integers(1, n + 1))) for t, n in zip(rnd.integers(0, 4, 12), rnd.integers(1, 40, 12), strict=True))
        t, n, left = map(np.array, zip(*rows, strict=True))
        fits = lambda i, j: t[i] == t[j] and 4 * n[j] >= 3 * n[i] and left[i] * 175 >= 75 * (n[i] + n[j])
        want = [any(fits(i, j) for j in range(12) if j != i) for i in range(12)]
        assert ngram_join.has_partner(t, n, left, 75).tolist() == want


def removed(own):
    """What brute force leaves of each text."""
    seen, want = {}, {}
    for d, t in sorted(own.items()):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen.setdefault(b[p : p + 50], d) < d:
                gone[p : p + 50] = b"\1" * 50
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        want[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return want


@pytest.mark.parametrize("hot", [4096, 2, 0])
def test_suffix_dedup(docs, nothing, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_FLUSH", 1 << 10 if hot else 1 << 20)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs, hot).collect()}
    assert got == removed(by_id(docs))
    assert suffix_dedup.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("hot", [4096, 0])
def test_suffix_dedup_without_repeats(spark, hot):
    """Documents share an anchor but no window, or no task sees two of a hot anchor's documents."""
    rnd = random.Random(9)
    line = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    shared = [line(k) for k in (20, 30, 40, 43)]
    rows = [(k, line(60) + shared[k % 4] + line(60)) for k in range(40)]
    for parts in (1, 40):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs, hot).collect()}
        assert got == removed(dict(rows)) and not any(x[1] for x in got.values())


def test_sorted_windows():
    rnd = np.random.default_rng(5)
    text = np.concatenate([np.append(rnd.integers(1, 4, 90).astype(np.uint8), 0) for _ in range(20)])
    starts = np.concatenate([k * 91 + np.arange(80) for k in range(20)])
    order, same = suffix_dedup.sorted_windows(text, starts, 10)
    key = [text[p : p + 10].tobytes() for p in order]
    assert key == sorted(key) and same.tolist() == [False] + [a == b for a, b in zip(key, key[1:], strict=False)]


def test_exact_dedup(docs, nothing):
    groups = defaultdict(list)
    own = by_id(docs)
    for d, t in own.items():
        groups[t.translate(LOWER)].append(d)
    want = {d: (max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}
    assert {r.doc_id: tuple(r)[1:] for r in exact_dedup.exact_dedup(docs).collect()} == want
    assert exact_dedup.exact_dedup(nothing).count() == 0
    assert exact_dedup.keep_one(docs.union(docs)).count() == len(groups)


def test_byte_bpe(docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(docs, path, public_tokenizers.PATTERN).collect()}
    for d, t in by_id(docs).items():
        ids = plain.encode_ordinary(t)
        assert got[d] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert byte_bpe.digests(nothing, path, public_tokenizers.PATTERN).count() == 0


def test_nearest_is_exact():
    rnd = random.Random(1)
    idf = {f"t{k}": rnd.uniform(0.5, 3) for k in range(60)}
    examples = [(k, rnd.randint(0, 1), {t: rnd.randint(1, 4) for t in rnd.sample(sorted(idf), 6)}) for k in range(500)]
    index = toxicity.BlockMaxIndex.build(examples, idf, 0.1, block=16)
    vectors = [toxicity.unit(c, idf) for _, _, c in examples]
    for _ in range(30):
        q = toxicity.unit({t: 1 for t in rnd.sample(sorted(idf), 5)}, idf)
        at, cos = index.nearest(q, 15, 16)
        every = sorted(((-round(sum(w * v.get(t, 0) for t, w in q.items()), 9), k) for k, v in enumerate(vectors)))[:15]
        assert at.tolist() == [k for _, k in every] and np.allclose(cos, [-c for c, _ in every])


def test_toxicity_held_out(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.predictions(documents, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic) and sum(r.predicted for r in rows if not r.toxic) <= 0.01 * len(rows)


def test_toxicity_odd_rows(docs, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.predictions(docs, none).collect()} == {0.5}
    assert toxicity.predictions(nothing, none).count() == 0


def test_pii(spark):
    t = "a@b.co x@y@z.com 1.2.3.4 300.1.1.1 card 4111 1111 1111 1111 +49 30 1234 5678 GB82 WEST 1234 5698 7654 32 a@b.c_d@e.f"
    docs = spark.createDataFrame([(1, t), (2, None), (3, "é" * 10 + " q@r.st"), (4, "a" * 30000)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.summary(pii.find_pii(docs)).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (4, 1, 1, 1) and "iban:" in got[1].spans
    assert got[2].spans == got[4].spans == "" and got[3].spans == "email:11:17"
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()}[3] == "é" * 10 + " [email]"
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'Token = "{key}"'), (1, f'Token = "{key}"'), (None, f"commit {key}"), (None, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.spans, r.n_spans) for r in pii.summary(pii.find_pii(odd)).collect()) == [(0, "", 0), (0, "", 0), (1, "secret:9:49", 1), (1, "secret:9:49", 1)]
    assert sorted(r.text for r in pii.redact(odd).collect()) == ["", 'Token = "[secret]"', 'Token = "[secret]"', f"commit {key}"]
    assert pii.summary(pii.find_pii(odd.limit(0))).count() == 0


def test_mixing(docs, nothing):
    rows = mixing.mix(docs).collect()
    total = sum(r["size"] for r in rows)
    by_source = {r.source: (r.source_size, r.target) for r in rows}
    assert sum(t for _, t in by_source.values()) == pytest.approx(total) and all(t <= 3 * s + 1e-6 for s, t in by_source.values())
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows) and sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, rows))
    assert mixing.mix(nothing).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def test_urls(spark):
    urls = ["http://A.b.COM/en/1", "https://x.example.com/en/77?q", "example.net/de/8", None, "http://example.net/de/81", "http://notexample.net/de/8", "http://org/es/#f", "http://com", "http://com./en/"]
    got = [tuple(r) for r in url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert [r[4] for r in got] == ["block", "allow", "allow", "allow", "allow", "block", "block", "allow", "allow"]
    assert got[0][1:4] == ("a.b.com", "/en/1", "com/en/") and got[3][1:4] == ("", "", None)


def test_urls_odd_rows(spark):
    rows = [(1, "http://com/en/", 5), (1, "http://com/en/", 5), (None, None, 6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule long")
    got = sorted((r.page_id or 0, r.host, r.verdict) for r in url_filters.judge(pages).collect())
    assert got == [(0, "", "allow"), (1, "com", "block"), (1, "com", "block")]
    assert url_filters.judge(pages.limit(0)).count() == 0


def test_trie_against_all_rules():
    rnd = random.Random(6)
    part = lambda: rnd.choice(["a", "ab", "abc", "b", ""])
    rules = [(rnd.choice(["allow", "block"]), rnd.choice(["com", "x.com", "y.x.com"]) + "/" + "/".join(part() for _ in range(rnd.randint(0, 3)))) for _ in range(60)]
    trie = url_filters.build_trie(rules)
    for _ in range(300):
        host, path = rnd.choice(["com", "x.com", "y.x.com", "z.y.x.com", "xx.com"]), "/" + "/".join(part() for _ in range(rnd.randint(0, 4)))
        fit = [(h.count("."), len(p), v == "block", h + p) for v, r in rules for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fit) if fit else None
        assert url_filters.longest(trie, host, path) == ((want[3], "block" if want[2] else "allow") if want else (None, None))


def test_many_rules_below_one_host():
    trie = url_filters.build_trie([("block", f"com/page{k}") for k in range(20_000)])
    assert url_filters.longest(trie, "www.com", "/page12345") == ("com/page12345", "block")


def test_quality(docs, nothing):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for d, t in by_id(docs).items():
        w = WORD.findall(t)
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        repeat = len({i + k for p in at.values() if len(p) > 1 for i in p for k in range(3)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (got[d].n_words, got[d].word_chars, got[d].n_repeat_words, got[d].n_dup_lines) == (len(w), sum(map(len, w)), repeat, len(lines) - len(set(lines)))
    assert quality.quality_rules(nothing).count() == 0
