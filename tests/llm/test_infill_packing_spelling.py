"""Fill-in-middle, packing and spelling variants against brute force, on tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from zonalis.llm import infill, packing, spelling

PATH = P.path("byte_bpe_50k.json")
#: output, n, n_near, cut, start, list and side are names that the operators use.
SCHEMA = "doc_id long, text string, source string, output string, n long, n_near int, cut int, start long, list string, side int"


def rows():
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdeéÀ×") for _ in range(rnd.randint(4, 9))) for _ in range(60)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    out = [(1, None, "a"), (2, "", None), (3, "\n", "a"), (4, "\n\n\n", "b"), (5, "no line feed", None), (6, "ends with one\n", "c")]
    out += [(7, "has <P> in it\nand more", "a"), (8, "<S", "a"), (9, "M>\n<M\n>", "b"), (10, "<|endoftext|> is text", "b"), (11, "é\r\nÀ x\n日本", "tiny")]
    out += [(12, "\n".join(line(6) for _ in range(3000)), "a"), (13, "z" * 120_001 + " \n" + " " * 3000, "b"), (14, "Word" * 9000, "c")]
    out += [(k, "\n".join(line(rnd.randint(0, 9)) for _ in range(rnd.randint(1, 40))) + rnd.choice(["", "\n"]), rnd.choice(["a", "a", "b", None])) for k in range(20, 60)]
    out += [(None, line(30), "a"), (None, line(30), None), (None, None, None), (20, line(20), "b"), out[20], out[20], (-5, line(4).upper(), "a")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "o", 1, 1, 1, 1, "l", 1) for r in rows()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def filled(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = ("".join(x) for x in (lines[:low], lines[low:high], lines[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return doc_id, len(lines), "plain", None, None, text
    if h4 % 100 < 50:
        return doc_id, len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(docs, nothing):
    want = Counter(filled(d, t) for d, t, _ in rows())
    got = infill.fill_in_middle(docs).withColumn("text", infill.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:6] for r in got) == want
    assert Counter((r.doc_id, r.text) for r in got) == Counter((d, t or "") for d, t, _ in rows())
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    found = Counter((r.doc_id, r.n, r.form, r.output_sha256, r.restored_sha256) for r in infill.digests(docs).collect())
    assert found == Counter((r.doc_id, r.n, r.form, sha(r.output), sha(r.text)) for r in got)
    assert infill.digests(nothing).count() == 0
    assert infill.fill_in_middle(docs, rate=0).where("form <> 'plain' OR prefix_chars IS NOT NULL").count() == 0


def test_skip_list():
    rnd = np.random.default_rng(5)
    for n in (0, 1, 2, 17, 400, 5000):
        widths = rnd.integers(0, 9, n)
        units = infill.SkipList(widths)
        ends = [0, *np.cumsum(widths).tolist()]
        assert [units.code_points(k) for k in range(0, n + 1, max(1, n // 50))] == ends[:: max(1, n // 50)]
        assert n < 100 or len(units.lanes) > 2


def test_line_widths():
    for t in ("", "\n", "a", "a\n", "\n\na", "a\r\nb c\n\n"):
        assert infill.line_widths(t).tolist() == [len(x) for x in re.findall(r"[^\n]*\n|[^\n]+", t)]


def encoded():
    slow = Tokenizer.from_file(PATH)
    slow.encode_special_tokens = True
    return [(d, np.array([*slow.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), s) for d, t, s in rows()]


def check_packed(got, length, window):
    """Each document in pieces without gaps, each sequence without gaps or padding, each window with each source's share."""
    docs = encoded()
    total = sum(len(x) for _, x, _ in docs)
    # Which of the documents of one id a piece belongs to is told by its checksum.
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens, r.start].append((r.length, r.ids_crc32))
    for d, ids, _ in docs:
        at = 0
        while at < len(ids):
            found = pieces[d, len(ids), at]
            hit = next(x for x in found if zlib.crc32(ids[at : at + x[0]].tobytes()) == x[1])
            found.remove(hit)
            at += hit[0]
    assert not any(pieces.values())
    ends = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert sorted(ends) == list(range(len(ends))) and sum(ends.values()) == total
    sizes = [ends[k] for k in sorted(ends)]
    assert sizes[: total // length] == [length] * (total // length)
    assert sizes[total // length :] == [1 << b for b in reversed(range(length.bit_length())) if (total % length) >> b & 1]


@pytest.mark.parametrize(("length", "window"), [(2048, None), (64, 256), (32, 32)])
def test_packing(docs, length, window):
    found = packing.pack(docs, PATH, P.PATTERN, length, window)
    assert [f"{c} {'long' if k == 'bigint' else k}" for c, k in found.dtypes] == packing.PIECES.split(", ")
    check_packed(found.collect(), length, window or length)


def test_packing_of_big_totals(docs, monkeypatch):
    """Python's integers, which are taken where 64 bits could overflow, give the same places."""
    want = Counter(map(tuple, packing.pack(docs, PATH, P.PATTERN, 64, 128).collect()))
    rnd = np.random.default_rng(1)
    sizes = [int(x) for x in rnd.integers(3000, 90000, 7)]
    j = rnd.integers(0, 7, 200)
    first = np.array([rnd.integers(0, sizes[k] - 40) for k in j])
    n = rnd.integers(1, 40, 200)
    small, big = packing.Schedule(sizes, 128, 64), packing.Schedule(sizes, 128, 64)
    big.borders = big.borders.astype(object)
    assert all((np.asarray(a) == np.asarray(b)).all() for a, b in zip(small.pieces(j, first, n), big.pieces(j, first, n), strict=True))
    huge = packing.Schedule([10**13, 3 * 10**12], 2048, 2048)
    row, start, size, sequence, offset = huge.pieces(np.array([0, 1]), np.array([10**13 - 5, 0]), np.array([5, 9]))
    assert sum(size) == 14 and max(sequence) == (13 * 10**12) // 2048 - 1 + ((13 * 10**12) % 2048 > 0)
    assert Counter(map(tuple, packing.pack(docs, PATH, P.PATTERN, 64, 128).collect())) == want


def test_windows_hold_each_sources_share(spark):
    rnd = random.Random(2)
    rows = [(k, " ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.randint(1, 300))), "abcd"[min(3, k % 7)]) for k in range(300)]
    source = {k: s for k, _, s in rows}
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), PATH, P.PATTERN, 256).collect()
    share, windows = Counter(), defaultdict(Counter)
    for r in got:
        share[source[r.doc_id]] += r.length
        windows[r.sequence_id][source[r.doc_id]] += r.length
    total = sum(share.values())
    full = [w for w in windows.values() if sum(w.values()) == 256]
    assert len(full) > 50 and all(abs(w[s] - 256 * share[s] / total) < 2 for w in full for s in share)


def test_tiny_sources_share_a_queue(spark):
    rows = [(k, "word " * 200, "large") for k in range(40)] + [(100 + k, "x", f"tiny{k}") for k in range(30)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), PATH, P.PATTERN, 32).collect()
    assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values()) and len({r.doc_id for r in got}) == 70
    only = packing.pack(spark.createDataFrame([(k, "x", f"tiny{k}") for k in range(50)], "doc_id long, text string, source string"), PATH, P.PATTERN, 4).collect()
    assert sum(r.length for r in only) == 100 and max(r.sequence_id for r in only) == 24


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing, PATH, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        packing.pack(nothing, PATH, P.PATTERN, 100)


def spelled(rows, factor=5, rarest=5):
    lower, count = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), Counter()
    for d, t, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    count = {w: n for w, n in count.items() if len(w) >= 6 and n >= rarest}
    near = {w: [o for o in count if one_edit(w, o)] for w in count}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda o: (-count[o], o), default=None)
        if best and count[best] >= factor * count[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), count.get(form.get(w))) for w, n in count.items()}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.fixture(scope="module")
def misspelled():
    """Chains of forms, ties, words of long lists, slips, capitals, letters beyond ASCII."""
    rnd = random.Random(7)
    base = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(5, 11))) for _ in range(90)] + ["aaaaaaa", "aaaaaaaa", "aaaaaa", "ababab", "bababa"]
    words = Counter({w: rnd.choice([1, 4, 5, 6, 30, 160, 900]) for w in base})
    for w in base[:60]:
        for _ in range(rnd.randint(1, 6)):
            i, c = rnd.randrange(len(w) + 1), rnd.choice("abcdéÀ")
            words[rnd.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])] += rnd.choice([5, 6, 31, 155])
    flat = [w if rnd.random() < 0.7 else w.upper() if w.isascii() else w.capitalize() for w, n in words.items() for _ in range(n)]
    rnd.shuffle(flat)
    rows = [(None if k % 11 == 0 else k // 300 % 13, " ".join(flat[k : k + 300]) + rnd.choice(["", ".", "1x"]), "s") for k in range(0, len(flat), 300)]
    return [*rows, (3, None, "s"), (3, "", "s"), *[(4, f"{'q' * 5000} {'q' * 5001}", "s")] * 5, (5, "q" * 70_000, "s"), rows[0], rows[0]]


@pytest.mark.parametrize(("hot", "inner", "grams"), [(128, 16384, (2, 4)), (3, 60, (2, 5)), (20, 500, (2, 2))])
def test_variants(spark, misspelled, hot, inner, grams, monkeypatch):
    docs = spark.createDataFrame([(*r, 1, "x") for r in misspelled], "doc_id long, text string, source string, n long, word string").repartition(3)
    plain = spelling.near_words
    monkeypatch.setattr(spelling, "near_words", lambda words: plain(words, grams, inner, hot))
    monkeypatch.setattr(spelling, "COUNTED", 50)
    found = spelling.variants(docs)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got, want = list(map(tuple, found.collect())), spelled(misspelled)
    assert set(got) == want and len(got) == len(want)
    assert sum(form is not None for _, form, *_ in want) > 20 and any(root != form for _, form, root, *_ in want if form)


def test_variants_of_nothing(spark, nothing):
    assert spelling.variants(nothing).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "few words here", "s")], "doc_id long, text string, source string")).count() == 0


def test_one_edit_changes_no_more_grams_than_said():
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("abcdé") for _ in range(rnd.randint(6, 11))) for _ in range(900)})
    counts = Counter(w[p : p + q] for w in words for q in (2, 3) for p in range(len(w) - q + 1))
    for least in (5, 30, 100):
        index = spelling.Grams({g: n for g, n in counts.items() if n > least})
        for w in rnd.sample(words, 60):
            for high in (4, 3, 2):
                own = index.grams(w, high)
                most = index.affected(w, own, high)
                grams = {(w[a:b], a) for a, b in own}
                for at in range(len(w) + 1):
                    for c in "abcdéz":
                        for other in (w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]):
                            move = len(other) - len(w)
                            held = {(other[a:b], a - m) for a, b in index.grams(other, high) for m in {0, move}}
                            assert len(grams - held) <= most
