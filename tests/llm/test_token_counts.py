"""Edit-aware token counts against encoding the edited text anew."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from zonalis.llm import token_counts
from zonalis.llm.token_counts import Counts, Tree, even, node_sums

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PIECES = ["a", "word", " ", "  ", "\n", "\t", "'", "'l", "'ll", "'re", "12", "é", "…", "!?", "don't", " x", " ", "中文", "z" * 90]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def changed(text, start, removed, inserted):
    start = max(0, min(start, len(text)))
    stop = max(start, min(start + removed, len(text)))
    return text[:start] + inserted + text[stop:]


def test_random_edits(library):
    rnd, split, counter = random.Random(5), regex.compile(PATTERN), Counts(token_counts._ranks(PATH))
    piece = lambda n: "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, n)))
    for trial in range(150):
        text = piece(8) if trial % 3 else piece(1500)
        words = split.findall(text)
        table = counter.of(set(words))
        lengths, counts = np.array([len(w) for w in words], np.int32), np.array([table[w] for w in words], np.int32)
        tree = Tree(text, lengths, counts, even(len(words)), node_sums(lengths), node_sums(counts))
        for step in range(12):
            edit = (rnd.randint(-2, len(text) + 3), rnd.choice([0, 1, 2, 5, 400]), piece(rnd.choice([1, 4, 400])))
            text = changed(text, *edit)
            tree.edit(split, *edit)
            if step % 4 == 3:
                tree.fill(counter.of(set(tree.pending())))
                own, own_lengths, own_counts, buckets = tree.leaves()
                tokens, chars = (np.bincount(np.repeat(np.arange(len(buckets)), buckets), x, len(buckets)) for x in (own_counts, own_lengths))
                assert tree.tokens[tree.width :].tolist() == tokens.tolist() and tree.chars[tree.width :].tolist() == chars.tolist()
                assert all(x[k] == x[2 * k] + x[2 * k + 1] for x in (tree.tokens, tree.chars) for k in range(1, tree.width))
                if step % 8 == 7:  # the tree as it was written
                    tree = Tree(own, own_lengths, own_counts, buckets, tree.chars, tree.tokens)
                assert own == text
                assert own_lengths.tolist() == [len(w) for w in split.findall(text)]
                assert own_counts.sum() == tree.tokens[1] == len(library.encode_ordinary(text))
                assert tree.chars[1] == len(text)


def test_few_are_encoded_again():
    text = " ".join(f"word{k}" for k in range(5000))
    split, counter = regex.compile(PATTERN), Counts(token_counts._ranks(PATH))
    words = split.findall(text)
    table = counter.of(set(words))
    lengths, counts = np.array([len(w) for w in words], np.int32), np.array([table[w] for w in words], np.int32)
    tree = Tree(text, lengths, counts, even(len(words)), node_sums(lengths), node_sums(counts))
    tree.edit(split, 20000, 3, "new")
    assert 0 < tree.encoded < 8


def test_table(spark, library):
    schema = "doc_id long, text string, source string, edits long, counts string, n_tokens int"
    texts = [None, "", "one", " \n ", "it's  a test " * 400, "same", "same", "é" * 3000, "ab " * 20000]
    docs = spark.createDataFrame([(k if k else None, t, None, 1, "c", 2) for k, t in enumerate(texts)], schema).repartition(3)
    trees = token_counts.with_trees(docs, PATH, PATTERN)
    edited = trees.withColumn("edits", token_counts.revision(F.col("doc_id"), F.col("text")))
    result = token_counts.apply_edits(edited, PATH, PATTERN)
    rows = {(r.doc_id or 0): r for r in result.collect()}
    plans = {(r.doc_id or 0): (r.text, r.edits) for r in edited.collect()}
    assert len(rows) == len(texts)
    for k, before in enumerate(texts):
        text, edits = plans[k]
        assert text == (before or "")
        for e in edits:
            text = changed(text, e.start or 0, e.removed, e.inserted)
        row = rows[k]
        assert row.text == text
        assert row.tokens_before == len(library.encode_ordinary(before or ""))
        assert row.node_tokens[1] == sum(row.counts) == len(library.encode_ordinary(text))
        assert row.node_chars[1] == sum(row.lengths) == len(text)
    odd = trees.withColumn("edits", F.expr("CASE WHEN doc_id = 2 THEN array(NULL, named_struct('start', CAST(NULL AS int), 'removed', CAST(NULL AS int), 'inserted', CAST(NULL AS string))) END"))
    assert all(r.tokens_before == r.node_tokens[1] and r.pretokens_encoded == 0 for r in token_counts.apply_edits(odd, PATH, PATTERN).collect())
    assert token_counts.totals(token_counts.apply_edits(edited.limit(0), PATH, PATTERN)).count() == 0
    again = token_counts.apply_edits(result.withColumn("edits", F.array(F.struct(F.lit(3).alias("start"), F.lit(1).alias("removed"), F.lit("new text").alias("inserted")))), PATH, PATTERN)
    assert all(r.node_tokens[1] == len(library.encode_ordinary(r.text)) for r in again.collect())
