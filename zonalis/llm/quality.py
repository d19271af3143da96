"""Quality rules: a table of thresholds compiled into one projection of length, symbol, stop-word and line ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.llm.shared import let, words

#: Common words of four languages.
STOP_WORDS = {
    "en": ["the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "it", "for", "on", "as"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "eine", "zu", "den", "mit", "von"],
    "fr": ["le", "la", "les", "de", "et", "des", "un", "une", "est", "que", "en", "du"],
    "es": ["el", "la", "los", "de", "que", "y", "en", "un", "una", "las", "por", "con"],
}

#: (measure, least, most); None: no bound. A document passes if each measure that it has is within its bounds.
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("n_words", 50, 100_000),
    ("repeat_ratio", None, 0.5),
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", None, 0.2),
    ("stop_word_ratio", 0.005, None),
    ("dup_line_ratio", None, 0.4),
]


def repeated_positions(tokens: Column, span: int = 3) -> Column:
    """How many words lie in windows of span words that occur at least twice.

    A window is a 64-bit hash with its position in the low bits, so that one sort of longs brings equal windows together;
    a second hash, of what the first finds, makes a chance match as unlikely as with a hash of over 80 bits.
    """
    def packed(at: Column, w: Column, bits: Column, seed: int) -> Column:
        parts = [F.get(w, at + k) for k in range(span)]
        return F.call_function("shiftleft", F.xxhash64(F.lit(seed), *parts), bits).bitwiseOR(at.cast("long"))

    def runs(found: Column, bits: Column) -> Column:
        """Positions of those whose neighbour in order has the same hash."""
        top = lambda x: F.call_function("shiftright", x, bits)
        same = lambda s: F.filter(s, lambda x, i: top(x).eqNullSafe(top(F.get(s, i - 1))) | top(x).eqNullSafe(top(F.get(s, i + 1))))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        return F.transform(let(F.sort_array(found), same), lambda x: x.bitwiseAND(mask).cast("int"))

    def count(w: Column) -> Column:
        n = F.size(w)
        bits = F.when(n <= 1 << 20, 20).otherwise(31)
        first = runs(F.transform(F.sequence(F.lit(0), n - span), lambda i: packed(i, w, bits, 1)), bits)
        second = lambda a: F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(runs(F.transform(a, lambda i: packed(i, w, bits, 2)), bits))
        covered = lambda s: F.aggregate(s, F.struct(F.lit(-span).alias("last"), F.lit(0).cast("long").alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(span))).alias("n")), lambda acc: acc["n"])
        return F.when(n < span + 1, F.lit(0).cast("long")).otherwise(let(F.sort_array(let(first, second)), covered))

    return let(tokens, count)


def measures(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id and counts of the text; null text has no words, no symbols and no lines."""
    text = F.coalesce("text", F.lit(""))
    stop = F.array(*[F.lit(w) for w in sorted({w for ws in STOP_WORDS.values() for w in ws})])

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_positions(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.array_contains(stop, F.lower(x)))).cast("long").alias("n_stop_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(
        "doc_id",
        let(words(F.col("text")), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        (F.size(F.split(text, r"[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
    )
    return rows.select("doc_id", "w.*", "l.*", "n_symbols")


def verdict(thresholds: list[tuple[str, float | None, float | None]]) -> Column:
    """The table as one condition. A ratio over nothing has no value and passes."""
    ratio = {
        "n_words": F.col("n_words"),
        "repeat_ratio": F.try_divide("n_repeat_words", "n_words"),
        "mean_word_chars": F.try_divide("word_chars", "n_words"),
        "symbol_ratio": F.try_divide("n_symbols", "n_words"),
        "stop_word_ratio": F.try_divide("n_stop_words", "n_words"),
        "dup_line_ratio": F.try_divide("n_dup_lines", "n_lines"),
    }
    bounds = []
    for name, least, most in thresholds:
        bounds += [F.coalesce(ratio[name] >= least, F.lit(True))] * (least is not None)
        bounds += [F.coalesce(ratio[name] <= most, F.lit(True))] * (most is not None)
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


def quality_rules(docs: DataFrame, thresholds: list[tuple[str, float | None, float | None]] = THRESHOLDS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Documents with null or empty text have no words and fail. Columns other than doc_id and text are ignored; repeated
    rows are judged alike; an empty table gives an empty result.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = measures(docs).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(thresholds))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
