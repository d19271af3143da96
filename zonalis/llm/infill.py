"""Fill-in-middle: a text is cut at two line borders, and its parts are put in another order.

A text's lines are the nodes of an indexable skip list. Each lane's links carry two widths, in units (lines) and in code
points. To find where a unit rank lies in the text, a search goes along the topmost lane while the units passed don't
exceed the rank, then goes on one lane below; the code points of the links it took are the place. Only the two places
leave Python; the parts are cut and put together by Spark's own functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.llm.grams import mixed
from zonalis.llm.shared import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def line_widths(text: str) -> np.ndarray:
    """The code points of each line, its line feed included."""
    parts = text.split("\n")
    widths = [len(p) + 1 for p in parts[:-1]]
    return np.array(widths + [len(parts[-1])] if parts[-1] else widths, np.int64)


class SkipList:
    """Units in order, each so many code points wide. A node's height is drawn from a hash of its number: one in four goes a lane up."""

    def __init__(self, widths: np.ndarray):
        n = len(widths)
        ends = np.concatenate([[0], np.cumsum(widths)])
        draw = mixed(np.arange(1, n + 1, dtype=np.uint64))
        nodes = np.arange(n + 1)  # 0 is the head; node k stands after k units
        self.size, self.lanes = n, []
        shift = 0
        while True:
            # Of each link from node to node: units, code points; and where the node it starts from stands in the lane below.
            below = np.searchsorted(self.lanes[-1][0], nodes) if self.lanes else nodes
            self.lanes.append((nodes, np.diff(nodes), np.diff(ends[nodes]), below))
            inner = nodes[1:]
            up = inner[(draw[inner - 1] >> np.uint64(shift)) & np.uint64(3) == 0]
            if not len(up) or shift > 60:
                break
            nodes, shift = np.concatenate([[0], up]), shift + 2

    def code_points(self, rank: int) -> int:
        """How many code points the first rank units have."""
        units = place = at = 0
        for nodes, unit_widths, place_widths, below in reversed(self.lanes):
            while at < len(unit_widths) and units + unit_widths[at] <= rank:
                units, place, at = units + unit_widths[at], place + place_widths[at], at + 1
            at = below[at]
        return int(place)


def cuts(texts: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
    """Lines of each text, and the code points before the two cuts, the first cut first."""
    rows = []
    for text, a, b in zip(texts, h1, h2, strict=True):
        units = SkipList(line_widths(text))
        low, high = sorted((int(a) % (units.size + 1), int(b) % (units.size + 1)))
        rows.append((units.size, units.code_points(low), units.code_points(high)))
    return pd.DataFrame(rows, columns=["n", "first", "second"])


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed:doc_id; a null doc_id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """One row per row of docs: doc_id, n, form, prefix_chars, middle_chars, output.

    n counts lines. rate: per cent of texts that are cut; spm: per cent of those that put the suffix first. A text that is
    empty or holds a mark stays as it is (form plain, null widths). Null text counts as empty, null doc_id draws as an
    empty one; repeated rows and rows of one doc_id draw alike. Cuts may meet, or lie at either end, which leaves parts
    empty. Texts are taken whole, one at a time in memory. Columns other than doc_id and text are ignored; an empty table
    gives an empty result.
    """
    small_batches(docs.sparkSession)
    places = F.pandas_udf(cuts, "n long, first long, second long")
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", h3.alias("h3"), h4.alias("h4"), places("text", h1, h2).alias("cut"))
    plain = (F.col("text") == "") | (F.col("h3") % 100 >= rate)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.col("text").contains(mark)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "cut", form.alias("form"))
    first, second = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), first), F.substring("text", first + 1, second - first), F.substring("text", second + 1, F.length("text"))
    output = F.when(F.col("form") == "plain", F.col("text"))
    output = output.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    output = output.otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    cut = F.col("form") != "plain"
    return rows.select("doc_id", F.col("cut.n").alias("n"), "form", F.when(cut, F.col("cut.first")).alias("prefix_chars"), F.when(cut, F.col("cut.second") - F.col("cut.first")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle got, from what it gave: texts that are cut hold no marks, so the marks found are its own."""
    body = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    ahead, middle = F.substring_index(body, MIDDLE, 1), F.substring_index(body, MIDDLE, -1)
    psm = F.concat(F.substring_index(ahead, SUFFIX, 1), middle, F.substring_index(ahead, SUFFIX, -1))
    spm = F.concat(F.substring_index(ahead, PREFIX, -1), middle, F.substring_index(ahead, PREFIX, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(docs: DataFrame) -> DataFrame:
    """fill_in_middle with SHA-256 of its outputs and of the texts rebuilt from them, in place of the outputs."""
    cut = fill_in_middle(docs)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
