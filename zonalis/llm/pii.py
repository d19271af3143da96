"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score. DataFrame operations only.

The score decides over the kinds beside the base ones: a run of letters and digits is a secret only after words such as
"token" or "password".

The patterns below are written with possessive repetition and a look behind, so that a text of one long word takes linear
time; they find the same spans as the plain forms beside them. Positions come from the pieces between the matches: their
lengths, summed, are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.llm.shared import ascii_lower, let

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: kind: (pattern, context words that raise the score). Kinds in this order when spans start together.
PATTERNS: dict[str, tuple[str, str]] = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "mail|contact|write|correo|courriel"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "ip|address|server|host|login"),
    # [0-9]([\x20-]?[0-9])+
    "card": (r"[0-9]++(?:[\x20-][0-9]++)*+", "card|visa|master|credit|pay|tarjeta|carte|karte"),
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "phone|call|tel|mobile|fax"),
    # two letters, two check digits, groups of four, a shorter last group
    "iban": (r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])", "iban|account|bank|konto|compte|cuenta"),
    # a run of [A-Za-z0-9_+/=-] with letters and digits
    "secret": (r"[A-Za-z0-9_+/=-]{24,}+", "token|secret|passw|api|key|auth|bearer|credential"),
}
BASE = ["email", "ip", "card", "phone"]
#: What a span is worth by its pattern and checksum alone, and with a context word before it.
WORTH, NEAR = {"email": 0.8, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.9, "secret": 0.5}, 0.3
#: Spans of the kinds that aren't base kinds need this score: a checksum or a context word.
LEAST = 0.75
#: Code points before a span in which context words count.
CONTEXT = 40


def _luhn(digits: Column) -> Column:
    """The sum with every second digit from the right doubled is a multiple of 10."""
    n = F.length(digits)
    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def _mod97(code: Column) -> Column:
    """The first four characters moved to the end, letters as 10 to 35, read as one number: 1 modulo 97."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), let(digits, _luhn)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "secret":
        return found.rlike("[0-9]") & found.rlike("[A-Za-z]")
    if kind == "iban":
        return let(F.regexp_replace(found, " ", ""), lambda c: F.length(c).between(15, 34) & _mod97(c))
    return F.lit(True)


def _spans(text: Column, kind: str, order: int) -> Column:
    """array<struct<start, ord, kind, end, found>> of one kind in one text; none where validation fails."""
    pattern = PATTERNS[kind][0]
    empty = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int,found:string>>")

    def placed(matches: Column) -> Column:
        def of_pieces(pieces: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                start = acc["at"] + F.length(F.get(pieces, i))
                found = F.get(matches, i)
                end = start + F.length(found)
                here = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), end.alias("end"), found.alias("found"))
                more = F.when(_valid(kind, found), F.concat(acc["out"], F.array(here))).otherwise(acc["out"])
                return F.struct(end.alias("at"), more.alias("out"))

            zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))
            return F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), zero, step, lambda acc: acc["out"])

        return F.when(F.size(matches) == 0, empty).otherwise(let(F.split(text, pattern, -1), of_pieces))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), placed)


def _scored(text: Column, x: Column) -> Column:
    before = ascii_lower(F.substring(text, F.greatest(x["start"] - CONTEXT, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT))))
    worth, near = F.lit(0.0), F.lit(False)
    for kind, (_, context) in PATTERNS.items():
        near = F.when(x["kind"] == kind, before.rlike(context)).otherwise(near)
        worth = F.when(x["kind"] == kind, WORTH[kind]).otherwise(worth)
    score = F.least(worth + F.when(near, NEAR).otherwise(0.0), F.lit(1.0))
    return F.struct(x["start"], x["ord"], x["kind"], x["end"], x["found"], score.alias("score"))


def _with_spans(docs: DataFrame, least: float) -> DataFrame:
    """doc_id, text (null: empty) and spans, row by row."""
    text = F.coalesce("text", F.lit(""))
    every = F.concat(*[_spans(text, kind, k) for k, kind in enumerate(PATTERNS)])
    rows = docs.select("doc_id", text.alias("text"), F.array_sort(every).alias("spans"))
    kept = F.filter(F.transform("spans", lambda x: _scored(F.col("text"), x)), lambda x: x["kind"].isin(*BASE) | (x["score"] >= least))
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int,found:string,score:double>>")
    return rows.withColumn("spans", F.when(F.size("spans") == 0, none).otherwise(kept))


def find_pii(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per row of docs: doc_id and spans, array<struct<start, ord, kind, end, found, score>> in order of start, then kind.

    Positions are code points from 0, end exclusive. Kinds are searched apart, so spans of two kinds may overlap. Spans of
    base kinds stay whatever their score; others need least. Null text counts as empty; very long texts take time in
    proportion to their length and matches. Columns other than doc_id and text are ignored; repeated rows get the same
    spans; an empty table gives an empty result.
    """
    return _with_spans(docs, least).select("doc_id", "spans")


def redact(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id and text, row by row, with the spans of at least that score replaced by their kind in brackets; of overlapping ones the first.

    Null text becomes empty; rows without doc_id and repeated rows stay as they are many.
    """
    rows = _with_spans(docs, least).withColumn("spans", F.filter("spans", lambda x: x["score"] >= least))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])
        return F.when(x["start"] < acc["at"], acc).otherwise(F.struct(F.concat(acc["out"], gap, F.lit("["), x["kind"], F.lit("]")).alias("out"), x["end"].alias("at")))

    end = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    return rows.select("doc_id", F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, end).alias("text"))


def summary(spans: DataFrame) -> DataFrame:
    """find_pii() to counts and digests: doc_id, n_<base kind>, base_sha256, spans, n_spans."""
    def listed(keep) -> Column:
        return F.array_join(F.transform(F.filter("spans", keep), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in BASE]
    return spans.select("doc_id", *counts, F.sha2(listed(lambda x: x["kind"].isin(*BASE)), 256).alias("base_sha256"), listed(lambda x: F.lit(True)).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
