"""Operator 8, personal data: regular expressions propose, validators confirm, context adjusts.

All of it is Spark SQL expressions. A pattern's matches and the text between them come from the
same regular expression, so that one fold over both gives each match its place in code points;
the fold keeps a match only if its validator accepts it. Patterns are written so that a match can
begin only where a run of its characters begins, and quantifiers give nothing back: a text of any
length is passed over once. Both leave the leftmost, longest matches as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm.scratch import read

SPAN = "array<struct<start:bigint,end:bigint,score:double>>"


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def luhn(digits: Column) -> Column:
    """The checksum of payment cards: every second digit from the right counts double."""

    def value(d: Column, i: Column) -> Column:
        n = d.cast("int") * (F.lit(1) + i % 2)
        return n - F.when(n > 9, 9).otherwise(0)

    return F.aggregate(F.transform(characters(F.reverse(digits)), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(compact: Column) -> Column:
    """The checksum of account numbers: the first four go last, letters count from 10, rest 1."""
    turned = F.concat(F.substring(compact, 5, 100), F.substring(compact, 1, 4))

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, a * 100 + (code - 55)).otherwise(a * 10 + (code - 48)) % 97

    return F.aggregate(characters(turned), F.lit(0), step) == 1


def ip_parts(match: Column) -> Column:
    def small(part: Column) -> Column:
        short = F.regexp_replace(part, "^0+(?=.)", "")
        return (F.length(short) <= 3) & (F.substring(short, 1, 3).cast("int") <= 255)

    return F.forall(F.split(match, "\\.", -1), small)


def between(digits: Column, low: int, high: int) -> Column:
    return F.length(digits).between(low, high)


@dataclass(frozen=True)
class Kind:
    """What is looked for. A match that the validator accepts has score base, and more by context."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    context: str
    base: float
    #: a match of the pattern has to hold this; texts without it are not searched
    needs: str


ADDRESS = "[A-Za-z0-9._%+-]"
BASE = (
    Kind("email", rf"(?:\G|(?<!{ADDRESS})){ADDRESS}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), "mail|contact|correo|courriel", 0.8, "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ip_parts, r"(?<![\p{L}\p{N}_])ip(?![\p{L}\p{N}_])|address|host|server", 0.7, r"[0-9]\.[0-9]"),
    Kind("card", r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+(?<=[0-9][\x20-]?[0-9])", lambda m: between(digits_of(m), 16, 19) & luhn(digits_of(m)), "card|visa|credit|karte|carte|tarjeta", 0.8, r"[0-9](?:[\x20-]?[0-9]){15}"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: between(digits_of(m), 8, 15), "phone|call|tel|mobile|fax", 0.8, r"\+[0-9]"),
)
#: What the checksums and the context find besides: kept at THRESHOLD or above.
MORE = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda m: F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & mod97(F.replace(m, F.lit(" "), F.lit(""))), "iban|account|konto|compte|cuenta", 0.6, "[A-Z]{2}[0-9]{2}"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), r"(?<![\p{L}\p{N}_])ssn(?![\p{L}\p{N}_])|social security", 0.4, "[0-9]-[0-9]{2}-[0-9]"),
)
#: Characters before a match, whatever stands there, and after it, up to the next match of its kind.
CONTEXT_CHARS, CONTEXT_BONUS, THRESHOLD = 48, 0.2, 0.55


def spans(text: Column, kind: Kind, threshold: float = 0.0) -> Column:
    """array<struct<start, end, score>>, leftmost first, of valid matches with enough score."""

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        before = F.substring(F.concat(state["tail"], x["gap"]), -CONTEXT_CHARS, CONTEXT_CHARS)
        near = F.lower(F.concat_ws("\n", before, F.substring(x["after"], 1, CONTEXT_CHARS))).rlike(kind.context)
        score = F.lit(kind.base) + F.when(near, CONTEXT_BONUS).otherwise(0.0)
        one = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), score.alias("score")))
        good = kind.valid(x["match"]) & (score >= threshold)
        tail = F.substring(F.concat(before, x["match"]), -CONTEXT_CHARS, CONTEXT_CHARS)
        return F.struct(end.cast("long").alias("at"), tail.alias("tail"), F.when(good, F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("gap"), matches.alias("match"), F.slice(gaps, 2, F.size(matches)).alias("after"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("tail"), F.array().cast(SPAN).alias("found"))
    found = F.aggregate(zipped, zero, step, lambda s: s["found"])
    return F.when(text.rlike(kind.needs), found).otherwise(F.array().cast(SPAN))


def find(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, one array of spans per kind (email, ip, card, phone, iban, ssn), then keep.

    Positions are code points, end exclusive. The first four kinds hold every match that their
    validator accepts; context only moves the score. An ssn needs context to be kept. Null and
    empty texts have no spans, repeated rows equal ones; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = [spans(text, k).alias(k.name) for k in BASE] + [spans(text, k, THRESHOLD).alias(k.name) for k in MORE]
    return docs.select("doc_id", *columns, *keep)


def listed(kinds: tuple[Kind, ...]) -> Column:
    """kind:start:end of all spans, comma-joined, by kind as listed, then start."""

    def line(kind: Kind) -> Column:
        return F.transform(F.col(kind.name), lambda s: F.concat_ws(":", F.lit(kind.name), s["start"], s["end"]))

    return F.array_join(F.concat(*[line(k) for k in kinds]), ",")


def scores(kinds: tuple[Kind, ...]) -> Column:
    """The spans' scores in the same order, two decimals each."""
    return F.array_join(F.concat(*[F.transform(F.col(k.name), lambda s: F.format_number(s["score"], 2)) for k in kinds]), ",")


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents"))
    counts = [F.size(k.name).cast("long").alias(f"n_{k.name}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(BASE), 256).alias("base_sha256"), listed(BASE + MORE).alias("spans"), scores(BASE + MORE).alias("scores"))
