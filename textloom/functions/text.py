"""Column builders: rounding, case, character classes, word units, marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import EDGE_MARKS, SPACE_CLASS, SYMBOLS, TOKEN
from .arrays import let

NAN = float("nan")
ALNUM = r"[\p{L}\p{N}]"
SPACE = f"[{SPACE_CLASS}]"
CHUNK = f"([^{SPACE_CLASS}]+)"


def nan() -> Column:
    return F.lit(NAN)


def rounded(x: Column, digits: int) -> Column:
    """Half up on the scaled value, NaN kept; the sum with 0.0 turns -0.0 into 0.0. The value is worked out once.

    Half-way cases can differ by one in the last digit from a rounding of the exact binary value to even.
    """


    def scaled(v: Column) -> Column:
        up = F.floor(v * F.lit(10.0**digits) + F.lit(0.5)).cast("double") / F.lit(10.0**digits) + F.lit(0.0)
        return F.when(F.isnan(v) | v.isNull(), nan()).otherwise(up)

    return let(x.cast("double"), scaled)


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole, NaN where whole is 0 or null."""
    return rounded(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), digits)


def when_or_nan(test: Column, value: Column) -> Column:
    return F.when(test, value.cast("double")).otherwise(nan())


def lower(x: Column, lang: str) -> Column:
    return F.lower(F.translate(x, "Iİ", "ıi")) if lang == "tr" else F.lower(x)


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACE_CLASS}]")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), 1)


def _digits(x: Column) -> Column:
    return x.rlike("^[\\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]+$")


def units(text: Column, lang: str) -> Column:
    """array<string>: white-space chunks without edge marks, empty ones dropped; symbols of the table stay as units.

    In Turkish, a number keeps its dot where it is an ordinal: before a comma, or before another word.
    """
    strip = lambda c: F.btrim(c, F.lit(EDGE_MARKS))

    def ordinal(pair: Column) -> Column:
        c = pair["c"]
        u = strip(c)
        after = F.substring(c, F.instr(c, u) + F.length(u), F.length(c))
        follows = F.coalesce(pair["next"], F.lit("")).rlike(ALNUM)
        dot = after.startswith(".") & ((F.substring(after, 2, 1) == ",") | ((after == ".") & follows))
        return F.when(_digits(u) & dot, F.concat(u, F.lit("."))).otherwise(u)

    cs = chunks(text)
    # a lambda that reads another one's variable can't stand in a UDF's argument: so chunks come with their neighbours
    us = F.transform(F.arrays_zip(cs.alias("c"), F.slice(cs, 2, 1 << 30).alias("next")), ordinal) if lang == "tr" else F.transform(cs, strip)
    return F.filter(us, lambda u: u.rlike(ALNUM) | u.rlike(f"^[{SYMBOLS}]+$"))


def words(text: Column, lang: str) -> Column:
    """array<string>: the units that hold a letter or number."""
    return F.filter(units(text, lang), lambda u: u.rlike(ALNUM))


def symbols(text: Column, lang: str) -> Column:
    return F.filter(units(text, lang), lambda u: ~u.rlike(ALNUM))


def tokens(text: Column) -> Column:
    """array<string>: rule tokens, for texts without tokens of a model."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1)


def letters(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"\P{L}", ""))
