"""Coercion, durations, categories and number formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from commitlens.functions import fixed
from commitlens.functions.paths import let

TRUE_WORDS = ("true", "1", "yes", "y", "t")


def to_bool(value: Column) -> Column:
    """Text or flag read as a flag; null is false."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def to_number(value: Column) -> Column:
    """Number, or null for what is not one."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def to_number_or_zero(value: Column) -> Column:
    return F.coalesce(to_number(value), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def hours_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6) / F.lit(3600)


def whole_days_between(start: Column, end: Column) -> Column:
    """Full 24-hour days, rounded down (also below zero)."""
    return F.floor(F.timestamp_diff("MICROSECOND", start, end) / F.lit(86_400_000_000))


def parse_utc(text: Column) -> Column:
    """ISO-8601 text with zone (or ``Z``) as an instant; bad text is null."""
    return F.try_to_timestamp(text)


def yes_no(flag: Column) -> Column:
    return F.when(flag.cast("boolean"), "Yes").when(~flag.cast("boolean"), "No")


def keyword_pattern(words) -> str:
    """Whole words or phrases, any case, Unicode letters."""
    return r"(?iU)\b(?:" + "|".join(re.escape(w) for w in words) + r")\b"


def keyword_hits(text: Column, keywords: dict[str, tuple[str, ...]], body) -> Column:
    """``body`` of a function that gives the keyword hits of a category.

    The text is cut into words once and looked up in all categories.  Only
    where it holds a phrase (or a keyword with signs in it) is the pattern of
    that category run, as a phrase takes its words along.
    """
    lowered = F.lower(text)
    plain = {
        c: [w.lower() for w in words if re.fullmatch(r"\w+", w)] for c, words in keywords.items()
    }
    every = sorted({w for words in plain.values() for w in words})
    words = F.split(lowered, r"[^\p{L}\p{N}_]+")

    def hits(found: Column, name: str) -> Column:
        count = F.size(F.filter(found, lambda w: w.isin(*plain[name])))
        phrases = [w.lower() for w in keywords[name] if w.lower() not in plain[name]]
        for phrase in phrases:
            pattern = F.lit(keyword_pattern(keywords[name]))
            count = F.when(lowered.contains(phrase), F.regexp_count(text, pattern)).otherwise(
                count
            )
        return count

    return let(
        F.filter(words, lambda w: w.isin(*every)),
        lambda found: body(lambda name: hits(found, name)),
    )


def category(text: Column, keywords=None, decisive: str = fixed.RETIRED) -> Column:
    """Category with most keyword hits; the first listed wins a tie.

    A hit in the ``decisive`` category settles it; no hit at all gives null.
    """
    keywords = keywords or fixed.CATEGORY_KEYWORDS
    scored = [name for name in keywords if name != decisive]

    def choose(hits) -> Column:
        # The larger the score the better, then the earlier the category.
        best = F.array_max(
            F.array(
                *[
                    F.struct(
                        hits(name).alias("hits"),
                        F.lit(-rank).alias("rank"),
                        F.lit(name).alias("name"),
                    )
                    for rank, name in enumerate(scored)
                ]
            )
        )
        winner = let(best, lambda b: F.when(b["hits"] > 0, b["name"]))
        if decisive in keywords:
            return F.when(hits(decisive) > 0, decisive).otherwise(winner)
        return winner

    return keyword_hits(text, keywords, choose)


def full_text(name: Column, description: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(description, F.lit("")))


def fixed_point(value: Column, places: int) -> Column:
    """A number of at least 0 as text, rounded half to even on its exact value.

    Spark's own rounding works on the shortest decimal form, which turns
    0.35 (a little below) into 0.4.  Splitting the fraction keeps every
    product below exact, so the comparison with one half is exact too.
    """
    scale = 10**places
    whole = F.floor(value)
    fraction = value - whole
    high = F.floor(fraction * F.lit(2.0**26)) / F.lit(2.0**26)
    low = fraction - high
    units = F.floor(high * F.lit(float(scale)))
    over_half = (high * F.lit(float(scale)) - units - F.lit(0.5)) + low * F.lit(float(scale))
    up = F.when(over_half > 0, 1).when((over_half == 0) & (units % 2 == 1), 1).otherwise(0)
    total = whole * scale + units + up
    return F.concat_ws(
        ".",
        F.floor(total / scale).cast("bigint").cast("string"),
        F.lpad((total % scale).cast("string"), places, "0"),
    )
