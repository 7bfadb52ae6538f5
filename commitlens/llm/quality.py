"""Quality rules whose thresholds follow the data.

Every document is measured once.  The measures of each language and source go
into a quantile sketch: counts by log-linear bin (whole numbers below 64 are
exact, above that a bin is 1/32 of its power of two wide).  Sketches merge by
adding counts, so a small group can borrow the sketch of its language, or of
all documents.  Fences come from the quartiles of the sketch and are joined
back to filter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitlens.llm.common import cut, fresh, prepared, words

#: A sketch keeps 6 leading bits of a value.
LEADING = 6


@dataclass(frozen=True)
class Rules:
    """Parameters of the rules; the fences are measured in whole numbers.

    A measure fails above Q3 + max(spread * (Q3 - Q1), slack) or below Q1 less
    the same.  Groups of under ``least_docs`` documents that passed the base
    rules use the sketch of their language, and this, if small too, that of all.
    """

    least_words: int = 50
    most_repeated: int = 50  # percent of the words
    window: int = 3
    spread: int = 3
    least_docs: int = 200
    slack: tuple[tuple[str, int], ...] = (
        ("symbols", 100),  # symbols per 1,000 words
        ("dup_lines", 300),  # repeated lines per 1,000 lines
        ("repeats", 300),  # words in repeated windows per 1,000 words
        ("word_len", 2000),  # characters per 1,000 words
    )
    two_sided: tuple[str, ...] = ("word_len",)


def repeated_words(tokens: Column, size: int = 3) -> Column:
    """Number of words inside a window of ``size`` words that the text has twice or more.

    Windows are sorted by their 64-bit hash with their place, so equal ones are
    neighbours; the places of those found again are sorted and each covers
    ``size`` words, less what the next one covers too.
    """
    n = F.size(tokens)
    places = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(
        places, lambda i: F.struct(F.xxhash64(*(F.get(tokens, i + k) for k in range(size))).alias("h"), i.alias("i"))
    )

    def again(s: Column) -> Column:
        same = lambda x, j: F.get(s, j)["h"].eqNullSafe(x["h"])
        found = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return F.array_sort(F.transform(found, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - x, F.lit(size)))),
            F.lit(0).cast("long"),
            lambda total, x: total + x,
        )

    return _let(F.sort_array(hashed), lambda s: _let(again(s), covered))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def measured(docs: DataFrame, text_col: str, rules: Rules) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the base counts, the failure of the base rules and the measures of the fences.

    The second value gives the name that each new column got.
    """
    wanted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    measures = [name for name, _ in rules.slack]
    names = dict(zip([*wanted, "lines", *measures], fresh(docs, *wanted, "_lines", *(f"_{m}" for m in measures)), strict=True))
    tokens, lines, counts = fresh(docs, "_tokens", "_all_lines", "_counts")
    text = F.coalesce(F.col(text_col), F.lit(""))
    full = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns({tokens: words(F.col(text_col)), lines: full})
    df = df.select(
        *docs.columns,
        F.struct(
            F.size(tokens).cast("long").alias("n_words"),
            F.length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col(tokens), rules.window).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("lines"),
        ).alias(counts),
    )
    part = lambda name: F.col(counts)[name]
    n, whole = part("n_words"), lambda x: x.cast("long")
    rate = lambda a, b: whole(F.when(b > 0, F.floor(a * 1000 / b)).otherwise(0))
    by = {
        "symbols": rate(part("n_symbols"), n),
        "dup_lines": rate(part("n_dup_lines"), part("lines")),
        "repeats": rate(part("n_repeat_words"), n),
        "word_len": rate(part("word_chars"), n),
    }
    failed = (n < rules.least_words) | (100 * part("n_repeat_words") > rules.most_repeated * n)
    df = df.select(
        *docs.columns,
        *(part(w).alias(names[w]) for w in wanted[:-1]),
        failed.alias(names["base_failed"]),
        *(by[m].alias(names[m]) for m in measures),
    )
    return df, names


def bin_of(value: Column) -> Column:
    """Lower edge of the log-linear bin of a whole number from 0 up; it names the bin."""
    drop = F.greatest(F.length(F.bin(value)) - LEADING, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(df: DataFrame, keys: list[str], measures: dict[str, str]) -> DataFrame:
    """(keys, measure, bin, n): quantile sketches of ``measures`` by ``keys``.

    They merge by summing n over what is left of the keys.
    """
    each = F.explode(
        F.array(*(F.struct(F.lit(m).alias("measure"), bin_of(F.col(c)).alias("bin")) for m, c in measures.items()))
    )
    return (
        df.select(*keys, each.alias("_e"))
        .groupBy(*keys, F.col("_e.measure").alias("measure"), F.col("_e.bin").alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, docs, q1, q3): bins that hold the values at a quarter and three quarters.

    Windows run over the bins of one sketch (at most some 2,000), not over documents.
    """
    w = Window.partitionBy(*keys, "measure")
    run = sketch.withColumns(
        {"upto": F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "docs": F.sum("n").over(w)}
    )
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("docs") * q, F.col("bin")))
    return run.groupBy(*keys, "measure").agg(F.max("docs").alias("docs"), at(1).alias("q1"), at(3).alias("q3"))


def fences(df: DataFrame, lang: str, source: str, measures: dict[str, str], rules: Rules) -> DataFrame:
    """(lang, source, measure bounds): one row for each language and source of ``df``."""
    keys = ["_lang", "_source"]
    own = cut(sketches(df.select(F.col(lang).alias("_lang"), F.col(source).alias("_source"), *measures.values()), keys, measures), "sketch")
    merged = own.groupBy("_lang", "measure", "bin").agg(F.sum("n").alias("n"))
    overall = own.groupBy("measure", "bin").agg(F.sum("n").alias("n"))
    level = lambda q, name: q.select(*(c for c in q.columns if c[0] == "_"), "measure", F.struct("docs", "q1", "q3").alias(name))
    a, b, c = (
        level(quartiles(sketch, k), name)
        for sketch, k, name in ((own, keys, "own"), (merged, ["_lang"], "lang"), (overall, [], "all"))
    )
    b = b.withColumnRenamed("_lang", "_lang_b").withColumnRenamed("measure", "measure_b")
    both = a.join(b, (a["measure"] == b["measure_b"]) & a["_lang"].eqNullSafe(b["_lang_b"])).join(c, "measure")
    enough = lambda x: F.col(x)["docs"] >= rules.least_docs
    used = F.when(enough("own"), F.col("own")).when(enough("lang"), F.col("lang")).otherwise(F.col("all"))
    slack = F.lit(0)
    for name, least in rules.slack:
        slack = F.when(F.col("measure") == name, F.lit(least)).otherwise(slack)
    both = both.select("_lang", "_source", "measure", used.alias("q"), slack.alias("slack"))
    reach = F.greatest(rules.spread * (F.col("q.q3") - F.col("q.q1")), F.col("slack"))
    bounds = both.select(
        "_lang", "_source", "measure", (F.col("q.q1") - reach).alias("low"), (F.col("q.q3") + reach).alias("high")
    )
    pick = lambda m, side: F.max(F.when(F.col("measure") == m, F.col(side)))
    return bounds.groupBy("_lang", "_source").agg(
        *(pick(m, "high").alias(f"_high_{m}") for m in measures),
        *(pick(m, "low").alias(f"_low_{m}") for m in measures if m in rules.two_sided),
    )


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    rules: Rules | None = None,
) -> DataFrame:
    """``docs`` without its text, with the base counts, base_failed and kept, appended last.

    Sketches hold the documents that pass the base rules.  Null, empty and blank
    texts have no words and fail; a null language or source is a group of its
    own; equal rows are judged alike; an empty table gives none.  A document of
    a group where all fail the base rules is not kept.  New columns whose names
    ``docs`` already has get an underscore.
    """
    rules = rules or Rules()
    prepared(docs.sparkSession)
    df, names = measured(docs, text_col, rules)
    df = cut(df.drop(text_col), "measures")
    return judged(df, names, lang_col, source_col, rules, [c for c in docs.columns if c != text_col])


def judged(df: DataFrame, names: dict[str, str], lang: str, source: str, rules: Rules, given: list[str]) -> DataFrame:
    measures = {m: names[m] for m, _ in rules.slack}
    passed = df.filter(~F.col(names["base_failed"]))
    # Written, so that its true size is known: a row per language and source.
    bounds = cut(fences(passed, lang, source, measures, rules), "bounds")
    joined = df.join(
        bounds, df[lang].eqNullSafe(bounds["_lang"]) & df[source].eqNullSafe(bounds["_source"]), "left"
    )
    within = ~F.col(names["base_failed"])
    for m, column in measures.items():
        within &= F.col(column) <= F.col(f"_high_{m}")
        if m in rules.two_sided:
            within &= F.col(column) >= F.col(f"_low_{m}")
    kept = fresh(df, "kept")[0]
    counts = [names[w] for w in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    return joined.select(*given, *counts, F.coalesce(within, F.lit(False)).alias(kept))


def well_made(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", rules: Rules | None = None) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with their texts.

    Texts do not move: the measures are joined to bounds of a row per language
    and source, and each row is judged where it lies.
    """
    rules = rules or Rules()
    prepared(docs.sparkSession)
    df, names = measured(docs, text_col, rules)
    df = cut(df, "measures")
    found = judged(df, names, lang_col, source_col, rules, docs.columns)
    return found.filter(F.col(found.columns[-1])).select(*docs.columns)
