"""Licence scan: TF-IDF cosine of text lines to licence templates, and inheritance along directories.

A term is a lower-case run of letters and digits.  Document frequencies of all
terms count all documents; a term of a template that no document has weighs as
one that a single document has.  Each line of a text (headers and licence files
alike) is compared with every template; the best line decides.  A file without
an own licence takes that of the licence file in the nearest directory above.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.llm.common import cut, fresh, prepared

#: So many of the most frequent terms are looked up when lines are ruled out; the result is the same for any number.
FREQUENT = 64

#: Licence identifiers and notices as commonly written.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def scored_lines(files: DataFrame, templates: DataFrame, path: str, text: str, least: float) -> DataFrame:
    """(path, licence, score): the best template of each path with a cosine of ``least`` or more, ties to the smaller name."""
    tf = templates.select("licence", F.explode(terms(F.col("notice"))).alias("term")).groupBy("licence", "term").agg(F.count("*").alias("tf"))
    n = files.count()
    held = files.select(F.explode(F.array_distinct(terms(F.coalesce(text, F.lit(""))))).alias("term"))
    df = cut(held.groupBy("term").agg(F.count("*").alias("df")), "document-frequencies")
    idf = F.log((n + 1) / F.coalesce("df", F.lit(1)))
    weight = tf.join(df, "term", "left").select("licence", "term", (F.col("tf") * idf).alias("w"), idf.alias("idf"))
    weight = cut(weight, "weights")  # one row per term of a template
    norms = weight.groupBy("licence").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    lines = files.select(F.col(path).alias("path"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "x"))
    lines = lines.select("path", "line", terms(F.col("x")).alias("ts"))
    lines = lines.filter(may_reach(F.col("ts"), weight, df, n, least))
    one = lines.select("path", "line", F.explode("ts").alias("term")).groupBy("path", "line", "term").agg(F.count("*").alias("tf"))
    one = one.join(df, "term").select("path", "line", "term", (F.col("tf") * idf).alias("u"))
    one = cut(one, "line-terms")
    size = one.groupBy("path", "line").agg(F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("size"))
    dot = one.join(weight.select("licence", F.col("term").alias("t"), "w"), F.col("term") == F.col("t"))
    dot = dot.groupBy("path", "line", "licence").agg(F.sum(F.col("u") * F.col("w")).alias("dot"))
    found = dot.join(size, ["path", "line"]).join(norms, "licence")
    found = found.withColumn("score", F.when((F.col("size") > 0) & (F.col("norm") > 0), F.round(F.col("dot") / (F.col("size") * F.col("norm")), 9)))
    best = found.filter(F.col("score") >= least).groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("b"))
    return best.select("path", F.col("b.licence").alias("licence"), (-F.col("b.minus")).alias("score"))


def may_reach(ts: Column, weight: DataFrame, df: DataFrame, n: int, least: float) -> Column:
    """Whether a line of terms ``ts`` may have a cosine of ``least``; false only where a bound rules it out.

    A cosine is at most the share of the line's length that template terms
    have.  That is at most the sum of their weights; the other terms
    are at least as long as those outside the most frequent ones, each of which
    weighs no less than the rarest of these.
    """
    known = {r["term"]: r["idf"] for r in weight.select("term", "idf").distinct().collect()}
    often = df.orderBy(F.desc("df"), "term").limit(FREQUENT).collect()
    if not known or not often:
        return F.lit(False)
    floor = math.log((n + 1) / often[-1]["df"])
    vocabulary = F.array(*map(F.lit, known))
    weights = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    common = F.array(*(F.lit(t) for t in {r["term"] for r in often} | set(known)))
    held = F.filter(ts, lambda t: F.array_contains(vocabulary, t))
    most = F.aggregate(held, F.lit(0.0), lambda total, t: total + F.element_at(weights, t))
    rest = F.size(F.array_except(ts, common)) * floor * floor
    # Scores are rounded to nine places, so the bound is a little wider.
    return (F.size(held) > 0) & (most * most * (1 / (least - 1e-8) ** 2 - 1) >= rest)


def directory(path: Column) -> Column:
    """What precedes the last slash; empty without one."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """The folder and all above it, nearest first; the last is the root (empty)."""
    parts = F.array_remove(F.split(folder, "/"), "")
    up = F.transform(F.sequence(F.size(parts), F.lit(0)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return up


def licences(
    files: DataFrame, path_col: str = "path", text_col: str = "text", licence_file: str = r"(?i)(^|/)(LICEN[CS]E|COPYING)[^/]*$",
    least: float = 0.8, templates: tuple = TEMPLATES,
) -> DataFrame:
    """``files`` without their text, with licence, score, origin (own, inherited or null) and origin_path, appended last.

    Of several licence files of a directory the one with the smallest path
    counts.  Files that are null, empty or like no template inherit; a null path
    has no licence and gives none.  Rows that repeat a path share what is found
    in any of them.  An empty table gives none.  New columns whose names
    ``files`` already has get an underscore.
    """
    spark: SparkSession = prepared(files.sparkSession)
    given = [c for c in files.columns if c != text_col]
    known = spark.createDataFrame([(i, t) for i, t in templates], "licence string, notice string")
    named = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).filter("path IS NOT NULL")
    own = cut(scored_lines(named, known, "path", "text", least), "own-licences")
    roots = own.filter(F.col("path").rlike(licence_file)).groupBy(
        F.array_join(F.array_remove(F.split(directory(F.col("path")), "/"), ""), "/").alias("folder")
    ).agg(F.min(F.struct("path", "licence", "score")).alias("from"))
    roots = cut(roots, "licence-folders")
    # Folders, not files, look upward; a folder has a row per level above it.
    folders = named.select(directory(F.col("path")).alias("own_folder")).distinct()
    up = folders.select("own_folder", F.posexplode(ancestors(F.col("own_folder"))).alias("level", "folder"))
    near = up.join(roots, "folder").groupBy("own_folder").agg(F.min(F.struct("level", "from")).alias("m"))
    near = cut(near.select(F.col("own_folder").alias("_folder"), F.col("m.from").alias("_from")), "nearest")
    own = own.select(F.col("path").alias("_path"), F.col("licence").alias("_licence"), F.col("score").alias("_score"))
    licence, score, origin, origin_path = fresh(files, "licence", "score", "origin", "origin_path")
    joined = files.select(*given, F.col(path_col).alias("_p")).withColumn("_d", directory(F.col("_p")))
    joined = joined.join(own, F.col("_p") == F.col("_path"), "left").join(near, F.col("_d") == F.col("_folder"), "left")
    mine, from_ = F.col("_licence").isNotNull(), F.col("_from")
    return joined.select(
        *given,
        F.coalesce("_licence", from_["licence"]).alias(licence),
        F.coalesce("_score", from_["score"]).alias(score),
        F.when(mine, "own").when(from_.isNotNull(), "inherited").alias(origin),
        F.when(mine, F.col("_p")).otherwise(from_["path"]).alias(origin_path),
    )
