"""Queries that apply one rule to every row: paths, names, text, values."""

from __future__ import annotations

from pyspark.sql import functions as F

from commitlens.functions import fixed, names, paths, values
from commitlens.operators import funnel
from commitlens.queries import derived, oracle
from commitlens.queries.oracle import sql
from commitlens.queries.registry import query

# Paths as they are and, by length, moved into directories the rules know.
VARIED_SQL = """
varied AS (
  SELECT DISTINCT CASE length(path) % 6
      WHEN 0 THEN replace(path, 'src/main/java/', 'target/classes/')
      WHEN 1 THEN replace(path, 'org/acme', 'src/its/acme')
      WHEN 2 THEN replace(path, 'src/test/java', 'src/test/resources')
      WHEN 3 THEN replace(path, 'src/test/java/', 'latest/')
      WHEN 4 THEN replace(path, 'src/main/java/', 'Build/scala/')
      ELSE path END AS path
  FROM (SELECT new_path AS path FROM file_changes WHERE new_path IS NOT NULL)
)"""


def varied(t):
    path = F.col("new_path")
    rest = F.length(path) % 6

    def moved(old, new):
        return F.replace(path, F.lit(old), F.lit(new))

    return (
        t.changes.where(path.isNotNull())
        .select(
            F.when(rest == 0, moved("src/main/java/", "target/classes/"))
            .when(rest == 1, moved("org/acme", "src/its/acme"))
            .when(rest == 2, moved("src/test/java", "src/test/resources"))
            .when(rest == 3, moved("src/test/java/", "latest/"))
            .when(rest == 4, moved("src/main/java/", "Build/scala/"))
            .otherwise(path)
            .alias("path")
        )
        .distinct()
    )


def on_varied(select: str, more: str = "") -> str:
    blocks = VARIED_SQL.strip() + (", " + more.strip() if more else "")
    return sql(select, "file_changes").replace(f"\n{select}", f", {blocks}\n{select}")


@query(
    "java_file_predicate",
    sql(f"""SELECT {oracle.is_java("coalesce(new_path, old_path)")} AS is_java,
      count(*) AS changes FROM file_changes GROUP BY ALL""", "file_changes"),
)
def java_file_predicate(t):
    java = paths.is_java_file(F.coalesce("new_path", "old_path"))
    return t.changes.groupBy(java.alias("is_java")).agg(F.count("*").alias("changes"))


@query(
    "exclude_path_predicate",
    on_varied(f"SELECT path, {oracle.is_excluded('path')} AS excluded FROM varied"),
)
def exclude_path_predicate(t):
    return varied(t).select("path", paths.is_excluded(F.col("path")).alias("excluded"))


@query("is_test_file", on_varied(f"SELECT path, {oracle.is_test('path')} AS is_test FROM varied"))
def is_test_file(t):
    return varied(t).select("path", paths.is_test_file(F.col("path")).alias("is_test"))


@query(
    "is_test_helper",
    on_varied(f"SELECT path, {oracle.is_helper('path')} AS is_helper FROM varied"),
)
def is_test_helper(t):
    return varied(t).select("path", paths.is_test_helper(F.col("path")).alias("is_helper"))


@query(
    "path_parts",
    on_varied("""SELECT path, string_split(path, '/')[-1] AS basename,
      array_to_string(string_split(path, '/')[:-2], '/') AS dirname FROM varied"""),
)
def path_parts(t):
    path = F.col("path")
    return varied(t).select(
        path, paths.basename(path).alias("basename"), paths.dirname(path).alias("dirname")
    )


@query(
    "extract_class_name",
    on_varied("""SELECT path, replace(string_split(path, '/')[-1], '.java', '') AS class_name
      FROM varied"""),
)
def extract_class_name(t):
    return varied(t).select("path", paths.class_name(F.col("path")).alias("class_name"))


@query(
    "extract_package_path",
    on_varied("SELECT path, package FROM packages_of",
              oracle.package_blocks("varied", "packages_of")),
)
def extract_package_path(t):
    return varied(t).select("path", paths.package_path(F.col("path")).alias("package"))


# Titles of words from parts and file classes, as further test class names.
CLASS_SQL = f"""
classes AS (
  SELECT DISTINCT {oracle.class_name('path')} AS class_name FROM varied
)"""


@query(
    "extract_base_class_name",
    on_varied("SELECT * FROM candidates_of",
              CLASS_SQL + "," + derived.TERMS_SQL + "," + oracle.GENERIC_SQL + ", "
              + oracle.candidate_blocks("classes", "candidates_of")),
)
def extract_base_class_name(t):
    classes = varied(t).select(paths.class_name(F.col("path")).alias("class_name")).distinct()
    offered = classes.withColumn("candidates", names.candidate_offers(F.col("class_name")))
    return names.without_terms(offered, ["class_name"], "candidates", t.terms)


def category_sql(text: str, keywords=None, decisive: str = fixed.RETIRED) -> str:
    """Keyword hits with letters of any script counting as parts of words.

    The text is padded and its separators doubled, so that two neighbouring
    words do not have to share one.
    """
    keywords = keywords or fixed.CATEGORY_KEYWORDS
    wide = f"regexp_replace(' ' || {text} || ' ', '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g')"
    apart = "[^\\p{L}\\p{N}_]"

    def hits(words):
        alternatives = "|".join(w.replace(" ", "  ") for w in words)
        return f"len(regexp_extract_all({wide}, '(?i){apart}(?:{alternatives}){apart}'))"

    scored = {k: w for k, w in keywords.items() if k != decisive}
    entries = ", ".join(
        f"{{'hits': {hits(w)}, 'rank': {-i}, 'name': '{k}'}}"
        for i, (k, w) in enumerate(scored.items())
    )
    retired = f"{hits(keywords[decisive])} > 0" if decisive in keywords else "false"
    return f"""CASE WHEN {retired} THEN '{decisive}'
      WHEN list_max([{entries}]).hits > 0 THEN list_max([{entries}]).name END"""


@query(
    "categorize_repo",
    f"""SELECT doc_id, {category_sql("(source || ' ' || text)")} AS category FROM documents""",
)
def categorize_repo(t):
    text = values.full_text(F.col("source"), F.col("text"))
    return t.given("documents").select("doc_id", values.category(text).alias("category"))


TRADES = ("building", "machinery", "nation_5")

# Words of the invented prose, so that every rule decides somewhere.
PROSE_WORDS = {
    "First": ("the", "que", "und"),
    "Second": ("an", "le", "la"),
    "Same as second": ("an", "le", "la"),
    "Decisive": ("thon", "whou"),
}


@query(
    "categorize_prose",
    f"""SELECT doc_id, {category_sql("(source || ' ' || text)", PROSE_WORDS, "Decisive")}
        AS category FROM documents""",
)
def categorize_prose(t):
    text = values.full_text(F.col("source"), F.col("text"))
    return t.given("documents").select(
        "doc_id", values.category(text, PROSE_WORDS, "Decisive").alias("category")
    )


@query(
    "categorize_repos",
    sql(f"""SELECT name AS project,
      {category_sql("(name || ' ' || description)", {**fixed.CATEGORY_KEYWORDS,
                                                     "Trades": TRADES})}
        AS category, substr(description, 1, 50) AS description_snippet
      FROM repo_meta WHERE language = 'Java'""", "repo_meta"),
)
def categorize_repos(t):
    keywords = {**fixed.CATEGORY_KEYWORDS, "Trades": TRADES}
    return funnel.categorize(derived.repo_meta(t.spark, t.sf_dir), keywords)


@query(
    "category_lookup",
    f"""WITH last AS (
         SELECT source, arg_max(text, doc_id) AS text FROM documents GROUP BY source)
       SELECT doc_id, d.source AS repo, {category_sql("(d.source || ' ' || l.text)",
                                                       PROSE_WORDS)} AS category
       FROM documents d LEFT JOIN last l USING (source)""",
)
def category_lookup(t):
    documents = t.given("documents")
    meta = documents.selectExpr("source as name", "text as description", "doc_id as position")
    projects = documents.selectExpr("doc_id", "source as repo")
    return funnel.category_lookup(projects, meta, "position", PROSE_WORDS)


@query("project_snippet", "SELECT doc_id, substr(text, 1, 50) AS snippet FROM documents")
def project_snippet(t):
    return t.given("documents").select(
        "doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 50).alias("snippet")
    )


@query(
    "to_bool",
    """SELECT l_returnflag, count(*) AS lines, count(*) FILTER (l_returnflag IN ('Y', 'T', 'A'))
         AS flagged FROM lineitem GROUP BY l_returnflag""",
)
def to_bool(t):
    text = F.when(F.col("l_returnflag").isin("Y", "T", "A"), " Yes ").when(
        F.col("l_returnflag") == "N", "no"
    )
    return (
        t.given("lineitem")
        .groupBy("l_returnflag")
        .agg(F.count("*").alias("lines"), F.count_if(values.to_bool(text)).alias("flagged"))
    )


@query(
    "to_number",
    """SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS level,
         coalesce(TRY_CAST(substr(o_orderpriority, 3) AS DOUBLE), 0) AS name FROM orders""",
)
def to_number(t):
    priority = F.col("o_orderpriority")
    return t.given("orders").select(
        "o_orderkey",
        values.to_number(F.substring(priority, 1, 1)).alias("level"),
        values.to_number_or_zero(F.substr(priority, F.lit(3))).alias("name"),
    )


@query(
    "time_differences",
    """SELECT event_id, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1e6::DOUBLE / 3600
         AS hours, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) // 86400000000 AS days,
         strftime(ts, '%Y-%m-%d') AS day FROM events""",
)
def time_differences(t):
    end = F.to_timestamp_ntz(F.lit("2024-02-01"))
    return t.given("events").select(
        "event_id",
        values.hours_between(F.col("ts"), end).alias("hours"),
        values.whole_days_between(F.col("ts"), end).alias("days"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )


@query(
    "nested_fields",
    """SELECT event_type, count(*) AS events, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT)
         AS k FROM events GROUP BY event_type""",
)
def nested_fields(t):
    props = F.from_json("props", "k bigint")
    return (
        t.given("events")
        .withColumn("p", props)
        .groupBy("event_type")
        .agg(F.count("*").alias("events"), F.sum("p.k").alias("k"))
    )


@query(
    "fixed_point",
    """SELECT o_orderkey, format('{:.2f}', o_totalprice / 24) AS two,
         format('{:.1f}', o_totalprice / 8) AS one FROM orders""",
)
def fixed_point(t):
    price = F.col("o_totalprice")
    return t.given("orders").select(
        "o_orderkey",
        values.fixed_point(price / 24, 2).alias("two"),
        values.fixed_point(price / 8, 1).alias("one"),
    )
