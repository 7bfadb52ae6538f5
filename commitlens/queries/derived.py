"""Input tables derived from the star-schema tables, in Spark and in SQL.

A repository is a nation, a commit an order, a touched file a line item; see
FIXTURES.md.  Both forms use integer arithmetic and md5 only, so they agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.operators import funnel, history
from commitlens.operators.ranking import number_rows
from commitlens.session import configure

CLASSES = (
    "FileUtils", "FileUtilsCopy", "ByteBuffer", "StringCodec", "Kafka", "App",
    "Main", "OrderParser", "OrderParserState", "Issue5678", "HttpClientPool",
    "IT0001",
)
PACKAGES = ("org/acme/core/io", "org/acme/core/net", "org/acme/util", "acme")
GENERATIONS = ("", "Next", "NextGen")
SEQ_STEP = 2**40
LINE_STEP = 2**52


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), index.cast("int") + 1)


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: Two of three orders add files of their own; the rest work on files that many orders touch.
OWN_FILES = "l_orderkey % 3 <> 0"


def _paths(lines: DataFrame) -> DataFrame:
    """``lines`` with the path before (``now``) and after a rename (``next``)."""
    own, odd = F.expr(OWN_FILES), F.col("l_suppkey") % 2 == 1
    lines = lines.withColumns(
        {
            "part": F.when(own, F.col("l_orderkey") % 12).when(odd, 0).otherwise(F.col("l_partkey") % 12),
            "supp": F.when(own, F.expr("l_orderkey div 12 % 8")).when(odd, 7).otherwise(F.col("l_suppkey") % 8),
            "kind": F.when(own | odd, 0).otherwise(F.col("q") % 12),
        }
    )
    is_test = F.col("l_linenumber") % 2 == 1
    stem = F.concat(
        F.lit("mod"),
        F.col("supp") % 2,
        F.when(is_test, "/src/test/java/").otherwise("/src/main/java/"),
        _pick(PACKAGES, F.expr("supp div 2")),
        F.when(is_test & (F.col("kind") == 2), "/Test").otherwise("/"),
        _pick(CLASSES, F.col("part")),
        F.when(own, F.concat(F.lit("Of"), "l_orderkey")).otherwise(""),
    )
    # Even suppliers rename around a circle of three names; odd ones share a file and rename it along ten.
    around = F.col("supp") % 2 == 0

    def generation(t: Column) -> Column:
        along = F.when(t == 0, "").otherwise(F.concat(F.lit("V"), t))
        return F.when(own, F.when(t == F.col("t"), "").otherwise("V1")).otherwise(
            F.when(around, _pick(GENERATIONS, t % 3)).otherwise(along)
        )

    ending = (
        F.when(~is_test & (F.col("kind") == 7), ".xml")
        .when(~is_test, ".java")
        .when(F.col("kind") % 6 == 3, "Tests.java")
        .when(F.col("kind") % 6 == 4, "TestCase.java")
        .when(F.col("kind") % 6 == 5, "IT.java")
        .otherwise("Test.java")
    )
    return lines.withColumns(
        {
            "now": F.concat(stem, generation(F.col("t")), ending),
            "next": F.concat(stem, generation(F.col("t") + 1), ending),
        }
    )


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    # Orders meet their customers first, so that lines are shuffled once.  They grow with the lines and are never broadcast.
    orders = (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_orderdate")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .hint("merge")
    )
    d = F.expr("cast(round(l_discount * 100) as int)")
    t = F.expr("cast(round(l_tax * 100) as int)")
    q = F.expr("cast(l_quantity as int)")
    cents = F.expr("cast(round(l_extendedprice * 100) as bigint)")
    shipped = F.expr("datediff(l_shipdate, date '1970-01-01')")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        q.alias("q"), cents.alias("cents"), d.alias("d"), t.alias("t"), shipped.alias("shipped"),
    )
    rest = F.md5(F.concat_ws("|", "l_partkey", "l_suppkey", "q", "cents", "d", "t", "shipped"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    now, following = F.col("now"), F.col("next")
    return _paths(joined).select(
        F.concat(F.lit("repo_"), "c_nationkey").alias("repo"),
        F.expr(
            f"datediff(o_orderdate, date '1970-01-01') * {SEQ_STEP}L + o_orderkey"
        ).alias("commit_seq"),
        (
            F.col("l_linenumber").cast("bigint") * LINE_STEP
            + F.conv(F.substring(rest, 1, 13), 16, 10).cast("bigint")
        ).alias("change_seq"),
        F.md5(F.concat(F.lit("c"), "o_orderkey")).alias("commit_hash"),
        F.col("o_orderdate").alias("commit_date"),
        F.col("c_name").alias("author"),
        F.when(F.col("d") == 10, "DELETE")
        .when(F.col("d") == 9, "RENAME")
        .when(F.col("d") >= 5, "MODIFY")
        .otherwise("ADD")
        .alias("change_type"),
        F.when(F.col("d") >= 5, now).alias("old_path"),
        F.when(F.col("d") == 9, following)
        .when(F.col("d") != 10, now)
        .alias("new_path"),
        F.col("q").cast("bigint").alias("added_lines"),
    )


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names too general to match on besides the fixed ones: one per part, most of them never met."""
    name = F.when(F.col("p_partkey") % 12 == 8, "OrderParserState").otherwise(F.concat(F.lit("Part"), "p_partkey"))
    return table(spark, sf_dir, "part").select(name.alias("term"))


TERMS_SQL = """
terms AS (
  SELECT CASE WHEN p_partkey % 12 = 8 THEN 'OrderParserState' ELSE 'Part' || p_partkey END AS term FROM part
)"""


FILE_CHANGES_SQL = f"""
raw_lines AS (
  SELECT *, CASE WHEN own THEN l_orderkey % 12 WHEN l_suppkey % 2 = 1 THEN 0 ELSE l_partkey % 12 END AS part,
         CASE WHEN own THEN l_orderkey // 12 % 8 WHEN l_suppkey % 2 = 1 THEN 7 ELSE l_suppkey % 8 END AS supp,
         CASE WHEN own OR l_suppkey % 2 = 1 THEN 0 ELSE q % 12 END AS kind
  FROM (SELECT *, {OWN_FILES} AS own, CAST(round(l_discount * 100) AS INT) AS d,
               CAST(round(l_tax * 100) AS INT) AS t, CAST(l_quantity AS INT) AS q
        FROM lineitem)
), named_lines AS (
  SELECT 'repo_' || c_nationkey AS repo,
         date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * {SEQ_STEP}
           + o_orderkey AS commit_seq,
         CAST(l_linenumber AS BIGINT) * {LINE_STEP} + CAST('0x' || substr(md5(concat_ws('|',
           l_partkey, l_suppkey, q, CAST(round(l_extendedprice * 100) AS BIGINT), d, t,
           date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)))), 1, 13) AS BIGINT)
           AS change_seq,
         md5('c' || o_orderkey) AS commit_hash, o_orderdate AS commit_date, c_name AS author,
         CASE WHEN d = 10 THEN 'DELETE' WHEN d = 9 THEN 'RENAME' WHEN d >= 5 THEN 'MODIFY'
              ELSE 'ADD' END AS change_type,
         'mod' || (supp % 2)
           || CASE WHEN l_linenumber % 2 = 1 THEN '/src/test/java/' ELSE '/src/main/java/' END
           || {_sql_list(PACKAGES)}[CAST(supp // 2 AS INT) + 1]
           || CASE WHEN l_linenumber % 2 = 1 AND kind = 2 THEN '/Test' ELSE '/' END
           || {_sql_list(CLASSES)}[CAST(part AS INT) + 1]
           || CASE WHEN own THEN 'Of' || l_orderkey ELSE '' END AS stem,
         CASE WHEN own THEN '' WHEN supp % 2 = 0 THEN {_sql_list(GENERATIONS)}[t % 3 + 1]
              WHEN t = 0 THEN '' ELSE 'V' || t END AS now_gen,
         CASE WHEN own THEN 'V1' WHEN supp % 2 = 0 THEN {_sql_list(GENERATIONS)}[(t + 1) % 3 + 1]
              ELSE 'V' || (t + 1) END AS next_gen,
         CASE WHEN l_linenumber % 2 = 0 AND kind = 7 THEN '.xml'
              WHEN l_linenumber % 2 = 0 THEN '.java' WHEN kind % 6 = 3 THEN 'Tests.java'
              WHEN kind % 6 = 4 THEN 'TestCase.java' WHEN kind % 6 = 5 THEN 'IT.java'
              ELSE 'Test.java' END AS ending,
         CAST(q AS BIGINT) AS added_lines
  FROM raw_lines JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
), file_changes AS (
  SELECT repo, commit_seq, change_seq, commit_hash, commit_date, author, change_type,
         CASE WHEN change_type <> 'ADD' THEN stem || now_gen || ending END AS old_path,
         CASE WHEN change_type = 'RENAME' THEN stem || next_gen || ending
              WHEN change_type <> 'DELETE' THEN stem || now_gen || ending END AS new_path,
         added_lines
  FROM named_lines
)"""


def commit_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of a repository in order, with side branches and merges.

    Commit n follows n - 1, but one in 20 goes back 12 commits, which leaves
    those between to a side branch.  Some commits merge commit 2n div 3 as well.
    """
    changes = file_changes(spark, sf_dir)
    commits = changes.groupBy("repo", "commit_seq").agg(
        F.min("commit_date").alias("commit_date"),
        F.count("*").alias("files_changed"),
        F.sum("added_lines").alias("lines_changed"),
    )
    numbered = number_rows(commits, ["repo"], ["commit_seq"], "n")
    first = F.expr("if(n % 20 = 7 and n > 12, n - 12, n - 1)")
    third = F.expr(f"if((commit_seq % {SEQ_STEP}L) % 5 = 0, (2 * n) div 3, 0)")
    parents = F.filter(F.array_distinct(F.array(first, third)), lambda p: p > 0)
    return numbered.select(
        "repo",
        "n",
        F.expr(f"commit_seq % {SEQ_STEP}L").alias("orderkey"),
        _oid(F.col("n")).alias("oid"),
        F.transform(parents, _oid).alias("parents"),
        "commit_date",
        "files_changed",
        "lines_changed",
    )


def _oid(n: Column) -> Column:
    return F.md5(F.concat("repo", F.lit("/"), n.cast("string")))


COMMIT_GRAPH_SQL = f"""
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY commit_seq) AS n
  FROM (SELECT repo, commit_seq, min(commit_date) AS commit_date, count(*) AS files_changed,
               CAST(sum(added_lines) AS BIGINT) AS lines_changed
        FROM file_changes GROUP BY repo, commit_seq)
), commit_graph AS (
  SELECT repo, n, commit_seq % {SEQ_STEP} AS orderkey, md5(repo || '/' || n) AS oid,
         list_transform(list_filter(
           CASE WHEN up = merged OR orderkey % 5 <> 0 THEN [up] ELSE [up, merged] END, lambda p: p > 0),
           lambda p: md5(repo || '/' || p)) AS parents,
         commit_date, files_changed, lines_changed
  FROM (SELECT *, CASE WHEN n % 20 = 7 AND n > 12 THEN n - 12 ELSE n - 1 END AS up,
               (2 * n) // 3 AS merged FROM numbered)
)"""


def branches(graph: DataFrame) -> DataFrame:
    """``main`` at the newest commit, and a branch at every commit that no other follows or merges."""
    newest = graph.groupBy("repo").agg(F.max("n").alias("n"))
    merged = graph.select("repo", F.explode("parents").alias("oid")).distinct()
    heads = graph.join(merged, ["repo", "oid"], "left_anti").select("repo", "n", F.col("oid").alias("head"))
    name = F.when(F.col("_newest").isNotNull(), "main").otherwise(F.concat(F.lit("br_"), F.col("n").cast("string")))
    return heads.join(newest.withColumn("_newest", F.lit(True)), ["repo", "n"], "left").select(
        "repo", name.alias("branch"), "head"
    )


BRANCHES_SQL = """
branches AS (
  SELECT repo, CASE WHEN n = newest THEN 'main' ELSE 'br_' || n END AS branch, oid AS head
  FROM (SELECT *, max(n) OVER (PARTITION BY repo) AS newest FROM commit_graph) c
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT repo, unnest(parents) AS parent FROM commit_graph) p
                    WHERE p.repo = c.repo AND p.parent = c.oid)
)"""


def pull_request_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of at most 50 nested pull requests."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    node = F.struct(
        F.col("o_orderkey").alias("number"),
        F.when(
            F.col("o_orderstatus") != "O", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        ).alias("mergedAt"),
        F.md5(F.concat(F.lit("h"), "o_orderkey")).alias("headRefOid"),
        F.struct(F.md5(F.concat(F.lit("c"), "o_orderkey")).alias("oid")).alias("mergeCommit"),
        F.struct((F.col("o_orderkey") % 9).cast("int").alias("totalCount")).alias("commits"),
    )
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            F.concat(F.lit("repo_"), "c_nationkey").alias("repo"),
            F.expr("o_orderkey div 200").alias("page"),
        )
        .agg(F.collect_list(node).alias("nodes"))
        .select(
            "repo",
            "page",
            F.struct(F.struct(F.struct("nodes").alias("pullRequests")).alias("repository")).alias(
                "data"
            ),
        )
    )


def repo_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = (
        file_changes(spark, sf_dir)
        .where("change_type = 'ADD'")
        .select("repo", F.col("new_path").alias("path"))
        .distinct()
    )
    parts = F.split("path", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: F.array_join(F.slice(parts, 1, i), "/"),
    )
    dirs = added.select("repo", F.explode(above).alias("path")).distinct()
    k = F.col("n_nationkey")
    roots = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("repo_"), "n_nationkey").alias("repo"),
        F.explode(
            F.filter(
                F.array(
                    *[
                        F.when(cond, F.struct(F.lit(p).alias("path"), F.lit(t).alias("type")))
                        for cond, p, t in (
                            (k % 2 == 0, "pom.xml", "blob"),
                            (k % 4 == 1, "build.gradle", "blob"),
                            (k % 3 == 0, "Jenkinsfile", "blob"),
                            (k % 5 == 0, ".github", "dir"),
                        )
                    ]
                ),
                lambda e: e.isNotNull(),
            )
        ).alias("e"),
    )
    return (
        added.withColumn("type", F.lit("blob"))
        .unionByName(dirs.withColumn("type", F.lit("dir")))
        .unionByName(roots.select("repo", "e.path", "e.type"))
    )


REPO_TREE_SQL = """
added_paths AS (
  SELECT DISTINCT repo, new_path AS path FROM file_changes WHERE change_type = 'ADD'
), repo_tree AS (
  SELECT repo, path, 'blob' AS type FROM added_paths
  UNION ALL
  SELECT DISTINCT repo, array_to_string(string_split(path, '/')[1:i], '/'), 'dir'
  FROM (SELECT repo, path, unnest(range(1, len(string_split(path, '/')))) AS i FROM added_paths)
  UNION ALL
  SELECT 'repo_' || n_nationkey, p, t FROM nation,
    (VALUES ('pom.xml', 'blob', 2, 0), ('build.gradle', 'blob', 4, 1),
            ('Jenkinsfile', 'blob', 3, 0), ('.github', 'dir', 5, 0)) r(p, t, m, rest)
  WHERE n_nationkey % m = rest
)"""


def repo_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations' repositories and one without commits per customer."""
    nations = table(spark, sf_dir, "nation").selectExpr(
        "concat('repo_', n_nationkey) as name", "cast(n_nationkey as bigint) as k",
        "n_name as description",
    )
    customers = table(spark, sf_dir, "customer").selectExpr(
        "concat('customer_', c_custkey) as name", "c_custkey as k",
        "concat(c_mktsegment, ' of ', c_name) as description",
    )
    k = F.col("k")
    return nations.unionByName(customers).select(
        "name",
        F.when(k % 3 != 0, "Java").otherwise("Scala").alias("language"),
        "description",
        (k * 7 % 50).alias("stargazers_count"),
        (k * 3 % 20).alias("forks_count"),
        (k % 7 == 0).alias("fork"),
        (k % 11 == 0).alias("archived"),
        (k * 100).alias("size"),
        F.when(k % 8 != 0, F.struct(F.lit("Apache-2.0").alias("spdx_id"))).alias("license"),
    )


REPO_META_SQL = """
repo_meta AS (
  SELECT name, CASE WHEN k % 3 <> 0 THEN 'Java' ELSE 'Scala' END AS language, description,
         k * 7 % 50 AS stargazers_count, k * 3 % 20 AS forks_count, k % 7 = 0 AS fork,
         k % 11 = 0 AS archived, k * 100 AS size,
         CASE WHEN k % 8 <> 0 THEN 'Apache-2.0' END AS spdx_id
  FROM (SELECT 'repo_' || n_nationkey AS name, CAST(n_nationkey AS BIGINT) AS k,
               n_name AS description FROM nation
        UNION ALL
        SELECT 'customer_' || c_custkey, c_custkey, c_mktsegment || ' of ' || c_name
        FROM customer)
)"""


def repo_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = history.commit_stats(file_changes(spark, sf_dir))
    return funnel.repo_stats(repo_meta(spark, sf_dir), funnel.repo_commit_span(commits))


REPO_STATS_SQL = """
repo_stats AS (
  SELECT name AS repo, language AS main_language, stargazers_count AS stars,
         forks_count AS forks, CAST(coalesce(n, 0) AS DOUBLE) AS num_commits,
         first_commit_date, last_commit_date,
         CAST((epoch_us(last_commit_date) - epoch_us(first_commit_date)) // 86400000000
              AS DOUBLE) AS project_life_days
  FROM repo_meta LEFT JOIN (
    SELECT repo, count(DISTINCT commit_hash) AS n, min(commit_date) AS first_commit_date,
           max(commit_date) AS last_commit_date FROM file_changes GROUP BY repo) s
    ON s.repo = name
)"""
