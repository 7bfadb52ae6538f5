"""SQL blocks the expected results are put together from.

``sql("SELECT ... FROM pairs", "pairs")`` gives a statement with that block
and all it needs in front.
"""

from __future__ import annotations

from commitlens.functions import fixed
from commitlens.queries import derived

# Words too general to match on and project names, written anew here so that
# a slip in the package's own list shows.  The second spelling of a project name is by rule.
WORDS = """Abstract Base Default Simple Basic Generic Standard Common Core Main Internal Impl
Test Tests Mock Stub Fake Dummy Spy
Util Utils Utility Utilities Helper Helpers Tool Tools Support Handler Manager Service Factory
Builder Provider Processor Listener
App Application Main Client Server Config Context Session Request Response Result Data Info Item
Node Entry Record Event Task Job Action Command Message Error Type Kind Mode State Status Phase Stage
ODF Apache Spring Google Amazon Spark Airflow"""
PROJECTS = """Abdera Accumulo Ace ActiveMQ Airavata Ambari Amoro Ant Apex Archiva Aries Asterixdb
Atlas Aurora Avro Axis Beam Bifromq Bookkeeper Brooklyn Bval Calcite Camel Cassandra Causeway Cayenne
Celeborn Chainsaw Chemistry Chukwa Clerezza Cloudberry CloudStack Cocoon Commons Continuum Creadur
Crunch Curator CXF DataFu DataSketches Ddlutils DeltaSpike Derby Directmemory Directory
DolphinScheduler Doris Drill Druid Dubbo Eagle Empire Etch EventMesh Falcon Felix Fineract Flink Fory
FreeMarker FtpServer Geode Geronimo Giraph Gobblin Gora Gravitino Groovy Guacamole Hadoop Hama
Harmony HBase Helix Hertzbeat Hive Hop HttpComponents Hudi Iceberg Ignite InLong IoTDB Jackrabbit
James JClouds Jena JMeter Johnzon Joshua JSPWiki jUDDI Kafka Karaf Knox Kylin Lens Lenya Linkis
Logging Lucene ManifoldCF Marmotta Maven MetaModel Metron MINA Mnemonic MyFaces NetBeans NiFi Nutch
ODE Odftoolkit OFBiz Olingo Oltu Onami OODT Oozie OpenJPA OpenMeetings OpenNLP OpenWebBeans ORC Ozone
Paimon Parquet PDFBox Pekko Phoenix Pig Pinot Pivot PLC4X POI Polaris Polygene Portals Pulsar Qpid
Rampart Ranger Ratis Rave Reef RocketMQ Roller Royale Samza Sandesha Santuario SeaTunnel Sedona
Sentry ServiceComb ServiceMix ShardingSphere ShenYu Shindig Shiro SkyWalking Sling Solr Sqoop Stanbol
Storm StormCrawler Stratos StreamPark StreamPipes Streams Struts Submarine Synapse Syncope SystemDS
Tajo Tapestry Tez Tika Tiles TinkerPop Tomcat TomEE TsFile Turbine Tuscany UIMA Uniffle Unomi
Usergrid Velocity VXQuery Whirr Wicket Wink Wookie Xalan Xerces XMLBeans XMLGraphics Zeppelin
ZooKeeper"""


def _split(words: str) -> str:
    return f"unnest(string_split('{' '.join(words.split())}', ' '))"


GENERIC_SQL = f"""
generic AS (
  SELECT {_split(WORDS)} AS word
  UNION SELECT {_split(PROJECTS)}
  UNION SELECT upper(n[1]) || lower(n[2:]) FROM (SELECT {_split(PROJECTS)} AS n)
  UNION SELECT term FROM terms
)"""


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def any_of(patterns) -> str:
    return "'^(?:" + "|".join(patterns) + ")'"


def base(path: str) -> str:
    return f"regexp_replace({path}, '^.*/', '')"


def contains_any(text: str, pieces) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in pieces) + ")"


def is_java(path: str) -> str:
    return f"ends_with({path}, '.java')"


def is_excluded(path: str) -> str:
    return f"regexp_matches({path}, '(?i)' || {any_of(fixed.EXCLUDED_PATHS)})"


def is_test(path: str) -> str:
    return f"""CASE WHEN {contains_any(f'lower({path})', fixed.NOT_UNIT_TEST_DIRS)} THEN false
      WHEN regexp_matches({base(path)}, {any_of(fixed.INTEGRATION_NAMES)}) THEN false
      WHEN regexp_matches({base(path)}, {any_of(fixed.UNIT_TEST_NAMES)}) THEN true
      ELSE {contains_any(f'lower({path})', fixed.UNIT_TEST_DIRS)} END"""


def is_helper(path: str) -> str:
    return f"regexp_matches({base(path)}, {any_of(fixed.HELPER_NAMES)})"


def class_name(path: str) -> str:
    return f"replace({base(path)}, '.java', '')"


def dirname(path: str) -> str:
    return f"regexp_replace({path}, '/?[^/]*$', '')"


def to_main(path: str) -> str:
    cases = " ".join(
        f"WHEN contains({path}, '{t}') THEN replace({path}, '{t}', '{m}')"
        for t, m in fixed.TEST_TO_MAIN
    )
    return f"CASE {cases} ELSE {path} END"


def first_root(path: str) -> str:
    cases = " ".join(f"WHEN contains({path}, '{r}') THEN '{r}'" for r in fixed.SOURCE_ROOTS)
    return f"CASE {cases} ELSE '' END"


def package_blocks(source: str, name: str) -> str:
    """Blocks that give ``name(path, package)`` for the paths of ``source``."""
    return f"""
{name}_0 AS (
  SELECT DISTINCT path, {to_main("replace(path, chr(92), '/')")} AS p FROM {source}
), {name}_1 AS (
  SELECT path, p, {first_root('p')} AS root FROM {name}_0
), {name}_2 AS (
  SELECT path,
    CASE WHEN root = '' THEN ''
         ELSE rtrim(substr(p, 1, strpos(p, root) - 1), '/') END AS module,
    CASE WHEN root = '' THEN {dirname('p')}
         ELSE {dirname("substr(p, strpos(p, root) + length(root))")} END AS pkg
  FROM {name}_1
), {name} AS (
  SELECT path, module || CASE WHEN module <> '' AND pkg <> '' THEN '/' ELSE '' END || pkg
    AS package FROM {name}_2
)"""


def candidate_blocks(source: str, name: str) -> str:
    """Blocks that give ``name(class_name, candidates)`` for classes of ``source``."""
    suffix = "(?:" + "|".join(fixed.TEST_SUFFIXES) + ")$"
    ids = "|".join(fixed.TEST_ID_NAMES)
    return f"""
{name}_0 AS (
  SELECT DISTINCT class_name, regexp_replace(class_name, '{suffix}', '') AS base,
    CASE WHEN regexp_matches(class_name, '^Test\\p{{Lu}}')
         THEN regexp_replace(substr(class_name, 5), '{suffix}', '') ELSE '' END AS extra,
    regexp_matches(class_name, '{ids}') OR regexp_matches(
      replace(replace(class_name, 'Test', ''), 'Case', ''), '{fixed.NUMBERED_TAIL}') AS is_id
  FROM {source}
), {name}_1 AS (
  SELECT class_name, 0 AS place, base AS c FROM {name}_0 WHERE NOT is_id AND length(base) >= 3
  UNION ALL
  SELECT class_name, 1, extra FROM {name}_0
  WHERE NOT is_id AND length(extra) >= 4 AND (base = '' OR length(base) >= 4)
  UNION ALL
  SELECT class_name, 1000 - i, substr(base, 1, i - 1)
  FROM (SELECT *, unnest(range(5, length(base) + 1)) AS i FROM {name}_0 WHERE NOT is_id)
  WHERE regexp_matches(substr(base, i, 1), '\\p{{Lu}}')
), {name}_2 AS (
  SELECT class_name, c, min(place) AS place FROM {name}_1 JOIN {name}_0 USING (class_name)
  WHERE length(base) < 4 OR (c NOT IN (SELECT word FROM generic)
    AND NOT regexp_matches(c, '{fixed.NUMBERED_NAME}'))
  GROUP BY class_name, c
), {name} AS (
  SELECT class_name, coalesce(cs, []) AS candidates FROM (SELECT class_name FROM {name}_0)
  LEFT JOIN (SELECT class_name, list(c ORDER BY place) AS cs FROM {name}_2 GROUP BY class_name)
  USING (class_name)
)"""


BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {
    "terms": ((), derived.TERMS_SQL),
    "generic": (("terms",), GENERIC_SQL),
    "file_changes": ((), derived.FILE_CHANGES_SQL),
    "commit_graph": (("file_changes",), derived.COMMIT_GRAPH_SQL),
    "branches": (("commit_graph",), derived.BRANCHES_SQL),
    "repo_tree": (("file_changes",), derived.REPO_TREE_SQL),
    "repo_meta": ((), derived.REPO_META_SQL),
    "repo_stats": (("file_changes", "repo_meta"), derived.REPO_STATS_SQL),
    "commit_stats": (
        ("file_changes",),
        f"""
commit_stats AS (
  SELECT repo, commit_hash, min(commit_date) AS commit_date, min(author) AS author,
         CAST(sum(added_lines) AS BIGINT) AS total_lines, count(*) AS files_count,
         count(*) FILTER ({is_java("coalesce(new_path, '')")} OR
                          {is_java("coalesce(old_path, '')")}) AS java_files_count
  FROM file_changes GROUP BY repo, commit_hash
)""",
    ),
    "file_events": (
        ("file_changes",),
        f"""
file_events AS (
  SELECT repo, commit_seq, change_seq, commit_hash, commit_date, author, change_type AS type,
         CASE WHEN change_type = 'DELETE' THEN old_path ELSE new_path END AS path,
         CASE WHEN change_type = 'RENAME' THEN old_path END AS old_path,
         CASE WHEN change_type = 'ADD' THEN added_lines END AS lines,
         row_number() OVER (PARTITION BY repo ORDER BY commit_seq, change_seq) AS seq
  FROM file_changes
  WHERE (change_type IN ('ADD', 'RENAME') AND {is_java('new_path')}
         AND NOT {is_excluded('new_path')})
     OR (change_type = 'DELETE' AND {is_java('old_path')})
)""",
    ),
    "edges": (
        ("file_events",),
        """
backward AS (
  SELECT repo, path AS src, arg_max(old_path, seq) AS dst FROM file_events
  WHERE type = 'RENAME' GROUP BY repo, path
), forward AS (
  SELECT repo, old_path AS src, arg_max(path, seq) AS dst FROM file_events
  WHERE type = 'RENAME' GROUP BY repo, old_path
)""",
    ),
    "additions": (
        ("file_events",),
        """
additions AS (
  SELECT repo, path, arg_min({'seq': seq, 'commit_seq': commit_seq, 'change_seq': change_seq,
      'commit_hash': commit_hash, 'commit_date': commit_date, 'author': author,
      'lines': lines}, CASE WHEN seq > gone THEN seq ELSE seq + 1000000000000 END) AS added
  FROM (SELECT *, coalesce(max(CASE WHEN type = 'DELETE' THEN seq END)
                             OVER (PARTITION BY repo, path), 0) AS gone
        FROM file_events WHERE type <> 'RENAME')
  WHERE type = 'ADD' GROUP BY repo, path
)""",
    ),
    "deletions": (
        ("file_events", "edges"),
        """
deletions AS (
  SELECT repo, path, commit_date AS deletion_date, commit_hash AS deletion_commit
  FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY seq DESC) AS r
        FROM file_events WHERE type <> 'RENAME') e
  WHERE r = 1 AND type = 'DELETE'
    AND NOT EXISTS (SELECT 1 FROM forward f WHERE f.repo = e.repo AND f.src = e.path)
)""",
    ),
    "origins": (
        ("file_events", "edges"),
        """
back_walk AS (
  SELECT DISTINCT repo, path, path AS cur, [path] AS trail, false AS looped, 0 AS step
  FROM file_events WHERE type = 'ADD'
  UNION ALL
  SELECT w.repo, w.path, e.dst,
         CASE WHEN list_contains(trail, e.dst) THEN trail ELSE list_append(trail, e.dst) END,
         list_contains(trail, e.dst), step + 1
  FROM back_walk w JOIN backward e ON e.repo = w.repo AND e.src = w.cur WHERE NOT looped
), origins AS (
  SELECT repo, path, arg_max(cur, step) AS original, arg_max(trail, step) AS trail
  FROM back_walk GROUP BY repo, path
)""",
    ),
    "chains": (
        ("origins",),
        """
starting AS (
  SELECT repo, original, min(trail[list_position(trail, original):]) AS earlier
  FROM origins GROUP BY repo, original
), ahead_walk AS (
  SELECT repo, original, original AS cur, [original] AS trail, false AS looped, 0 AS step
  FROM starting
  UNION ALL
  SELECT w.repo, w.original, e.dst,
         CASE WHEN list_contains(trail, e.dst) THEN trail ELSE list_append(trail, e.dst) END,
         list_contains(trail, e.dst), step + 1
  FROM ahead_walk w JOIN forward e ON e.repo = w.repo AND e.src = w.cur WHERE NOT looped
), chains AS (
  SELECT repo, original, final,
         list_concat(trail, list_filter(earlier, lambda p: NOT list_contains(trail, p)))
           AS all_paths
  FROM (SELECT repo, original, arg_max(cur, step) AS final, arg_max(trail, step) AS trail
        FROM ahead_walk GROUP BY repo, original) JOIN starting USING (repo, original)
)""",
    ),
    "files": (
        ("chains", "additions", "deletions", "commit_stats", "generic"),
        f"""
steps AS (
  SELECT repo, original, final, unnest(all_paths) AS path,
         generate_subscripts(all_paths, 1) AS step FROM chains
), chain_adds AS (
  SELECT repo, original, any_value(final) AS final, arg_min(added, step) AS added
  FROM steps JOIN additions USING (repo, path) GROUP BY repo, original
), winners AS (
  SELECT repo, final AS path, count(*) AS chains, arg_max(original, (added.seq, original)) AS original,
         arg_max(added, (added.seq, original)) AS added
  FROM chain_adds GROUP BY repo, final
), step_classes AS (
  SELECT repo, original, path, step, {class_name('path')} AS class_name FROM steps
), {package_blocks('steps', 'packages_of')}, step_names AS (
  SELECT s.repo, s.original,
         (SELECT 1) AS one, s.class_name, p.package, s.step
  FROM step_classes s JOIN packages_of p USING (path)
), class_lists AS (
  SELECT repo, original, list(class_name ORDER BY step) AS class_names
  FROM (SELECT repo, original, class_name, min(step) AS step FROM step_names GROUP BY ALL)
  GROUP BY repo, original
), package_lists AS (
  SELECT repo, original, list(package ORDER BY step) AS packages
  FROM (SELECT repo, original, package, min(step) AS step FROM step_names GROUP BY ALL)
  GROUP BY repo, original
), {candidate_blocks('step_classes', 'candidates_of')}, winner_names AS (
  SELECT w.repo, w.path, class_names, packages, {class_name('w.path')} AS class_name,
         {is_test('w.path')} AS is_test, {is_helper('w.path')} AS helper_name
  FROM winners w JOIN class_lists USING (repo, original) JOIN package_lists USING (repo, original)
), tried_names AS (
  SELECT repo, path, unnest(list_prepend(class_name, class_names)) AS name,
         generate_subscripts(list_prepend(class_name, class_names), 1) AS i
  FROM winner_names WHERE is_test
), tried AS (
  SELECT repo, path, i, unnest(candidates) AS c, generate_subscripts(candidates, 1) AS j
  FROM tried_names JOIN candidates_of ON class_name = name
), merged AS (
  SELECT repo, path, list(c ORDER BY place) AS candidates
  FROM (SELECT repo, path, c, min((i, j)) AS place FROM tried GROUP BY ALL) GROUP BY repo, path
), files AS (
  SELECT w.repo, w.path, w.chains, CASE WHEN w.original <> w.path THEN w.original END
           AS original_path,
         w.added.commit_hash AS commit_hash, w.added.commit_date AS commit_date,
         w.added.author AS author, w.added.lines AS file_lines,
         w.added.commit_seq AS commit_seq, w.added.change_seq AS change_seq,
         deletion_commit IS NOT NULL AS is_deleted, deletion_date, deletion_commit,
         n.class_name, p.package AS package_path, n.is_test,
         n.is_test AND n.helper_name AS is_helper, n.class_names, n.packages,
         CASE WHEN n.is_test THEN coalesce(m.candidates, []) ELSE [n.class_name] END
           AS candidates,
         CASE WHEN n.is_test AND len(m.candidates) > 0 THEN m.candidates[1]
              ELSE n.class_name END AS base_class,
         coalesce(total_lines, 0) AS commit_lines, coalesce(files_count, 0) AS commit_files,
         coalesce(java_files_count, 0) AS commit_java_files
  FROM winners w JOIN winner_names n ON n.repo = w.repo AND n.path = w.path
  JOIN packages_of p ON p.path = w.path
  LEFT JOIN merged m ON m.repo = w.repo AND m.path = w.path
  LEFT JOIN deletions d ON d.repo = w.repo AND d.path = w.path
  LEFT JOIN commit_stats s ON s.repo = w.repo AND s.commit_hash = w.added.commit_hash
)""",
    ),
    "matches": (
        ("files",),
        """
package_keys AS (
  SELECT DISTINCT package, list_filter([
      CASE WHEN package <> '' THEN 'main:' || replace(replace(package, '/test/', '/main/'),
                                                      '/tests/', '/main/') END,
      CASE WHEN len(string_split(package, '/')) >= 3
           THEN 'tail:' || array_to_string(string_split(package, '/')[-3:], '/') END],
      lambda k: k IS NOT NULL) AS keys
  FROM packages_of
), offers AS (
  SELECT repo, path, packages, class_names, candidates, is_test, is_helper, commit_seq,
         change_seq, list_distinct(flatten(list(keys))) AS keys
  FROM (SELECT *, unnest(packages) AS package FROM files) JOIN package_keys USING (package)
  GROUP BY ALL
), met AS (
  SELECT t.repo, t.path AS test_file, c.rank, c.class_name, p.path AS prod_file,
         p.commit_seq, p.change_seq,
         CASE WHEN list_has_any(t.packages, p.packages) THEN 0
              WHEN list_has_any(t.keys, p.keys) THEN 1
              WHEN c.rank = 0 THEN 2 END AS method
  FROM (SELECT repo, path, unnest(candidates) AS class_name,
               generate_subscripts(candidates, 1) - 1 AS rank
        FROM files WHERE is_test AND NOT is_helper) c
  JOIN offers t ON t.repo = c.repo AND t.path = c.path
  JOIN (SELECT *, unnest(class_names) AS class_name FROM offers WHERE NOT is_test) p
    ON p.repo = c.repo AND p.class_name = c.class_name
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY repo, test_file
      ORDER BY rank, method, commit_seq, change_seq, prod_file) AS r
  FROM met WHERE method IS NOT NULL
), matches AS (
  SELECT repo, test_file, prod_file, class_name AS matched_class,
         CAST(rank AS INTEGER) AS candidate_rank, method,
         ['exact_class_same_package', 'exact_class_similar_package',
          'exact_class_different_package'][method + 1] AS match_method
  FROM ranked WHERE r = 1
)""",
    ),
    "pairs": (
        ("matches",),
        """
pairs AS (
  SELECT m.repo, m.test_file, m.prod_file, m.match_method,
    t.class_name AS test_class, t.commit_hash AS test_commit, t.commit_date AS test_date,
    t.author AS test_author, t.file_lines AS test_file_lines,
    t.commit_lines AS test_commit_total_lines, t.commit_files AS test_commit_files,
    t.commit_java_files AS test_commit_java_files, t.original_path AS test_original_file,
    t.is_deleted AS test_is_deleted, t.deletion_date AS test_deletion_date,
    t.deletion_commit AS test_deletion_commit,
    t.original_path IS NOT NULL AS test_was_renamed,
    p.class_name AS prod_class, p.commit_hash AS prod_commit, p.commit_date AS prod_date,
    p.author AS prod_author, p.file_lines AS prod_file_lines,
    p.commit_lines AS prod_commit_total_lines, p.commit_files AS prod_commit_files,
    p.commit_java_files AS prod_commit_java_files, p.original_path AS prod_original_file,
    p.is_deleted AS prod_is_deleted, p.deletion_date AS prod_deletion_date,
    p.deletion_commit AS prod_deletion_commit,
    p.original_path IS NOT NULL AS prod_was_renamed,
    CASE WHEN t.commit_hash = p.commit_hash THEN 'SAME_COMMIT'
         WHEN t.commit_date < p.commit_date THEN 'TEST_FIRST'
         ELSE 'PRODUCTION_FIRST' END AS classification,
    CASE WHEN t.commit_hash = p.commit_hash THEN 0.0::DOUBLE
         ELSE abs(epoch_us(p.commit_date) - epoch_us(t.commit_date)) / 1e6::DOUBLE / 3600 END
      AS time_diff_hours,
    CASE WHEN t.is_deleted AND p.is_deleted THEN 'BOTH_DELETED'
         WHEN t.is_deleted THEN 'TEST_DELETED' WHEN p.is_deleted THEN 'PROD_DELETED'
         ELSE 'ACTIVE' END AS pair_status
  FROM matches m JOIN files t ON t.repo = m.repo AND t.path = m.test_file
  JOIN files p ON p.repo = m.repo AND p.path = m.prod_file
)""",
    ),
    "unmatched": (
        ("matches",),
        """
unmatched AS (
  SELECT repo, path AS test_file, class_name AS test_class, class_names,
         candidates AS candidates_tried,
         CASE WHEN len(candidates) = 0
              THEN 'No valid production class candidates (likely integration test)'
              ELSE 'No matching production file found' END AS reason,
         original_path, commit_hash, commit_date, author, is_helper
  FROM files f
  WHERE is_test AND NOT is_helper AND repo IN (SELECT repo FROM files WHERE NOT is_test)
    AND NOT EXISTS (SELECT 1 FROM matches m WHERE m.repo = f.repo AND m.test_file = f.path)
)""",
    ),
    "summary": (
        ("pairs",),
        """
inventory AS (
  SELECT repo, count(*) FILTER (is_test) AS test_files_added,
         CAST(coalesce(sum(chains) FILTER (is_helper), 0) AS BIGINT) AS test_helpers,
         count(*) FILTER (NOT is_test) AS prod_files_added,
         count(*) FILTER (is_test AND NOT is_helper) AS real_tests,
         CAST(coalesce(sum(chains) FILTER (is_test AND is_deleted), 0) AS BIGINT)
           AS deleted_tests,
         CAST(coalesce(sum(chains) FILTER (NOT is_test AND is_deleted), 0) AS BIGINT)
           AS deleted_prods
  FROM files GROUP BY repo
), pair_counts AS (
  SELECT repo, count(*) AS matched_pairs, count(DISTINCT prod_file) AS matched_prods,
         count(*) FILTER (classification = 'TEST_FIRST') AS test_first_count,
         count(*) FILTER (classification = 'SAME_COMMIT') AS same_commit_count,
         count(*) FILTER (classification = 'PRODUCTION_FIRST') AS prod_first_count,
         count(*) FILTER (pair_status = 'ACTIVE') AS active_pairs,
         count(*) FILTER (pair_status <> 'ACTIVE') AS deleted_pairs,
         count(*) FILTER (pair_status = 'TEST_DELETED') AS test_deleted_pairs,
         count(*) FILTER (pair_status = 'PROD_DELETED') AS prod_deleted_pairs,
         count(*) FILTER (pair_status = 'BOTH_DELETED') AS both_deleted_pairs
  FROM pairs GROUP BY repo
), shared AS (
  SELECT repo, count(*) AS multi_test_prods
  FROM (SELECT repo, prod_file FROM pairs GROUP BY ALL HAVING count(*) > 1) GROUP BY repo
), counters AS (
  SELECT c.repo, total_commits, coalesce(test_files_added, 0) AS test_files_added,
         coalesce(test_helpers, 0) AS test_helpers,
         coalesce(prod_files_added, 0) AS prod_files_added,
         coalesce(matched_pairs, 0) AS matched_pairs,
         coalesce(multi_test_prods, 0) AS multi_test_prods,
         coalesce(test_first_count, 0) AS test_first_count,
         coalesce(same_commit_count, 0) AS same_commit_count,
         coalesce(prod_first_count, 0) AS prod_first_count,
         CASE WHEN test_files_added > 0 AND prod_files_added > 0
              THEN real_tests - coalesce(matched_pairs, 0) ELSE 0 END AS unmatched_test_files,
         CASE WHEN test_files_added > 0 AND prod_files_added > 0
              THEN prod_files_added - coalesce(matched_prods, 0) ELSE 0 END
           AS unmatched_prod_files,
         coalesce(active_pairs, 0) AS active_pairs, coalesce(deleted_pairs, 0) AS deleted_pairs,
         coalesce(test_deleted_pairs, 0) AS test_deleted_pairs,
         coalesce(prod_deleted_pairs, 0) AS prod_deleted_pairs,
         coalesce(both_deleted_pairs, 0) AS both_deleted_pairs
  FROM (SELECT repo, count(DISTINCT commit_hash) AS total_commits FROM file_changes
        GROUP BY repo) c
  LEFT JOIN inventory USING (repo) LEFT JOIN pair_counts USING (repo)
  LEFT JOIN shared USING (repo)
), summary AS (
  SELECT *,
    CASE WHEN matched_pairs > 0 THEN test_first_count / matched_pairs * 100 ELSE 0.0 END
      AS test_first_pct,
    CASE WHEN matched_pairs > 0 THEN same_commit_count / matched_pairs * 100 ELSE 0.0 END
      AS same_commit_pct,
    CASE WHEN matched_pairs > 0 THEN prod_first_count / matched_pairs * 100 ELSE 0.0 END
      AS prod_first_pct,
    CASE WHEN test_files_added - test_helpers > 0
         THEN matched_pairs / (test_files_added - test_helpers) * 100 ELSE 0.0 END
      AS match_rate_pct
  FROM counters
)""",
    ),
    "commits_table": (
        ("commit_stats",),
        """
commits_table AS (
  SELECT repo AS repository, commit_hash, commit_date, author,
         total_lines AS total_lines_added, files_count AS total_files_count, java_files_count
  FROM commit_stats
)""",
    ),
    "pairs_table": (
        ("pairs",),
        """
pairs_table AS (
  SELECT repo AS repository, classification, test_file, prod_file, test_class, prod_class,
         test_commit, prod_commit,
         test_date, prod_date, test_author, prod_author, time_diff_hours,
         time_diff_hours / 24 AS time_diff_days, test_file_lines, test_commit_total_lines,
         test_commit_files, test_commit_java_files, prod_file_lines, prod_commit_total_lines,
         prod_commit_files, prod_commit_java_files, pair_status
  FROM pairs
)""",
    ),
    "flagged": (
        ("commits_table", "pairs_table"),
        """
judged AS (
  SELECT * REPLACE (total_lines_added::DOUBLE AS total_lines_added,
                    total_files_count::DOUBLE AS total_files_count)
  FROM commits_table WHERE repository IN (SELECT repository FROM pairs_table)
), thresholds AS (
  SELECT repository, quantile_cont(total_lines_added, 0.99) AS thr_lines,
         quantile_cont(total_files_count, 0.99) AS thr_files
  FROM judged GROUP BY repository
), flagged AS (
  SELECT *, total_lines_added >= thr_lines AS out_due_to_lines,
         total_files_count >= thr_files AS out_due_to_files,
         total_lines_added >= thr_lines OR total_files_count >= thr_files AS is_outlier
  FROM judged JOIN thresholds USING (repository)
), outliers AS (
  SELECT repository, commit_hash, total_lines_added, total_files_count, out_due_to_lines,
         out_due_to_files, thr_lines, thr_files FROM flagged WHERE is_outlier
)""",
    ),
    "adjusted": (
        ("flagged",),
        """
adjusted AS (
  SELECT p.*, CASE WHEN classification = 'SAME_COMMIT'
                    AND repository IN (SELECT repository FROM flagged)
               THEN (repository, test_commit) IN (SELECT (repository, commit_hash) FROM outliers)
              END AS same_commit_is_outlier,
         CASE WHEN classification = 'SAME_COMMIT'
               AND (repository, test_commit) IN (SELECT (repository, commit_hash) FROM outliers)
              THEN 'SAME_COMMIT_OUTLIER' ELSE classification END AS classification_adj
  FROM pairs_table p
)""",
    ),
    "summary_adjusted": (
        ("adjusted",),
        """
adjusted_counts AS (
  SELECT repository, count(*) AS matched_pairs,
         count(*) FILTER (classification_adj = 'TEST_FIRST') AS test_first_count,
         count(*) FILTER (classification_adj = 'SAME_COMMIT') AS same_commit_count,
         count(*) FILTER (classification_adj = 'SAME_COMMIT_OUTLIER')
           AS same_commit_outlier_count,
         count(*) FILTER (classification_adj = 'PRODUCTION_FIRST') AS prod_first_count
  FROM adjusted GROUP BY repository
), summary_adjusted AS (
  SELECT *, test_first_count / matched_pairs * 100 AS test_first_pct,
         same_commit_count / matched_pairs * 100 AS same_commit_pct,
         same_commit_outlier_count / matched_pairs * 100 AS same_commit_outlier_pct,
         prod_first_count / matched_pairs * 100 AS prod_first_pct,
         CASE WHEN matched_pairs > same_commit_outlier_count THEN test_first_count
           / (matched_pairs - same_commit_outlier_count) * 100 ELSE 0.0 END AS test_first_adj_pct,
         CASE WHEN matched_pairs > same_commit_outlier_count THEN same_commit_count
           / (matched_pairs - same_commit_outlier_count) * 100 ELSE 0.0 END AS same_commit_adj_pct,
         CASE WHEN matched_pairs > same_commit_outlier_count THEN prod_first_count
           / (matched_pairs - same_commit_outlier_count) * 100 ELSE 0.0 END AS prod_first_adj_pct
  FROM adjusted_counts
)""",
    ),
    "candidates": (
        ("repo_stats", "repo_tree"),
        f"""
tree_counts AS (
  SELECT repo, java_files, test_files,
         CASE WHEN java_files > 0 THEN round(test_files / java_files, 4) ELSE 0.0 END
           AS test_ratio
  FROM (SELECT repo, count(*) FILTER (java) AS java_files,
               count(*) FILTER (java AND regexp_matches({base('path')},
                 {any_of(fixed.TREE_TEST_NAMES)})) AS test_files
        FROM (SELECT *, type = 'blob' AND {is_java('path')}
                AND {base('path')} NOT IN ({quoted(fixed.TREE_METADATA_NAMES)})
                AND NOT {contains_any('path', fixed.TREE_GENERATED)} AS java FROM repo_tree)
        GROUP BY repo)
), root_flags AS (
  SELECT repo,
         bool_or(path IN ({quoted(fixed.BUILD_FILES)})) AS has_build_system,
         bool_or(path IN ({quoted(fixed.CI_FILES)})) AS has_ci_system
  FROM repo_tree GROUP BY repo
), structured AS (
  SELECT s.*, coalesce(java_files, 0) AS java_files, coalesce(test_files, 0) AS test_files,
         coalesce(test_ratio, 0.0) AS test_ratio,
         coalesce(has_build_system, false) AS has_build_system,
         coalesce(has_ci_system, false) AS has_ci_system
  FROM repo_stats s LEFT JOIN tree_counts USING (repo) LEFT JOIN root_flags USING (repo)
), candidates AS (
  SELECT * FROM structured
  WHERE main_language = 'Java' AND num_commits > 500 AND project_life_days > 365
), shortlist AS (
  SELECT * FROM candidates WHERE (has_build_system OR has_ci_system) AND java_files > 50
)""",
    ),
    "reach": (
        ("commit_graph", "branches"),
        """
reach AS (
  SELECT repo, head AS oid FROM branches WHERE branch = 'main'
  UNION
  SELECT r.repo, unnest(g.parents) FROM reach r JOIN commit_graph g
    ON g.repo = r.repo AND g.oid = r.oid
)""",
    ),
    "reach_all": (
        ("commit_graph", "branches"),
        """
reach_all AS (
  SELECT repo, branch, head AS oid FROM branches
  UNION
  SELECT r.repo, r.branch, unnest(g.parents) FROM reach_all r JOIN commit_graph g
    ON g.repo = r.repo AND g.oid = r.oid
)""",
    ),
}


def sql(select: str, *needed: str) -> str:
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for other in BLOCKS[name][0]:
                need(other)
            order.append(name)

    for name in needed:
        need(name)
    blocks = ", ".join(BLOCKS[n][1].strip() for n in order)
    return f"WITH RECURSIVE {blocks}\n{select}" if blocks else select
