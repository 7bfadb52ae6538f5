"""Schemas of the input tables."""

from __future__ import annotations

FILE_CHANGES = """
    repo string, commit_seq bigint, change_seq bigint, commit_hash string,
    commit_date timestamp, author string, change_type string, old_path string,
    new_path string, added_lines bigint
"""
REPO_META = """
    name string, language string, description string, stargazers_count bigint,
    forks_count bigint, fork boolean, archived boolean, size bigint,
    license struct<spdx_id string>
"""
REPO_TREE = "repo string, path string, type string"
REPO_STATS = """
    repo string, main_language string, stars bigint, forks bigint,
    num_commits double, first_commit_date timestamp, last_commit_date timestamp,
    project_life_days double
"""
CANDIDATES = """
    repo string, stars bigint, num_commits double, test_ratio double,
    test_files bigint, java_files bigint, has_build_system boolean,
    has_ci_system boolean, main_language string, forks bigint,
    first_commit_date timestamp, last_commit_date timestamp,
    project_life_days double
"""
COMMIT_GRAPH = """
    repo string, oid string, parents array<string>, commit_date timestamp,
    files_changed bigint, lines_changed bigint
"""
BRANCHES = "repo string, branch string, head string"
PULL_REQUEST_NODE = """
    struct<number bigint, mergedAt string, headRefOid string,
           mergeCommit struct<oid string>, commits struct<totalCount int>>
"""
PULL_REQUEST_PAGES = f"""
    repo string, page bigint, data struct<repository struct<pullRequests struct<
        nodes array<{PULL_REQUEST_NODE}>>>>
"""
COMMITS = """
    repository string, commit_hash string, commit_date timestamp, author string,
    total_lines_added bigint, total_files_count bigint, java_files_count bigint
"""
PAIRS = """
    repository string, classification string, test_file string, prod_file string,
    test_class string, prod_class string, test_commit string, prod_commit string,
    test_date timestamp, prod_date timestamp, test_author string,
    prod_author string, time_diff_hours double, time_diff_days double,
    test_file_lines bigint, test_commit_total_lines bigint,
    test_commit_files bigint, test_commit_java_files bigint,
    prod_file_lines bigint, prod_commit_total_lines bigint,
    prod_commit_files bigint, prod_commit_java_files bigint, pair_status string
"""
