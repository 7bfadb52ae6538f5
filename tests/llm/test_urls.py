import random
import re

from pyspark.sql import functions as F

from commitlens.llm import q_urls
from commitlens.llm.urls import BLOCK, Rule, build, host_rule, judge, run, tokens

from .helpers import FOLDER, duck, same_rows


def as_regex(glob):
    kinds = {"*": b"[^/]*", "**": b".*", "?": b"[^/]"}
    return re.compile(b"".join(kinds.get(t) or re.escape(t) for t in tokens(glob)), re.S)


def test_automaton_against_regular_expressions():
    rng = random.Random(4)
    globs = ["", "*", "**", "?", "a*b", "**b", "a?c**", "*.x/*/y", "\\*a", "é*", "a" * 70 + "*", "*a*a*a"]
    globs += ["".join(rng.choice(["a", "b", "/", "*", "?", "**"]) for _ in range(rng.randint(1, 12))) for _ in range(80)]
    texts = [b"", b"*a", "éa".encode(), b"a" * 75, b".x/q/y"] + [
        "".join(rng.choice("ab/.") for _ in range(rng.randint(0, 14))).encode() for _ in range(200)
    ]
    found = run(build(globs), texts)
    for i, text in enumerate(texts):
        for j, glob in enumerate(globs):
            assert found[i, j] == bool(as_regex(glob).fullmatch(text)), (text, glob)


def test_query_against_sql(spark):
    same_rows(q_urls.op6_urls(spark, FOLDER), duck(FOLDER), q_urls.SQL)


def test_edges(spark):
    urls = {
        "http://EXAMPLE.org/en/12?x": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://a.example.org/es/": ("a.example.org", "/es/", "example.org/es/", "block"),
        "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://x.org?y": ("x.org", "", None, "allow"),
        "http://x.com/x.example.org/es/y": ("x.com", "/x.example.org/es/y", None, "allow"),
        "http://org/": ("org", "/", "org/", "allow"),
        "http://www.casino-win.net": ("www.casino-win.net", "", None, "block"),
        "http://www.casino-win.net/a/b": ("www.casino-win.net", "/a/b", None, "block"),
        "http://casino.org/x": ("casino.org", "/x", "org/", "allow"),
        "no scheme.org/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://y.com/fr/" + "a" * 100_000: ("y.com", "/fr/" + "a" * 100_000, "com/fr/", "allow"),
    }
    rows = [(i, u) for i, u in enumerate([*urls, None, "http://org/"])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit(1))
    found = judge(pages, q_urls.RULES)
    assert found.columns == ["page_id", "url", "rule", "host", "path", "rule_", "verdict"]
    for r in found.collect():
        assert (r.host, r.path, r.rule_, r.verdict) == urls.get(r.url, ("", "", None, "allow"))
    assert judge(pages.limit(0), q_urls.RULES).count() == 0
    assert judge(pages, []).filter("verdict != 'allow'").count() == 0


def test_longer_rule_wins_and_equal_rank_goes_to_the_first(spark):
    pages = spark.createDataFrame([("http://a.b/c/d",)], "url string")
    rules = [host_rule("b/", "allow"), host_rule("b/c/", BLOCK), Rule("**", "allow", "all", 4), Rule("**", BLOCK, "late", 4)]
    assert judge(pages, rules).first().rule == "b/c/"
    assert judge(pages, rules[2:]).first().rule == "all"
