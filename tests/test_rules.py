"""Scalar rules against tables of cases and plain Python."""

import itertools
import random

from pyspark.sql import functions as F

from commitlens.functions import names, paths, values


def apply(spark, rows, rule, type_="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {type_}")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("x"))).collect()]


def check(spark, cases, rule):
    rows = list(cases)
    assert dict(zip(rows, apply(spark, rows, rule))) == cases


def test_is_test_file(spark):
    check(
        spark,
        {
            "src/test/java/a/FooTest.java": True,
            "src/test/java/a/FooTests.java": True,
            "src/test/java/a/TestFoo.java": True,
            "src/main/java/a/Testing.java": False,
            "a/src/test/java/a/Helper.java": True,
            "src/test/java/a/Helper.java": True,
            "src/test/javax/Helper.java": False,
            "x/tests/java/Helper.java": True,
            "src/it/java/a/FooTest.java": False,
            "limits/FooTest.java": False,
            "a/foo-it-bar/FooTest.java": False,
            "a/Core-IT/FooTest.java": False,
            "a/test/resources/FooTest.java": False,
            "a/samples/FooTest.java": False,
            "a/src/test/java/FooIT.java": False,
            "a/src/test/java/FooITCase.java": False,
            "a/src/test/java/FooSpec.java": False,
            "a/FooIntegrationTest.java": False,
            "a/FooE2ETest.java": False,
            "src/main/java/a/Foo.java": False,
        },
        paths.is_test_file,
    )


def test_is_test_helper(spark):
    check(
        spark,
        {
            "a/AbstractFooTest.java": True,
            "a/FooTestCase.java": True,
            "a/FooTestUtil.java": True,
            "a/MockFoo.java": True,
            "a/FooMock.java": False,
            "a/CustomIoException.java": True,
            "a/FooForTest.java": True,
            "Mock/Foo.java": False,
            "a/FooTest.java": False,
        },
        paths.is_test_helper,
    )


def test_is_excluded(spark):
    check(
        spark,
        {
            "a/package-info.java": True,
            "a/PACKAGE-INFO.JAVA": True,
            "a/generated/X.java": True,
            "generated/X.java": False,
            "a/target/b/X.java": True,
            "a/Build/X.java": True,
            "a/builds/X.java": False,
        },
        paths.is_excluded,
    )


def test_class_name_and_directories(spark):
    check(spark, {"a/b/Foo.java": "Foo", "Foo.java.java": "Foo", "X": "X"}, paths.class_name)
    check(
        spark,
        {"a/b/Foo.java": "a/b", "Foo.java": "", "/Foo.java": "/", "a//Foo.java": "a"},
        paths.dirname,
    )


def test_package_path(spark):
    check(
        spark,
        {
            "kafka-clients/src/main/java/org/x/Producer.java": "kafka-clients/org/x",
            "m/src/test/java/org/x/ProducerTest.java": "m/org/x",
            "src/test/java/org/x/T.java": "org/x",
            "src/main/java/T.java": "",
            "m/src/main/java/T.java": "m",
            "m\\src\\test\\java\\org\\T.java": "m/org",
            "m/src/integrationTest/java/org/T.java": "m/org",
            "m/src/test/scala/org/T.java": "m/org",
            "latest/x/T.java": "lamain/x",
            "a/b/T.java": "a/b",
            "T.java": "",
            "lib/java/org/T.java": "lib/org",
        },
        paths.package_path,
    )


def test_production_candidates(spark):
    check(
        spark,
        {
            "IOUtilsCopyDirectoryTest": ["IOUtilsCopyDirectory", "IOUtilsCopy", "IOUtils"],
            "FooIntegrationTest": ["FooIntegration"],
            "AppTest": ["App"],
            "AbTest": [],
            "TestFileUtils": ["TestFileUtils", "FileUtils", "TestFile"],
            "TestFileUtilsTest": ["TestFileUtils", "FileUtils", "TestFile"],
            "TestCase": ["Case"],
            "Test": [],
            "Tests": [],
            "IT0001Test": [],
            "MavenIT0001Test": [],
            "FooITCase0001": [],
            "Mng1234ITTest": [],
            "Issue5678Test": [],
            "KafkaTest": [],
            "KafkaStoreTests": ["KafkaStore"],
            "MainTest": [],
            "FooBarTestCase": ["FooBar"],
            "TestFoo": ["TestFoo"],
            "ÄpfelÖlTest": ["ÄpfelÖl", "Äpfel"],
        },
        lambda c: names.names_of(names.candidate_offers(c)),
    )


def test_merged_candidates_keep_first_place(spark):
    df = spark.createDataFrame([(["FooBarTest", "FooBarBazTest"],)], "x array<string>")
    merged = names.names_of(names.merged_offers(F.col("x")))
    assert df.select(merged).first()[0] == ["FooBar", "FooBarBaz"]


def test_fixed_terms():
    known = set(names.fixed_terms())
    assert {"Abstract", "Test", "Utils", "App", "Spark", "Camel", "Hive", "ODF", "jUDDI", "Juddi"} <= known
    assert {"HBase", "Hbase", "ZooKeeper", "Zookeeper", "PLC4X", "Plc4x", "MINA", "Mina"} <= known
    assert not {"Odf", "HBASE", "Foo"} & known


def test_project_terms_from_a_table(spark):
    repos = spark.createDataFrame([("commons-csv",), ("kafka",), ("commons_io",), ("-x",), (None,), ("",)], "repo string")
    assert {r.term for r in names.project_terms(repos).collect()} == {"Commons", "Kafka"}


def test_a_million_terms_of_a_table(spark):
    terms = spark.range(1_000_000).select(F.concat(F.lit("Term"), "id").alias("name"))
    terms = names.term_table(spark, terms.unionByName(spark.createDataFrame([("FileUtils",), ("Ab",)], "name string")))
    rows = [(1, ["FileUtilsCopyTest", "FileUtilsTest"]), (2, ["Term77Test"]), (3, ["KafkaTest"]), (4, []), (5, ["AbcTest"]), (6, ["Term77XTest", "FooBarTest"])]
    df = spark.createDataFrame(rows, "id int, x array<string>").withColumn("c", names.merged_offers(F.col("x")))
    kept = names.without_terms(df, ["id"], "c", terms)
    assert kept.columns == ["id", "x", "c"]
    assert {r.id: r.c for r in kept.collect()} == {
        1: ["FileUtilsCopy", "File"], 2: [], 3: [], 4: [], 5: ["Abc"], 6: ["Term77X", "FooBar"]
    }


def test_terms_as_a_list_or_none(spark):
    df = spark.createDataFrame([(1, ["FooBarBazTest"])], "id int, x array<string>").withColumn("c", names.merged_offers(F.col("x")))
    assert names.term_table(spark, None) is None
    listed = names.term_table(spark, ["FooBar"])
    assert names.without_terms(df, ["id"], "c", listed).first().c == ["FooBarBaz"]
    assert names.without_terms(df, ["id"], "c", None).first().c == ["FooBarBaz", "FooBar"]


PACKAGE_CASES = [
    ("a/b", "a/b", True),
    ("", "", False),
    ("", "a/b/c", False),
    ("a/b", "a/c", False),
    ("x/a/b/c", "y/a/b/c", True),
    ("a/b/c", "y/z/a/b/c", True),
    ("x/b/c", "y/b/c", False),
    ("b/c", "x/b/c", False),
    ("m/test/a", "m/main/a", True),
    ("m/tests/a", "m/main/a", True),
    ("m/test/a", "m/tests/a", True),
    ("test/a", "main/a", False),
    ("m/test", "m/main", False),
    ("m/main/a", "n/main/a", False),
    ("k/m/main/a", "n/m/main/a", True),
    ("a//b/c", "x/a/b/c", True),
]


def test_packages_similar(spark):
    df = spark.createDataFrame(PACKAGE_CASES, "a string, b string, wanted boolean")
    got = df.select("*", paths.packages_similar(F.col("a"), F.col("b")).alias("got")).collect()
    assert [(r.a, r.b, r.got) for r in got] == PACKAGE_CASES


def test_packages_similar_is_symmetric_and_sees_common_tails(spark):
    rng = random.Random(7)
    packages = ["/".join(rng.choices(["a", "b", "test", "main"], k=rng.randint(1, 5))) for _ in range(30)]
    df = spark.createDataFrame(list(itertools.product(packages, packages)), "a string, b string")
    similar = paths.packages_similar
    rows = df.select("a", "b", similar(F.col("a"), F.col("b")).alias("x"), similar(F.col("b"), F.col("a")).alias("y")).collect()
    assert all(r.x == r.y for r in rows)
    assert all(r.x for r in rows if r.a == r.b)
    assert all(r.x for r in rows if len(r.a.split("/")) >= 3 and r.b.split("/")[-3:] == r.a.split("/")[-3:])


def test_same_empty_package_is_the_same(spark):
    df = spark.createDataFrame([(1,)], "i int")
    assert df.select(F.arrays_overlap(F.array(F.lit("")), F.array(F.lit("")))).first()[0]


def test_fixed_point_rounds_the_exact_value(spark):
    rng = random.Random(3)
    numbers = [0.0, 0.005, 0.35, 12.25, 12.75, 0.25, 99.95, 1234567.125, 100.0, 0.995, 66.65]
    numbers += [rng.randint(0, 10**6) / rng.randint(1, 999) for _ in range(2000)]
    numbers += [k / 8 for k in range(400)]
    for places in (1, 2):
        got = apply(spark, numbers, lambda c: values.fixed_point(c, places), "double")
        assert got == [f"{x:.{places}f}" for x in numbers]


def test_to_bool_and_numbers(spark):
    words = ["True", " yes ", "1", "T", "no", "", "2", None]
    assert apply(spark, words, values.to_bool) == [True] * 4 + [False] * 4
    assert apply(spark, ["1.5", "x", "NaN", None], values.to_number) == [1.5, None, None, None]
    assert apply(spark, ["1.5", "x", None], values.to_number_or_zero) == [1.5, 0.0, 0.0]


def test_days_are_whole_and_rounded_down(spark):
    df = spark.sql(
        """select timestamp '2020-01-01 23:00:00' a, timestamp '2020-01-02 01:00:00' b"""
    )
    a, b = F.col("a"), F.col("b")
    row = df.select(
        values.whole_days_between(a, b), values.whole_days_between(b, a), values.hours_between(a, b)
    ).first()
    assert tuple(row) == (0, -1, 2.0)


def test_category(spark):
    check(
        spark,
        {
            "commons lib": "Core Libraries/Utilities",
            "kafka Retired": "Retired/Incubating/Attic",
            "magnet naïdb": None,
            "a plugin and docs": "Build and Testing Tools",
            "docs docs plugin": "Infrastructure/DevOps Tooling",
            "machine learning sql": "Distributed Systems/Databases",
            "machine learning, learning sql": "Domain-Specific Libraries",
            "SQL": "Distributed Systems/Databases",
        },
        values.category,
    )
