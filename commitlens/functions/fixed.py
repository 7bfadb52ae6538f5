"""Word lists, patterns and limits whose values are given.

Fixed values: everything in this module has to hold exactly these entries,
in this order, for results to agree with the method it implements.
"""

# Paths left out of the analysis (case-insensitive).
EXCLUDED_PATHS = (
    r".*package-info\.java$",
    r".*module-info\.java$",
    r".*/generated/.*\.java$",
    r".*/target/.*\.java$",
    r".*/build/.*\.java$",
)

# Names of files that support tests without being one.
HELPER_NAMES = (
    r"Abstract.*Test.*\.java$",
    r".*TestCase\.java$",
    r".*TestUtils?\.java$",
    r".*TestHelper\.java$",
    r".*TestBase\.java$",
    r".*TestSupport\.java$",
    r".*TestResources?\.java$",
    r"Mock.*\.java$",
    r"Stub.*\.java$",
    r"Fake.*\.java$",
    r"Dummy.*\.java$",
    r".*Benchmark\.java$",
    r".*TestArguments?\.java$",
    r".*TestConstants?\.java$",
    r".*TestFixture\.java$",
    r".*Assertions?\.java$",
    r".*Adapter\.java$",
    r".*Proxy\.java$",
    r".*Wrapper\.java$",
    r"ThrowOn.*\.java$",
    r".*Listener\.java$",
    r"Custom.*Exception\.java$",
    r".*ForTest\.java$",
    r".*TestFactory.*\.java$",
    r"Broken.*\.java$",
)

# Pieces of a lower-cased path that mark integration tests,
# test resources and samples; none of these files is a unit test.
NOT_UNIT_TEST_DIRS = (
    "/src/it/",
    "/src/integration-test/",
    "/src/integrationtest/",
    "/src/integration/",
    "src/it/",
    "/it/src/",
    "/its/",
    "its/",
    "-it/",
    "-it-",
    "/it-",
    "it-suite",
    "core-it",
    "integration-tests/",
    "integrationtests/",
    "/test/resources/",
    "/testresources/",
    "/samples/",
    "/examples/",
)

# File names of integration and acceptance tests.
INTEGRATION_NAMES = (
    r".*IT\.java$",
    r".*ITCase\.java$",
    r".*Spec\.java$",
    r".*IntegrationTest\.java$",
    r".*AcceptanceTest\.java$",
    r".*E2ETest\.java$",
    r".*EndToEndTest\.java$",
)

# File names and directories of unit tests.
UNIT_TEST_NAMES = (
    r".*Test\.java$",
    r".*Tests\.java$",
    r"Test[A-Z].*\.java$",
)
UNIT_TEST_DIRS = ("/src/test/java/", "/test/java/", "/tests/java/")

# Class names that are test numbers, not production names.
TEST_ID_NAMES = (r"^IT[0-9a-z]", r"IT[0-9]{2,}", r"IT(mng|Case|case)[0-9]")
NUMBERED_TAIL = r"[0-9]+IT$"
NUMBERED_NAME = r"^[A-Z][a-z]*[0-9]{3,}$"

# Suffixes taken off a test class, the first that fits.
TEST_SUFFIXES = ("Test", "Tests", "TestCase")

# Shortest base that is a name, and shortest kept prefix.
SHORTEST_BASE = 3
SHORTEST_CANDIDATE = 4

# Test roots and the production roots they stand for.
TEST_TO_MAIN = (
    ("src/test/java/", "src/main/java/"),
    ("src/test/scala/", "src/main/scala/"),
    ("src/test/groovy/", "src/main/groovy/"),
    ("src/it/java/", "src/main/java/"),
    ("src/it/scala/", "src/main/scala/"),
    ("src/integrationTest/java/", "src/main/java/"),
    ("src/testFixtures/java/", "src/main/java/"),
    ("src/test-integration/java/", "src/main/java/"),
    ("test/java/", "main/java/"),
    ("test/", "main/"),
)

# Source roots that part the module from the package.
SOURCE_ROOTS = (
    "src/main/java/",
    "src/main/scala/",
    "src/main/groovy/",
    "src/java/",
    "main/java/",
    "java/",
)

# How many trailing package segments make two packages similar.
SIMILAR_SEGMENTS = 3

# Class names too general to match on.
CLASS_PREFIXES = (
    "Abstract", "Base", "Default", "Simple", "Basic", "Generic", "Standard",
    "Common", "Core", "Main", "Internal", "Impl",
)
TEST_WORDS = ("Test", "Tests", "Mock", "Stub", "Fake", "Dummy", "Spy")
UTILITY_WORDS = (
    "Util", "Utils", "Utility", "Utilities", "Helper", "Helpers", "Tool",
    "Tools", "Support", "Handler", "Manager", "Service", "Factory", "Builder",
    "Provider", "Processor", "Listener",
)
COMMON_CLASSES = (
    "App", "Application", "Main", "Client", "Server", "Config", "Context",
    "Session", "Request", "Response", "Result", "Data", "Info", "Item",
    "Node", "Entry", "Record", "Event", "Task", "Job", "Action", "Command",
    "Message", "Error", "Type", "Kind", "Mode", "State", "Status", "Phase",
    "Stage",
)
# Project names.  Where a project writes capitals inside its name, the
# spelling with one capital in front counts as well (functions.names.fixed_terms).
PROJECT_NAMES = (
    "Abdera", "Accumulo", "Ace", "ActiveMQ", "Airavata", "Ambari", "Amoro",
    "Ant", "Apex", "Archiva", "Aries", "Asterixdb", "Atlas", "Aurora", "Avro",
    "Axis", "Beam", "Bifromq", "Bookkeeper", "Brooklyn", "Bval", "Calcite",
    "Camel", "Cassandra", "Causeway", "Cayenne", "Celeborn", "Chainsaw",
    "Chemistry", "Chukwa", "Clerezza", "Cloudberry", "CloudStack", "Cocoon",
    "Commons", "Continuum", "Creadur", "Crunch", "Curator", "CXF", "DataFu",
    "DataSketches", "Ddlutils", "DeltaSpike", "Derby", "Directmemory",
    "Directory", "DolphinScheduler", "Doris", "Drill", "Druid", "Dubbo",
    "Eagle", "Empire", "Etch", "EventMesh", "Falcon", "Felix", "Fineract",
    "Flink", "Fory", "FreeMarker", "FtpServer", "Geode", "Geronimo", "Giraph",
    "Gobblin", "Gora", "Gravitino", "Groovy", "Guacamole", "Hadoop", "Hama",
    "Harmony", "HBase", "Helix", "Hertzbeat", "Hive", "Hop", "HttpComponents",
    "Hudi", "Iceberg", "Ignite", "InLong", "IoTDB", "Jackrabbit", "James",
    "JClouds", "Jena", "JMeter", "Johnzon", "Joshua", "JSPWiki", "jUDDI",
    "Kafka", "Karaf", "Knox", "Kylin", "Lens", "Lenya", "Linkis", "Logging",
    "Lucene", "ManifoldCF", "Marmotta", "Maven", "MetaModel", "Metron", "MINA",
    "Mnemonic", "MyFaces", "NetBeans", "NiFi", "Nutch", "ODE", "Odftoolkit",
    "OFBiz", "Olingo", "Oltu", "Onami", "OODT", "Oozie", "OpenJPA",
    "OpenMeetings", "OpenNLP", "OpenWebBeans", "ORC", "Ozone", "Paimon",
    "Parquet", "PDFBox", "Pekko", "Phoenix", "Pig", "Pinot", "Pivot", "PLC4X",
    "POI", "Polaris", "Polygene", "Portals", "Pulsar", "Qpid", "Rampart",
    "Ranger", "Ratis", "Rave", "Reef", "RocketMQ", "Roller", "Royale", "Samza",
    "Sandesha", "Santuario", "SeaTunnel", "Sedona", "Sentry", "ServiceComb",
    "ServiceMix", "ShardingSphere", "ShenYu", "Shindig", "Shiro", "SkyWalking",
    "Sling", "Solr", "Sqoop", "Stanbol", "Storm", "StormCrawler", "Stratos",
    "StreamPark", "StreamPipes", "Streams", "Struts", "Submarine", "Synapse",
    "Syncope", "SystemDS", "Tajo", "Tapestry", "Tez", "Tika", "Tiles",
    "TinkerPop", "Tomcat", "TomEE", "TsFile", "Turbine", "Tuscany", "UIMA",
    "Uniffle", "Unomi", "Usergrid", "Velocity", "VXQuery", "Whirr", "Wicket",
    "Wink", "Wookie", "Xalan", "Xerces", "XMLBeans", "XMLGraphics", "Zeppelin",
    "ZooKeeper",
)
# Names that count in this spelling alone.
COMMON_PROJECTS = (
    "ODF", "Apache", "Spring", "Google", "Amazon", "Spark", "Airflow",
)

# File names of a repository tree.
TREE_TEST_NAMES = (
    r".*Test\.java$",
    r".*Tests\.java$",
    r".*TestCase\.java$",
    r".*IT\.java$",
    r".*ITCase\.java$",
    r".*Spec\.java$",
    r"Test.*\.java$",
)
TREE_METADATA_NAMES = ("package-info.java", "module-info.java")
TREE_GENERATED = ("generated-sources", "generated/source")
BUILD_FILES = (
    "pom.xml", "build.gradle", "build.gradle.kts", "build.xml", "build.sbt",
    "WORKSPACE", "BUILD",
)
CI_FILES = (
    "Jenkinsfile", ".travis.yml", ".github", ".circleci", "appveyor.yml",
    ".appveyor.yml", "azure-pipelines.yml",
)

# Limits of the repository shortlist.
MIN_COMMITS = 500
MIN_LIFE_DAYS = 365
MIN_JAVA_FILES = 50
SHORTLIST_PARTS = 5

# Quantile above which a commit is an outlier, squash limits.
OUTLIER_QUANTILE = 0.99
SQUASH_MIN_FILES = 20
SQUASH_MIN_LINES = 500

# Keywords per category.  A hit in RETIRED decides at once.
RETIRED = "Retired/Incubating/Attic"
CATEGORY_KEYWORDS = {
    RETIRED: (
        "incubator", "incubating", "retired", "attic", "sandbox", "proposal",
        "harmony",
    ),
    "Build and Testing Tools": (
        "maven", "ant", "buildr", "gradle", "surefire", "jenkins", "compiler",
        "archetype", "plugin", "verifier", "qa", "ci", "unittest", "testing",
        "mock",
    ),
    "Infrastructure/DevOps Tooling": (
        "infrastructure", "site", "website", "doc", "docs", "docker", "helm",
        "k8s", "kubernetes", "admin", "dashboard", "devops", "travis",
        "appveyor", "container", "deployment",
    ),
    "Distributed Systems/Databases": (
        "hadoop", "spark", "kafka", "flink", "zookeeper", "cassandra", "hbase",
        "hive", "cloud", "cluster", "storm", "samza", "tez", "pig", "oozie",
        "sqoop", "flume", "avro", "parquet", "ignite", "geode", "kudu",
        "drill", "impala", "kylin", "phoenix", "pulsar", "rocketmq", "dubbo",
        "skywalking", "shardingsphere", "doris", "iotdb", "couchdb", "db",
        "database", "store", "nosql", "sql", "mesos", "helix", "curator",
        "bookkeeper", "ozone", "submarine", "airflow", "superset", "jpa",
        "jdbc", "persistence",
    ),
    "Application/Web Frameworks": (
        "struts", "tapestry", "wicket", "faces", "web", "framework", "portal",
        "django", "tomcat", "httpd", "server", "servlet", "jsp", "sling",
        "camel", "cxf", "axis", "servicemix", "karaf", "geronimo",
        "openwebbeans", "tomee", "nifi", "cloudstack", "turbine", "velocity",
        "freemarker", "tiles", "guacamole", "rest", "api", "mvc",
    ),
    "Domain-Specific Libraries": (
        "pdf", "xml", "codec", "math", "image", "audio", "video", "compress",
        "crypt", "nlp", "search", "lucene", "solr", "tika", "poi", "opennlp",
        "xerces", "xalan", "batik", "fop", "chemistry", "mahout",
        "openoffice", "spamassassin", "geo", "spatial", "learning", "ai",
        "machine learning",
    ),
    "Core Libraries/Utilities": (
        "commons", "lib", "util", "log", "io", "net", "lang", "collections",
        "runtime", "apr", "mina", "netty", "thrift", "jmeter", "logging",
        "serializer",
    ),
}
