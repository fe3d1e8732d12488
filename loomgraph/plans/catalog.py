"""Registered graph queries: name -> Spark callable, and name -> DuckDB SQL.

The driver's tables play a workspace: nations are projects (tags: their region), suppliers are files,
(supplier, part) pairs are exported symbols, lineitems are uses from the customer's nation, orders of
status P are test code, returned lines are lazy, pages are templates and their urls paths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import markup, paths, text
from loomgraph.operators import findings, graph, usage
from loomgraph.operators.links import rewritten
from loomgraph.operators.prefix_join import project_of
from loomgraph.operators.resolve import resolve
from loomgraph.operators.within import alive_within
from loomgraph.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its DuckDB twin."""

    def keep(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return keep


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a use: from_project, to_project, the symbol, and what filters need."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("from_project"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("to_project"))
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select("from_project", "to_project", F.col("l_partkey").alias("symbol"), "l_suppkey", "l_quantity", "l_returnflag", "o_orderstatus")
    )


USES = """
  uses AS (SELECT c_nationkey AS from_project, s_nationkey AS to_project, l_partkey AS symbol, l_suppkey, l_quantity, l_returnflag, o_orderstatus
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
"""


@query(
    f"""WITH {USES} SELECT from_project, to_project, count(*) AS refs, bool_or(l_returnflag = 'R') AS lazy, count(DISTINCT symbol) AS symbols
    FROM uses WHERE from_project <> to_project GROUP BY 1, 2"""
)
def dep_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References from project to project, the number of symbols they use, and whether any is lazy."""
    return usage.dependency_matrix(_uses(spark, sf_dir), F.col("l_returnflag") == "R")


@query(f"WITH {USES} SELECT from_project, to_project, symbol, count(*) AS refs FROM uses WHERE from_project <> to_project GROUP BY 1, 2, 3")
def dep_matrix_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by symbol."""
    return _uses(spark, sf_dir).where("from_project <> to_project").groupBy("from_project", "to_project", "symbol").agg(F.count("*").alias("refs"))


@query(
    f"""WITH {USES}, deps AS (SELECT from_project, to_project FROM uses WHERE l_quantity >= 50 AND l_returnflag = 'R' AND from_project <> to_project GROUP BY 1, 2 HAVING count(*) >= 2),
    ca AS (SELECT to_project AS k, count(DISTINCT from_project) AS n FROM deps GROUP BY 1), ce AS (SELECT from_project AS k, count(DISTINCT to_project) AS n FROM deps GROUP BY 1)
    SELECT n_nationkey AS project, n_name AS name, coalesce(ca.n, 0) AS afferent, coalesce(ce.n, 0) AS efferent,
           CASE WHEN coalesce(ca.n, 0) + coalesce(ce.n, 0) = 0 THEN 0.0::DOUBLE ELSE round(coalesce(ce.n, 0)::DOUBLE / (coalesce(ca.n, 0) + coalesce(ce.n, 0)), 9) END AS instability
    FROM nation LEFT JOIN ca ON ca.k = n_nationkey LEFT JOIN ce ON ce.k = n_nationkey"""
)
def coupling_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coupling and instability of every project over its stronger lazy dependencies."""
    deps = _uses(spark, sf_dir).where("l_quantity >= 50 and l_returnflag = 'R' and from_project <> to_project").groupBy("from_project", "to_project").agg(F.count("*").alias("n")).where("n >= 2")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project"), F.col("n_name").alias("name"))
    return usage.coupling(nations, deps, "project").withColumn("instability", F.round("instability", 9))


@query(f"WITH {USES} SELECT l_suppkey, symbol, count(*) FILTER (o_orderstatus <> 'P') AS prod_uses, count(*) FILTER (o_orderstatus = 'P') AS test_uses FROM uses GROUP BY 1, 2")
def symbol_usage_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production and test uses of each symbol."""
    return usage.usage_index(_uses(spark, sf_dir), ["l_suppkey", "symbol"], F.col("o_orderstatus") == "P")


@query("SELECT p_partkey AS symbol, p_name AS name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 50)")
def unused_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no large line uses."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_name").alias("name"))
    return usage.never_used(parts, table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("symbol")), ["symbol"])


@query(
    """SELECT l_partkey AS symbol, count(*) AS test_uses FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 50
    GROUP BY 1 HAVING count(*) FILTER (o_orderstatus <> 'P') = 0"""
)
def test_only_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that only test code uses."""
    uses = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return usage.usage_index(uses.withColumnRenamed("l_partkey", "symbol"), ["symbol"], F.col("o_orderstatus") == "P").where("prod_uses = 0").select("symbol", "test_uses")


@query(
    """WITH u AS (SELECT l_partkey AS k, count(*) FILTER (o_orderstatus <> 'P') AS prod, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 49 GROUP BY 1)
    SELECT p_partkey AS symbol, CASE WHEN p_type LIKE 'PROMO%' THEN 'skipped' WHEN prod > 0 THEN 'used' WHEN p_size >= 40 THEN 'export_only' WHEN n > 0 THEN 'test_only' ELSE 'unused' END AS class
    FROM part LEFT JOIN u ON k = p_partkey"""
)
def liveness_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's class, the first rule that holds: skipped kinds, used, alive at home, tests only, unused."""
    uses = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    index = usage.usage_index(uses.withColumnRenamed("l_partkey", "symbol"), ["symbol"], F.col("o_orderstatus") == "P")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), "p_type", "p_size")
    kind = (
        F.when(F.col("p_type").startswith("PROMO"), "skipped").when(F.col("prod_uses") > 0, "used").when(F.col("p_size") >= 40, "export_only")
        .when(F.col("test_uses") > 0, "test_only").otherwise("unused")
    )
    return parts.join(index, "symbol", "left").select("symbol", kind.alias("class"))


@query(
    """WITH u AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity >= 45), ok AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_discount >= 0.01)
    SELECT DISTINCT l_suppkey AS entity FROM u x WHERE NOT EXISTS (
      SELECT 1 FROM u y WHERE y.l_suppkey = x.l_suppkey AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.l_suppkey = y.l_suppkey AND ok.l_partkey = y.l_partkey))"""
)
def wired_not_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers all of whose large lines are for parts that they also sell at a discount."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("place"), "l_quantity", "l_discount")
    return usage.all_uses_within(lines.where("l_quantity >= 45").select("entity", "place").distinct(), lines.where("l_discount >= 0.01").select("entity", "place").distinct(), "entity", ["place"])


@query("SELECT c_custkey AS node FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice >= 50000)")
def orphan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that no large pending order leads to."""
    edges = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_totalprice >= 50000").select(F.col("o_custkey").alias("dst"))
    return graph.orphans(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node")), edges)


@query(
    f"""WITH {USES} SELECT l_suppkey, symbol, to_project AS home, 0::BIGINT AS internal, max(from_project) AS to_project, count(*) AS external
    FROM uses WHERE l_quantity >= 50 GROUP BY 1, 2, 3 HAVING count(*) FILTER (from_project = uses.to_project) = 0 AND count(DISTINCT from_project) = 1"""
)
def move_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that one other project uses and their own doesn't."""
    uses = _uses(spark, sf_dir).where("l_quantity >= 50").select("l_suppkey", "symbol", F.col("to_project").alias("home"), F.col("from_project").alias("project"))
    return usage.single_consumers(uses, ["l_suppkey", "symbol"])


RULES = (("AFRICA", ("AFRICA", "EUROPE")), ("ASIA", ("ASIA",)), ("EUROPE", ("*",)), ("AMERICA", ("AMERICA", "ASIA", "EUROPE")))


@query(
    f"""WITH {USES}, tags AS (SELECT n_nationkey AS k, r_name AS tag FROM nation JOIN region ON n_regionkey = r_regionkey),
    rules(source_tag, allowed) AS (VALUES {', '.join(f"('{s}', {list(a)!r})" for s, a in RULES)}),
    deps AS (SELECT DISTINCT from_project, to_project FROM uses WHERE l_quantity >= 50 AND from_project <> to_project)
    SELECT from_project, to_project, source_tag FROM deps JOIN tags f ON f.k = from_project JOIN rules ON source_tag = f.tag JOIN tags t ON t.k = to_project
    WHERE NOT (list_contains(allowed, '*') OR list_has_any(allowed, [t.tag]))"""
)
def boundary_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies across regions that the rules don't allow."""
    deps = _uses(spark, sf_dir).where("l_quantity >= 50 and from_project <> to_project")
    projects = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("name"), F.array("r_name").alias("tags"))
    rules = spark.createDataFrame([(s, list(a)) for s, a in RULES], "source_tag string, allowed array<string>")
    return usage.boundary_violations(deps, projects, rules).select("from_project", "to_project", "source_tag")


FINDINGS_SQL = """
    SELECT 'unused:' || p_partkey AS key FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= {q})
    UNION SELECT 'orphan:' || s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= {q} AND l_discount >= 0.1 AND l_tax >= 0.08)
    UNION SELECT 'boundary:' || c_nationkey || '->' || o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= {p}
    UNION SELECT 'test-only:' || l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= {q} GROUP BY l_partkey HAVING count(*) FILTER (o_orderstatus <> 'P') = 0
"""


def _findings(spark: SparkSession, sf_dir: str, q: int, p: int) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= q)
    orders = table(spark, sf_dir, "orders")
    unused = usage.never_used(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), lines.select(F.col("l_partkey").alias("k")), ["k"])
    orphan = usage.never_used(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), lines.where("l_discount >= 0.1 and l_tax >= 0.08").select(F.col("l_suppkey").alias("k")), ["k"])
    across = orders.where(F.col("o_totalprice") >= p).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    tests = usage.usage_index(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), ["l_partkey"], F.col("o_orderstatus") == "P").where("prod_uses = 0")
    keys = [
        unused.select(F.format_string("unused:%d", "k").alias("key")), orphan.select(F.format_string("orphan:%d", "k").alias("key")),
        across.select(F.format_string("boundary:%d->%s", "c_nationkey", "o_orderpriority").alias("key")), tests.select(F.format_string("test-only:%d", "l_partkey").alias("key")),
    ]
    out = keys[0]
    for k in keys[1:]:
        out = out.unionByName(k)
    return out.distinct()


@query(FINDINGS_SQL.format(q=50, p=400000))
def finding_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of findings of four kinds, each once."""
    return _findings(spark, sf_dir, 50, 400000)


@query(f"({FINDINGS_SQL.format(q=50, p=300000)}) EXCEPT ({FINDINGS_SQL.format(q=49, p=450000)})")
def baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that a laxer baseline lacks."""
    return usage.new_findings(_findings(spark, sf_dir, 50, 300000), _findings(spark, sf_dir, 49, 450000))


@query(
    f"""SELECT CASE WHEN starts_with(key, 'unused:') OR starts_with(key, 'unused-import:') OR starts_with(key, 'not-rendered:') OR starts_with(key, 'orphan:') THEN 'unused'
    WHEN starts_with(key, 'cycle:') OR starts_with(key, 'project-cycle:') THEN 'cycles' WHEN starts_with(key, 'boundary:') THEN 'boundaries' ELSE 'other' END AS category, count(*) AS findings
    FROM ({FINDINGS_SQL.format(q=50, p=400000)}) GROUP BY 1"""
)
def fail_policy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by policy category."""
    return _findings(spark, sf_dir, 50, 400000).groupBy(usage.fail_category(F.col("key")).alias("category")).agg(F.count("*").alias("findings"))


@query(
    f"""WITH {USES} SELECT from_project, l_suppkey, via, test, count(*) AS uses FROM (
      SELECT from_project, l_suppkey, 'Import' AS via, o_orderstatus = 'P' AS test FROM uses WHERE symbol = 7 AND l_returnflag = 'N'
      UNION ALL SELECT from_project, l_suppkey, 'LazyLoad', o_orderstatus = 'P' FROM uses WHERE symbol = 7 AND l_returnflag = 'R'
      UNION ALL SELECT from_project, l_suppkey, 'Jsx', o_orderstatus = 'P' FROM uses WHERE symbol = 7 AND l_returnflag = 'A' AND l_quantity >= 25
      UNION ALL SELECT from_project, l_suppkey, 'Template', false FROM uses WHERE symbol = 7 AND l_returnflag = 'A' AND l_quantity < 25) GROUP BY 1, 2, 3, 4"""
)
def usages_of_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All uses of one symbol by way of use; its name is pushed down to the scan."""
    arms = (("Import", "l_returnflag = 'N'"), ("LazyLoad", "l_returnflag = 'R'"), ("Jsx", "l_returnflag = 'A' and l_quantity >= 25"), ("Template", "l_returnflag = 'A' and l_quantity < 25"))
    via = F.coalesce(*[F.when(F.expr(c), v) for v, c in arms])  # the arms exclude each other: one pass instead of a union of four
    declared = table(spark, sf_dir, "part").where("p_partkey = 7").select(F.col("p_partkey").alias("symbol"))
    uses = usage.uses_of(_uses(spark, sf_dir).withColumn("via", via).where("via is not null"), declared, "symbol", F.col("o_orderstatus") == "P")
    return uses.groupBy("from_project", "l_suppkey", "via", "test").agg(F.count("*").alias("uses"))


@query(
    """SELECT k AS symbol, arg_max(kind, prio) AS kind FROM (
      SELECT p_partkey AS k, 'Class' AS kind, 0 AS prio FROM part UNION ALL SELECT DISTINCT l_partkey, 'Component', 1 FROM lineitem WHERE l_quantity >= 50
      UNION ALL SELECT DISTINCT l_partkey, 'Service', 2 FROM lineitem WHERE l_discount >= 0.1 AND l_quantity >= 48) GROUP BY 1"""
)
def declaration_kind_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's kind, entity kinds overriding export kinds."""
    lines = table(spark, sf_dir, "lineitem")
    arms = [
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), F.lit("Class").alias("kind"), F.lit(0).alias("prio")),
        lines.where("l_quantity >= 50").select(F.col("l_partkey").alias("symbol"), F.lit("Component").alias("kind"), F.lit(1).alias("prio")),
        lines.where("l_discount >= 0.1 and l_quantity >= 48").select(F.col("l_partkey").alias("symbol"), F.lit("Service").alias("kind"), F.lit(2).alias("prio")),
    ]
    return usage.by_priority(arms[0].unionByName(arms[1]).unionByName(arms[2]), ["symbol"], "kind", "prio")


@query("SELECT event_type AS component, prop, count(*) AS uses FROM (SELECT event_type, unnest(json_keys(props)) AS prop FROM events) GROUP BY 1, 2")
def jsx_prop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each property is passed to each component."""
    props = F.explode(F.json_object_keys("props"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("component"), props.alias("prop")).groupBy("component", "prop").agg(F.count("*").alias("uses"))


@query("SELECT file, target FROM (SELECT l_orderkey AS file, l_partkey AS target, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem WHERE l_quantity >= 10) WHERE rn = 1")
def first_match_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate, by rank, that exists."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 10").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("target"), F.struct("l_linenumber", "l_partkey").alias("rank"))
    return usage.first_by_rank(lines, ["file"], "target", "rank")


_URL = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query(
    f"""WITH p AS (SELECT page_id, {_URL} AS path FROM pages), hosts AS (SELECT DISTINCT regexp_extract(path, '^[^/]+', 0) AS root FROM p),
    roots AS (SELECT root, 'host' AS kind FROM hosts UNION ALL SELECT root || '/en', 'english' FROM hosts UNION ALL SELECT root || '/e', 'decoy' FROM hosts)
    SELECT page_id, path, root AS project, kind FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(root) DESC) AS rn FROM p JOIN roots ON path = root OR starts_with(path, root || '/')) WHERE rn = 1"""
)
def project_of_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's nearest enclosing root, by whole path steps."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))
    hosts = pages.select(F.regexp_extract("path", "^[^/]+", 0).alias("root")).distinct()
    roots = hosts.select(F.inline(F.array(*[F.struct(F.concat("root", F.lit(s)).alias("root"), F.lit(k).alias("kind")) for s, k in (("", "host"), ("/en", "english"), ("/e", "decoy"))])))
    found = project_of(pages, roots.withColumn("both", F.struct("root", "kind")), value="both")
    return found.where("project is not null").select("page_id", "path", F.col("project.root").alias("project"), F.col("project.kind").alias("kind"))


@query(
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/\./', '/', 'g'), '/+$', '') AS path,
    regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS name FROM pages"""
)
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised paths of urls: each goes a step down and back, which has to vanish."""
    plain = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    detour = F.concat(F.lit("./x/../"), F.replace(plain, F.lit("/"), F.lit("/./y/../")))
    return table(spark, sf_dir, "pages").select("page_id", paths.normalize_path(detour).alias("path"), paths.basename(F.regexp_replace("url", "[?#].*$", "")).alias("name"))


_STEMS = "|".join(paths.CONVENTION_STEMS)


@query(
    rf"""WITH n AS (SELECT page_id, page_id % 7 AS m, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/.]*)[^/]*$', 1) AS s FROM pages),
    f AS (SELECT page_id, CASE m WHEN 0 THEN s || '.spec.ts' WHEN 1 THEN s || '_test.ts' WHEN 2 THEN 'page.tsx' WHEN 3 THEN s || '.config.js' WHEN 4 THEN 'main.ts' WHEN 5 THEN 'index.ts' ELSE s || '.d.ts' END AS name FROM n)
    SELECT page_id, name, regexp_matches(name, '\.(spec|test)\.|_test\.ts$') AS test,
      name IN ('main.ts', 'main.tsx', 'polyfills.ts') OR regexp_matches(name, '\.(config|setup|stories)\.|^global-(setup|teardown)\.|^({_STEMS})\.(ts|tsx|js|jsx)$') AS entry,
      ends_with(name, '.d.ts') AS ambient, name = 'index.ts' AS barrel FROM f"""
)
def entry_and_test_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What file names made of the urls' say: tests, entries, declarations, barrels."""
    s = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), r"([^/.]*)[^/]*$", 1)
    m = F.col("page_id") % 7
    name = (
        F.when(m == 0, F.concat(s, F.lit(".spec.ts"))).when(m == 1, F.concat(s, F.lit("_test.ts"))).when(m == 2, "page.tsx")
        .when(m == 3, F.concat(s, F.lit(".config.js"))).when(m == 4, "main.ts").when(m == 5, "index.ts").otherwise(F.concat(s, F.lit(".d.ts")))
    )
    named = table(spark, sf_dir, "pages").select("page_id", name.alias("name"))
    path = F.concat(F.lit("src/"), "name")
    return named.select(
        "page_id", "name", paths.is_test_file(path).alias("test"), paths.is_entry_file(path).alias("entry"), paths.is_ambient(path).alias("ambient"),
        paths.is_barrel(path, F.array().cast("array<string>")).alias("barrel"),
    )


@query(
    r"""WITH s AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '@' || p ELSE p END AS spec FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS p FROM pages))
    SELECT page_id, spec, regexp_extract(spec, '^(@[^/]+/[^/]+|[^/]+)', 1) AS package, nullif(regexp_extract(spec, '^(?:@[^/]+/[^/]+|[^@/][^/]*)/(.+)$', 1), '') AS subpath,
    CASE WHEN starts_with(spec, '@th') THEN 'Internal' ELSE 'External' END AS scope, try_cast(nullif(regexp_extract(spec, '(\d+)', 1), '') AS INTEGER) AS major FROM s"""
)
def specifier_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package, rest, scope and first number of specifiers made of urls."""
    plain = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    spec = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("@"), plain)).otherwise(plain).alias("spec"))
    aliases = spark.createDataFrame([("p", "@th*", "none/*", 0, "")], "project string, alias string, target string, ord int, base_url string")
    files, packages = spark.createDataFrame([], "path string"), spark.createDataFrame([], "package string, dir string, entry string")
    scopes = resolve(spec.select(F.lit("a.ts").alias("path"), F.col("spec").alias("source"), F.lit("p").alias("project")), files, aliases, packages)
    return spec.join(scopes.select(F.col("source").alias("spec"), "scope"), "spec").select(
        "page_id", "spec", paths.package_of(F.col("spec")).alias("package"), paths.subpath_of(F.col("spec")).alias("subpath"), "scope", text.version_major(F.col("spec")).alias("major"),
    )


_PAGE_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/*([?#].*)?$', '')"


def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, path, host, rest, inner): pages as paths; ``rest`` is what follows the host, ``inner`` what follows its english part."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(_PAGE_PATH).alias("path")).withColumn("host", F.regexp_extract("path", "^[^/]+", 0))
    return pages.select("*", F.regexp_extract("path", "^[^/]+/(.+)$", 1).alias("rest"), F.regexp_extract("path", "^[^/]+/en/(.+)$", 1).alias("inner"))


PAGE_PATHS = f"""p AS (SELECT page_id, path, regexp_extract(path, '^[^/]+', 0) AS host, regexp_extract(path, '^[^/]+/(.+)$', 1) AS rest, regexp_extract(path, '^[^/]+/en/(.+)$', 1) AS inner_part
      FROM (SELECT page_id, {_PAGE_PATH} AS path FROM pages))"""


@query(
    f"""WITH {PAGE_PATHS}, files AS (SELECT 'all/' || rest || '.ts' AS f FROM p WHERE page_id % 2 = 0 AND rest <> '' UNION SELECT 'english/' || inner_part || '/index.tsx' FROM p WHERE page_id % 3 = 0 AND inner_part <> '' UNION SELECT 'only/' || host || '.ts' FROM p)
    SELECT page_id, path AS source, coalesce(e.f, o.f, a.f) AS resolved FROM p LEFT JOIN files e ON inner_part <> '' AND e.f = 'english/' || inner_part || '/index.tsx'
      LEFT JOIN files o ON page_id % 5 = 0 AND o.f = 'only/' || host || '.ts' LEFT JOIN files a ON rest <> '' AND a.f = 'all/' || rest || '.ts'"""
)
def alias_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page's path means as a specifier by aliases of every host: the longest that leads to a file.

    Every host is a folder by a wildcard of its own and another for its english part; every fifth page lies in a project
    in which all that begins with the host's name means one file, as an alias shorter than the english one and longer than the other.
    """
    pages = _page_paths(spark, sf_dir)
    project = F.when(F.col("page_id") % 5 == 0, "fifth").otherwise("rest")
    alias = lambda project, name, target: F.struct(F.lit(project).alias("project"), name.alias("alias"), target.alias("target"))
    every = lambda p: [alias(p, F.concat("host", F.lit("/*")), F.lit("all/*")), alias(p, F.concat("host", F.lit("/en/*")), F.lit("english/*"))]
    star = alias("fifth", F.concat("host", F.lit("/**")), F.concat(F.lit("only/"), "host"))
    aliases = pages.select("host").distinct().select(F.inline(F.array(*every("fifth"), *every("rest"), star))).select("*", F.lit(0).alias("ord"), F.lit("").alias("base_url"))
    made = F.array(F.when((F.col("page_id") % 2 == 0) & (F.col("rest") != ""), F.concat(F.lit("all/"), "rest", F.lit(".ts"))), F.when((F.col("page_id") % 3 == 0) & (F.col("inner") != ""), F.concat(F.lit("english/"), "inner", F.lit("/index.tsx"))), F.concat(F.lit("only/"), "host", F.lit(".ts")))
    files = pages.select(F.explode(F.array_compact(made)).alias("path")).distinct()
    packages = spark.createDataFrame([], "package string, dir string, entry string")
    wanted = pages.select(F.col("page_id").cast("string").alias("path"), F.col("path").alias("source"), project.alias("project"))
    found = resolve(wanted, files, aliases, packages)
    return found.select(F.col("path").cast("long").alias("page_id"), "source", "resolved")


@query(
    f"""WITH RECURSIVE {PAGE_PATHS}, hosts AS (SELECT host, row_number() OVER (ORDER BY host) AS i, lead(host) OVER (ORDER BY host) AS after, first_value(host) OVER (ORDER BY host) AS start FROM (SELECT DISTINCT host FROM p)),
    links AS (SELECT host AS link, CASE WHEN i % 7 = 0 THEN 'store/' || host WHEN after IS NULL THEN NULL ELSE after END AS target FROM hosts WHERE i % 4 <> 1
      UNION ALL SELECT 'store/' || host, CASE WHEN i % 14 = 0 THEN host ELSE 'kept/' || host END FROM hosts WHERE i % 7 = 0 AND i % 4 <> 1),
    l AS (SELECT * FROM links WHERE target IS NOT NULL),
    walk(path, now, rest, hops) AS (SELECT DISTINCT path, host, substr(path, length(host) + 1), 0 FROM p UNION ALL SELECT walk.path, target, rest, hops + 1 FROM walk JOIN l ON now = link WHERE hops < 60)
    SELECT path, CASE WHEN max(hops) >= 60 THEN NULL ELSE max_by(now || rest, hops) END AS real FROM walk GROUP BY path"""
)
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pages' paths lead if hosts link to the next host or into a store, whose folders link on or back: chains and rings."""
    pages = _page_paths(spark, sf_dir)
    hosts = pages.select("host").distinct()
    order = Window.orderBy("host")  # one row a host
    hosts = hosts.select("host", F.row_number().over(order).alias("i"), F.lead("host").over(order).alias("after"))
    inside = F.concat(F.lit("store/"), "host")
    link = lambda a, b: F.struct(a.alias("link"), b.alias("target"))
    made = F.array(
        link(F.col("host"), F.when(F.col("i") % 7 == 0, inside).otherwise(F.col("after"))),
        F.when(F.col("i") % 7 == 0, link(inside, F.when(F.col("i") % 14 == 0, F.col("host")).otherwise(F.concat(F.lit("kept/"), "host")))),
    )
    links = hosts.where("i % 4 <> 1").select(F.inline(F.array_compact(made))).where("target is not null")
    return rewritten(pages.select("path"), links)


@query(r"SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<([A-Za-z0-9_-]+)[^>]*>', 1)) AS tag FROM pages) GROUP BY 1")
def template_tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by tag."""
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(markup.elements(F.col("html"))).alias("e"))
    return found.groupBy(F.col("e.tag").alias("tag")).agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


SELECTORS = (("AdBox", "div.ad, aside[ad]"), ("Link", "a[href]:not([download])"), ("Title", "h1"), ("Any", "[charset],  .ad"), ("None", "b.ad[x=y]"))


@query(
    r"""WITH e AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<[A-Za-z0-9_-]+[^>]*>') AS tags FROM pages), t AS (SELECT page_id, unnest(tags) AS tag FROM e)
    SELECT DISTINCT page_id, target FROM (
      SELECT page_id, CASE WHEN regexp_matches(tag, '^<div .*class="ad"') THEN 'AdBox' END AS target FROM t UNION ALL SELECT page_id, CASE WHEN regexp_matches(tag, '^<a .*href=') THEN 'Link' END FROM t
      UNION ALL SELECT page_id, CASE WHEN regexp_matches(tag, '^<h1[ >]') THEN 'Title' END FROM t UNION ALL SELECT page_id, CASE WHEN regexp_matches(tag, 'charset=|class="ad"') THEN 'Any' END FROM t) WHERE target IS NOT NULL"""
)
def selector_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which selectors match an element of each page; alternatives join on their element, the rest on an attribute or class."""
    registry = spark.createDataFrame(list(SELECTORS), "target string, selector string").select("target", F.explode(markup.parse_selector(F.col("selector"))).alias("s"))
    anchor = F.coalesce(F.concat(F.lit("e:"), "s.element"), F.concat(F.lit("a:"), F.get("s.attributes", F.lit(0))), F.concat(F.lit("c:"), F.get("s.classes", F.lit(0))))
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(markup.elements(F.col("html"))).alias("e")).distinct()
    marks = F.concat(F.array(F.concat(F.lit("e:"), "e.tag")), F.transform("e.attributes", lambda a: F.concat(F.lit("a:"), a)), F.transform("e.classes", lambda c: F.concat(F.lit("c:"), c)))
    joined = found.withColumn("anchor", F.explode(marks)).join(registry.withColumn("anchor", anchor), "anchor")
    return joined.where(markup.matches(F.array("s"), F.col("e"))).select("page_id", "target").distinct()


@query(
    r"""WITH t AS (SELECT doc_id, '{{ a || b | ' || regexp_extract(text, '[A-Za-z0-9]+') || ' }} x {{ v | date : 1 | ' || lang || ' }}' AS t FROM documents),
    e AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?s)\{\{(.*?)\}\}', 1)) AS e FROM t)
    SELECT pipe, count(*) AS uses FROM (SELECT unnest(regexp_extract_all(replace(e, '||', '  '), '\|\s*([A-Za-z0-9_$]+)', 1)) AS pipe FROM e) GROUP BY 1"""
)
def interpolation_pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes by name in interpolations around each document's first word."""
    word = F.regexp_extract("text", "[A-Za-z0-9]+", 0)
    html = F.concat(F.lit("{{ a || b | "), word, F.lit(" }} x {{ v | date : 1 | "), "lang", F.lit(" }}"))
    return table(spark, sf_dir, "documents").select(F.explode(markup.interpolation_pipes(html)).alias("pipe")).groupBy("pipe").agg(F.count("*").alias("uses"))


@query(
    """WITH r AS (SELECT event_id, event_type, CASE event_id % 8 WHEN 0 THEN '[(' || event_type || ')]' WHEN 1 THEN '[' || event_type || ']' WHEN 2 THEN '[attr.' || event_type || ']' WHEN 3 THEN '(' || event_type || ')'
      WHEN 4 THEN '*' || event_type WHEN 5 THEN '#' || event_type WHEN 6 THEN '@' || event_type ELSE event_type END AS raw FROM events)
    SELECT raw, CASE WHEN event_id % 8 IN (5, 6) THEN NULL ELSE event_type END AS name, event_id % 8 < 5 AS binding, count(*) AS n FROM r GROUP BY 1, 2, 3"""
)
def attr_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute names freed of binding marks."""
    m, name = F.col("event_id") % 8, F.col("event_type")
    raw = name
    for k, before, after in ((0, "[(", ")]"), (1, "[", "]"), (2, "[attr.", "]"), (3, "(", ")"), (4, "*", ""), (5, "#", ""), (6, "@", "")):
        raw = F.when(m == k, F.concat(F.lit(before), name, F.lit(after))).otherwise(raw)
    marked = table(spark, sf_dir, "events").select(raw.alias("raw"))
    return marked.groupBy("raw", markup.attribute_name(F.col("raw")).alias("name"), markup.is_binding(F.col("raw")).alias("binding")).agg(F.count("*").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, '//' || event_type AS path FROM events")
def jsonc_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the events' JSON after comments and trailing commas were put in and taken out."""
    dirty = F.concat(F.lit('{ // "k": 0\n "path": "//'), "event_type", F.lit('", /* , */ "props": '), F.regexp_replace("props", r"\}$", ", }"), F.lit(" , }"))
    parsed = F.from_json(text.strip_jsonc(dirty), "path string, props struct<k: bigint>")
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("j")).select("event_id", F.col("j.props.k").alias("k"), F.col("j.path").alias("path"))


def _copurchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return graph.edge_set(lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")))


COPURCHASES = """edges AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst
      FROM lineitem) WHERE dst IS NOT NULL)"""


@query(f"WITH {COPURCHASES} SELECT src, count(*) AS targets, min(dst) AS first_target, max(dst) AS last_target FROM edges GROUP BY 1")
def copurchase_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successors of each part in the orders' lines."""
    out = graph.adjacency(_copurchases(spark, sf_dir))
    return out.select("src", F.size("targets").cast("long").alias("targets"), F.element_at("targets", 1).alias("first_target"), F.element_at("targets", -1).alias("last_target"))


@query(f"WITH RECURSIVE {COPURCHASES}, r(node) AS (SELECT dst FROM edges JOIN part ON src = p_partkey AND p_size >= 49 UNION SELECT dst FROM r JOIN edges ON src = node) SELECT node FROM r")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that the largest parts lead to over any number of edges."""
    seeds = table(spark, sf_dir, "part").where("p_size >= 49").select(F.col("p_partkey").alias("node"))
    return graph.reachable(_copurchases(spark, sf_dir), seeds)


@query(
    f"""WITH RECURSIVE {COPURCHASES}, r(src, n) AS (SELECT src, dst FROM edges UNION SELECT r.src, dst FROM r JOIN edges ON r.n = edges.src)
    SELECT a.src AS node, min(a.n) AS component FROM r a JOIN r b ON a.src = b.n AND a.n = b.src GROUP BY 1"""
)
def scc_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts on cycles and the smallest part of their cycle group."""
    return graph.scc(_copurchases(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {COPURCHASES}, half AS (SELECT src, dst FROM edges WHERE src < dst OR (src % 4 = 0 AND src - dst < 40)),
    r(src, n) AS (SELECT src, dst FROM half UNION SELECT r.src, dst FROM r JOIN half ON r.n = half.src),
    c AS (SELECT a.src AS node, min(a.n) AS component FROM r a JOIN r b ON a.src = b.n AND a.n = b.src GROUP BY 1)
    SELECT DISTINCT coalesce(a.component, src) AS src, coalesce(b.component, dst) AS dst FROM half LEFT JOIN c a ON a.node = src LEFT JOIN c b ON b.node = dst
    WHERE coalesce(a.component, src) <> coalesce(b.component, dst)"""
)
def condensation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The acyclic graph of cycle groups, over edges to larger parts and some short ones back."""
    edges = graph.kept(_copurchases(spark, sf_dir).where("src < dst or (src % 4 = 0 and src - dst < 40)"))
    return graph.condensed(edges, graph.scc(edges))


@query(
    f"""WITH RECURSIVE {USES}, edges AS (SELECT from_project AS src, to_project AS dst FROM uses WHERE l_quantity >= 49 AND l_returnflag = 'R' AND from_project <> to_project GROUP BY 1, 2 HAVING count(*) >= 3),
    r(src, n) AS (SELECT src, dst FROM edges UNION SELECT r.src, dst FROM r JOIN edges ON r.n = edges.src),
    c AS (SELECT a.src AS node, min(a.n) AS component FROM r a JOIN r b ON a.src = b.n AND a.n = b.src GROUP BY 1)
    SELECT component, count(*) AS size, string_agg(node::VARCHAR, '->' ORDER BY node) AS members FROM c GROUP BY 1"""
)
def project_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of projects that depend on each other in circles."""
    return _circles(spark, sf_dir, "R").select("component", "size", F.array_join("members", "->").alias("members"))


def _circles(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    """(component, size, members) of the circles that the large lines of a flag make."""
    large = _uses(spark, sf_dir).where((F.col("l_quantity") >= 49) & (F.col("l_returnflag") == flag) & (F.col("from_project") != F.col("to_project")))
    deps = large.groupBy("from_project", "to_project").agg(F.count("*").alias("n")).where("n >= 3")
    groups = graph.cycle_groups(graph.scc(deps.select(F.col("from_project").alias("src"), F.col("to_project").alias("dst"))))
    return groups.select("component", "size", F.transform("members", lambda m: m.cast("string")).alias("members"))


@query(
    """WITH RECURSIVE e AS (SELECT l_orderkey AS f, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem),
    r(f, node) AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity >= 49 UNION SELECT r.f, dst FROM r JOIN e ON r.f = e.f AND r.node = e.src WHERE dst IS NOT NULL)
    SELECT f AS file, count(*) AS alive FROM r GROUP BY 1"""
)
def liveness_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names alive in each file: its seeds and all they refer to within the file."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    refs = lines.select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    alive = alive_within(refs, lines.where("l_quantity >= 49").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("node")), "file")
    return alive.groupBy("file").agg(F.count("*").alias("alive"))


@query("SELECT source AS scope, count(*) AS files, count(l.doc_id) AS resolved, count(*) - count(l.doc_id) AS unresolved FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def unresolved_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with and without a label by source."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("known"))
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    return joined.groupBy(F.col("source").alias("scope")).agg(F.count("*").alias("files"), F.count("known").alias("resolved"), F.count_if(F.col("known").isNull()).alias("unresolved"))


@query("SELECT specifier, count(*) AS files FROM (SELECT regexp_extract(url, '://([^/]+)', 1) AS specifier FROM pages) GROUP BY 1 ORDER BY files DESC, specifier LIMIT 10")
def topk_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten hosts with most pages: the report's preview is a top ten."""
    hosts = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("specifier"))
    return hosts.groupBy("specifier").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "specifier").limit(10)


@query("SELECT facet, value, count(*) AS n FROM (SELECT 'lang' AS facet, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) GROUP BY 1, 2")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by value of each facet, in one scan."""
    facets = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in ("lang", "source")])
    return table(spark, sf_dir, "documents").select(F.inline(facets)).groupBy("facet", "value").agg(F.count("*").alias("n"))


@query(
    f"""WITH {USES}, names AS (SELECT n_nationkey AS k, regexp_replace(n_name, '[^A-Za-z0-9]', '_', 'g') AS id FROM nation),
    d AS (SELECT from_project, to_project, count(*) AS refs, bool_or(l_quantity >= 50) AS lazy FROM uses WHERE from_project <> to_project GROUP BY 1, 2)
    SELECT '  ' || f.id || (CASE WHEN lazy THEN ' -.->|' ELSE ' -->|' END) || refs || '| ' || t.id AS line FROM d JOIN names f ON f.k = from_project JOIN names t ON t.k = to_project"""
)
def mermaid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the project diagram as text."""
    names = table(spark, sf_dir, "nation").select("n_nationkey", text.node_id(F.col("n_name")).alias("id"))
    deps = usage.dependency_matrix(_uses(spark, sf_dir), F.col("l_quantity") >= 50)
    deps = deps.join(names.toDF("from_project", "f"), "from_project").join(names.toDF("to_project", "t"), "to_project")
    return deps.select(text.mermaid_line(F.col("f"), F.col("t"), F.col("refs"), F.col("lazy")).alias("line"))


@query(
    """SELECT 'unused-export' AS rule, 'note' AS level, p_name AS message, p_partkey AS location FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 50)
    UNION ALL SELECT 'orphan-file', 'warning', c_name, c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice >= 50000)"""
)
def sarif_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as rows of a SARIF report."""
    unused = unused_symbols(spark, sf_dir).select(F.lit("unused-export").alias("rule"), F.lit("note").alias("level"), F.col("name").alias("message"), F.col("symbol").alias("location"))
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), "c_name")
    lost = orphan_nodes(spark, sf_dir).join(names, "node").select(F.lit("orphan-file").alias("rule"), F.lit("warning").alias("level"), F.col("c_name").alias("message"), F.col("node").alias("location"))
    return unused.unionByName(lost)


@query(r"SELECT page_id, replace(replace(replace(html, '&', '\u0026'), '<', '\u003c'), '>', '\u003e') AS safe FROM pages")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that may stand within a script."""
    return table(spark, sf_dir, "pages").select("page_id", text.html_safe(F.col("html")).alias("safe"))


def _found(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of all nine analyses that report findings, by the names that ``findings`` knows."""
    at = lambda kind, c: F.concat(F.lit(f"{kind}/"), F.col(c).cast("string")).alias("file")
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string")).alias("name")
    return {
        "unused_exports": unused_symbols(spark, sf_dir).select(at("part", "symbol"), "name"),
        "test_only_exports": test_only_symbols(spark, sf_dir).select(at("part", "symbol"), named("p", "symbol")),
        "export_only": liveness_classes(spark, sf_dir).where("class = 'export_only'").select(at("part", "symbol"), named("p", "symbol")),
        "declared_not_rendered": wired_not_rendered(spark, sf_dir).select(at("supplier", "entity"), named("s", "entity")),
        "unused_imports": move_candidates(spark, sf_dir).select(at("supplier", "l_suppkey"), named("p", "symbol"), F.concat(F.lit("@nation/"), F.col("to_project").cast("string")).alias("specifier")),
        "orphan_files": orphan_nodes(spark, sf_dir).select(at("customer", "node")),
        "file_cycles": _circles(spark, sf_dir, "A"),
        "project_cycles": _circles(spark, sf_dir, "R"),
        "boundaries": boundary_violations(spark, sf_dir),
    }


_FILE_CYCLES = ORACLES["project_cycles"].replace("l_returnflag = 'R'", "l_returnflag = 'A'")


@query(
    f"""SELECT 'unused:part/' || symbol || ':' || name AS key FROM ({ORACLES['unused_symbols']})
    UNION SELECT 'test-only:part/' || symbol || ':p' || symbol FROM ({ORACLES['test_only_symbols']})
    UNION SELECT 'export-only:part/' || symbol || ':p' || symbol FROM ({ORACLES['liveness_classes']}) WHERE class = 'export_only'
    UNION SELECT 'not-rendered:supplier/' || entity || ':s' || entity FROM ({ORACLES['wired_not_rendered']})
    UNION SELECT 'unused-import:supplier/' || l_suppkey || ':p' || symbol || ':@nation/' || to_project FROM ({ORACLES['move_candidates']})
    UNION SELECT 'orphan:customer/' || node FROM ({ORACLES['orphan_nodes']})
    UNION SELECT 'cycle:' || members FROM ({_FILE_CYCLES})
    UNION SELECT 'project-cycle:' || members FROM ({ORACLES['project_cycles']})
    UNION SELECT 'boundary:' || from_project || '->' || to_project || ':' || source_tag FROM ({ORACLES['boundary_violations']})"""
)
def all_finding_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the findings of all nine analyses, by the forms that baselines hold."""
    return findings.finding_keys(_found(spark, sf_dir))


@query(
    f"""SELECT 'unused-export' AS rule, 'warning' AS level, name || ' is exported and never used' AS text, 'part/' || symbol AS file FROM ({ORACLES['unused_symbols']})
    UNION ALL SELECT 'export-only', 'note', 'p' || symbol || ' is used in its own file only', 'part/' || symbol FROM ({ORACLES['liveness_classes']}) WHERE class = 'export_only'
    UNION ALL SELECT 'declared-not-rendered', 'warning', 's' || entity || ' is declared and never rendered', 'supplier/' || entity FROM ({ORACLES['wired_not_rendered']})
    UNION ALL SELECT 'orphan-file', 'warning', 'No file imports this one', 'customer/' || node FROM ({ORACLES['orphan_nodes']})
    UNION ALL SELECT 'circular-dependency', 'warning', replace(members, '->', ' -> '), regexp_extract(members, '^[^-]+') FROM ({_FILE_CYCLES})
    UNION ALL SELECT 'boundary-violation', 'error', from_project || ' must not depend on ' || to_project || ' (' || source_tag || ')', 'project.json' FROM ({ORACLES['boundary_violations']})"""
)
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of all six rules as the SARIF report has them."""
    return findings.sarif_results(_found(spark, sf_dir))
