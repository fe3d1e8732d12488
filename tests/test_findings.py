"""Keys and results of findings, and uses by way, on small tables."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import findings, usage


@pytest.fixture
def found(spark):
    named = lambda *rows: spark.createDataFrame(list(rows), "file string, name string, specifier string")
    circles = lambda *rows: spark.createDataFrame(list(rows), "component string, members array<string>")
    return {
        "unused_exports": named(("a.ts", "x", None), ("a.ts", "x", "again")), "test_only_exports": named(("a.ts", "t", None)), "export_only": named(("a.ts", "e", None)),
        "declared_not_rendered": named(("c.ts", "C", None)), "unused_imports": named(("a.ts", "i", "@w/ui")), "orphan_files": named(("o.ts", None, None)),
        "file_cycles": circles(("a", ["a.ts", "b.ts"])), "project_cycles": circles(("p", ["p", "q"])),
        "boundaries": spark.createDataFrame([("p", "q", "type:ui")], "from_project string, to_project string, source_tag string"),
    }


def test_keys_of_all_nine_kinds(found):
    assert sorted(r["key"] for r in findings.finding_keys(found).collect()) == [
        "boundary:p->q:type:ui", "cycle:a.ts->b.ts", "export-only:a.ts:e", "not-rendered:c.ts:C", "orphan:o.ts", "project-cycle:p->q", "test-only:a.ts:t", "unused-import:a.ts:i:@w/ui", "unused:a.ts:x",
    ]


def test_every_key_has_a_category_but_two(found):
    by = {r["key"]: r["c"] for r in findings.finding_keys(found).select("key", usage.fail_category(F.col("key")).alias("c")).collect()}
    assert {k.split(":")[0] for k, c in by.items() if c == "other"} == {"test-only", "export-only"}


def test_results_of_all_six_rules(found):
    rows = [tuple(r) for r in findings.sarif_results(found).collect()]
    assert {r[0] for r in rows} == set(findings.SARIF_RULES) and all(findings.SARIF_RULES[r[0]] == r[1] for r in rows)
    assert ("circular-dependency", "warning", "a.ts -> b.ts", "a.ts") in rows and ("boundary-violation", "error", "p must not depend on q (type:ui)", "project.json") in rows
    assert rows.count(("unused-export", "warning", "x is exported and never used", "a.ts")) == 2


def test_what_is_not_given_is_not_reported(found):
    only = {"orphan_files": found["orphan_files"]}
    assert [r["key"] for r in findings.finding_keys(only).collect()] == ["orphan:o.ts"]
    assert findings.sarif_results({"orphan_files": found["orphan_files"].limit(0)}).isEmpty()


def test_uses_lead_to_declarations(spark):
    uses = spark.createDataFrame([("Import", "d", True), ("Template", "d", True), ("Jsx", "d", False), ("LazyLoad", "other", True), ("Import", None, True)], "via string, at string, spec boolean")
    got = usage.uses_of(uses, spark.createDataFrame([("d",), ("d",)], "at string"), "at", F.col("spec"))
    rows = [(r["via"], r["test"]) for r in got.orderBy(usage.rank_of_way(F.col("via"))).collect()]
    assert rows == [("Import", True), ("Template", False), ("Jsx", False)]
