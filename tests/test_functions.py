"""Path, markup and text functions, and graph operators, on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import markup, paths, text
from loomgraph.operators import graph, usage
from loomgraph.operators.prefix_join import project_of
from loomgraph.operators.resolve import follow_barrels
from loomgraph.sources.scripts import identifiers, split_statements


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "path, want",
    [("./a/./b/../c.ts", "a/c.ts"), ("../../x", "../../x"), ("a//b/", "a/b"), ("/r/../s/./t", "/s/t"), ("a/../..", ".."), ("", "")],
)
def test_normalize_path(spark, path, want):
    assert one(spark, path, paths.normalize_path) == want


def test_path_parts(spark):
    assert one(spark, "/w/p/src/a.ts", lambda c: paths.relative_path(c, F.lit("/w/p"))) == "src/a.ts"
    assert one(spark, "/w/pq/a.ts", lambda c: paths.relative_path(c, F.lit("/w/p"))) == "/w/pq/a.ts"
    assert one(spark, "a/b/c.ts", paths.ancestors) == ["a/b", "a"] and one(spark, "c.ts", paths.ancestors) == []
    assert [one(spark, p, paths.is_test_file) for p in ("x.spec.ts", "a.test.tsx", "b_test.ts", "test/b.ts", "spec.ts")] == [True, True, True, False, False]
    assert [one(spark, p, paths.is_entry_file) for p in ("main.ts", "a/page.tsx", "v.config.js", "global-setup.ts", "pages.tsx", "page.css")] == [True, True, True, True, False, False]
    assert [one(spark, p, paths.in_ignored_dir) for p in ("a/dist/b.ts", ".git/x", "a/.b/c", "./a/b", "dist.ts")] == [True, True, True, False, False]
    assert one(spark, "@s/p/deep/x", paths.package_of) == "@s/p" and one(spark, "@s/p/deep/x", paths.subpath_of) == "deep/x" and one(spark, "p", paths.subpath_of) is None


def test_jsonc(spark):
    dirty = '{ // c\n "a": "http://x/*no*/", /* b, */ "b": [1, 2, ], "c": "\\"//", }'
    assert json.loads(one(spark, dirty, text.strip_jsonc)) == {"a": "http://x/*no*/", "b": [1, 2], "c": '"//'}
    assert one(spark, "^19.2.0", text.version_major) == 19 and one(spark, "latest", text.version_major) is None
    assert one(spark, "a<b>&c\u2028", text.html_safe) == "a\\u003cb\\u003e\\u0026c\\u2028"
    assert one(spark, "@s/p-q.é", text.node_id) == "_s_p_q_é"


def test_templates(spark):
    html = """<!-- <no-el> --><fix-btn [(value)]="x | uiA" (go)="f(a || b)" *ngIf="y | uiB" class="a  b" #ref @fade/> a < b {{ t | uiC : (u | uiD) }}
      @if ((items | uiHas) && ok) { <p [attr.title]="z">@for (i of list | uiSort; track i) {x}</p> } <input disabled required='true'>"""
    found = one(spark, html, markup.elements)
    assert [e["tag"] for e in found] == ["fix-btn", "p", "input"]
    assert found[0]["attributes"] == ["class", "go", "ngIf", "value"] and found[0]["classes"] == ["a", "b"]
    assert found[1]["attributes"] == ["title"] and found[2]["attributes"] == ["disabled", "required"]
    assert one(spark, html, markup.template_pipes) == ["uiA", "uiB", "uiC", "uiD", "uiHas", "uiSort"]


def test_selectors(spark):
    parsed = one(spark, "fix-btn, button[fixBtn]:not([link], .x:not(.y)) , .card.big[a=v],:host", markup.parse_selector)
    assert [(s["element"], s["attributes"], s["classes"]) for s in parsed] == [("fix-btn", [], []), ("button", ["fixBtn"], []), (None, ["a"], ["card", "big"])]
    element = F.struct(F.lit("div").alias("tag"), F.array(F.lit("a"), F.lit("c")).alias("attributes"), F.array(F.lit("card"), F.lit("big")).alias("classes"))
    assert [one(spark, s, lambda c: markup.matches(markup.parse_selector(c), element)) for s in ("div", ".card.big[a]", "p, [c]", "div[b]", ".other")] == [True, True, True, False, False]


def test_longest_prefix(spark):
    files = spark.createDataFrame([("apps/a/src/x.ts",), ("apps/a/inner/y.ts",), ("apps/ab/z.ts",), ("other.ts",), (None,)], "path string")
    roots = spark.createDataFrame([("A", "apps/a"), ("I", "apps/a/inner"), ("B", "apps/a"), (None, None)], "name string, root string")
    got = {r["path"]: r["project"] for r in project_of(files, roots).collect()}
    assert got == {"apps/a/src/x.ts": "A", "apps/a/inner/y.ts": "I", "apps/ab/z.ts": None, "other.ts": None, None: None}


def test_reachability_and_cycles(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [(50, 50), (60, 61), (61, 62), (62, 60), (None, 1), (7, None)]
    edges = spark.createDataFrame(pairs, "src int, dst int")
    after = {}
    for a, b in pairs:
        if a is not None and b is not None:
            after.setdefault(a, set()).add(b)

    def reach(starts):
        seen, todo = set(), list(starts)
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    seeds = spark.createDataFrame([(0,), (3,), (60,)], "node int")
    assert {r["node"] for r in graph.reachable(edges, seeds).collect()} == reach([0, 3, 60])
    assert {r["node"] for r in graph.reachable(edges, seeds, include_seeds=True).collect()} == reach([0, 3, 60]) | {0, 3, 60}
    nodes = {a for p in pairs for a in p if a is not None}
    want = {n: min(m for m in reach([n]) if n in reach([m])) for n in nodes if n in reach([n])}
    assert {r["node"]: r["component"] for r in graph.scc(edges).collect()} == want
    assert graph.scc(edges.limit(0)).count() == 0


def test_division_and_boundaries(spark):
    uses = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3), ("c", 9)], "e string, p int")
    allowed = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "e string, p int")
    assert [r["e"] for r in usage.all_uses_within(uses, allowed, "e", ["p"]).collect()] == ["a"]
    deps = spark.createDataFrame([("x", "y"), ("x", "z"), ("y", "z")], "from_project string, to_project string")
    projects = spark.createDataFrame([("x", ["s:a", "t:ui"]), ("y", ["s:b"]), ("z", ["s:a"])], "name string, tags array<string>")
    rules = spark.createDataFrame([("s:a", ["s:a"]), ("t:ui", ["*"]), ("s:b", [])], "source_tag string, allowed array<string>")
    assert {tuple(r)[:3] for r in usage.boundary_violations(deps, projects, rules).collect()} == {("x", "y", "s:a"), ("y", "z", "s:b")}


def test_barrels_in_depth_first_order(spark):
    declared = spark.createDataFrame([("d1", "X"), ("d2", "X"), ("d2", "Y"), ("c", "Z")], "file string, name string")
    forwarded = spark.createDataFrame([("b", "Q", "Y", "m")], "file string, name string, original string, source string")
    stars = spark.createDataFrame([("b", 0, "m"), ("b", 1, "d1"), ("m", 0, "d2"), ("m", 1, "b"), ("r1", 0, "r2"), ("r2", 0, "r1")], "file string, ord int, source string")
    wanted = spark.createDataFrame([("b", "X"), ("b", "Q"), ("c", "Z"), ("r1", "N"), ("b", "default")], "file string, name string")
    got = {(r["file"], r["name"]): r["target"] for r in follow_barrels(wanted, declared, forwarded, stars).collect()}
    assert got == {("b", "X"): "d2", ("b", "Q"): "d2", ("c", "Z"): "c", ("r1", "N"): "r1", ("b", "default"): "b"}


def test_statements_and_identifiers(spark):
    source = "import a from 'x' // c\nconst r = /[/'\"]}/.test(s) /* { */\nfoo.bar({ key: v, w })\nexport type T = { a: B }\n  | C\nif (a) { b }\nelse { `t${u}` }\n"
    got = split_statements(source)
    assert got[0] == 'import a from "x"' and len(got) == 5 and got[3].endswith("| C") and got[4].startswith("if")
    assert split_statements("function (") is None and split_statements(None) == []
    assert sorted(one(spark, got[2], identifiers)) == ["foo", "v", "w"]
