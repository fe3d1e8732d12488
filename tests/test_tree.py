"""Pruned scans, links, aliases by prefix and installed packages, on folders of our own."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators.links import rewritten
from loomgraph.operators.resolve import claimed, resolve
from loomgraph.plans.analyses import Analysis
from loomgraph.sources.tree import CLOSED, FILE, Store, Tree, ignored, known_links, listed
from loomgraph.sources.workspace import entry_bases, installed_packages, read_workspace


def fill(top, files):
    for name, content in files.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(content)


class Counting(Store):
    def list(self, folder):
        OPENED.append(folder)
        return super().list(folder)


OPENED: list[str] = []


def test_ignored_folders_are_named_and_never_opened(tmp_path):
    fill(tmp_path, {"a/b/c.ts": "", "a/node_modules/p/q.ts": "", ".git/x": "", "dist/y/z.ts": "", "a/.hidden.ts": "", "top.ts": ""})
    OPENED.clear()
    got = set(listed(Counting(str(tmp_path)), [""], 10_000, lambda name: not ignored(name)))
    assert set(OPENED) == {"", "a", "a/b"}
    assert {(p, k) for p, k, _ in got} == {("a", "folder"), ("a/b", "folder"), ("a/b/c.ts", FILE), ("a/node_modules", CLOSED), (".git", CLOSED), ("dist", CLOSED), ("a/.hidden.ts", FILE), ("top.ts", FILE)}


def test_rounds_share_a_large_tree(spark, tmp_path):
    """With a small budget tasks hand folders back, over several rounds; a hot folder's subfolders are dealt out too."""
    files = {f"hot/d{i % 40}/e{i % 7}/f{i}.ts": str(i) for i in range(400)} | {f"p{i}/x.ts": "" for i in range(30)}
    fill(tmp_path, files)
    tree = Tree(spark, str(tmp_path), budget=25)
    found = tree.entries.where(F.col("kind") == FILE)
    assert sorted(r["path"] for r in found.collect()) == sorted(files)
    assert {r["path"]: r["content"] for r in tree.contents(found).collect()} == files
    assert tree.entries.groupBy("path").count().where("count > 1").isEmpty()
    assert Tree(spark, str(tmp_path / "p1")).entries.count() == 1


def test_probe_and_contents(spark, tmp_path):
    fill(tmp_path, {"node_modules/p/a.json": "{}", "b.ts": "x"})
    (tmp_path / "bad.ts").write_bytes(b"ok \xff")
    (tmp_path / "gone").symlink_to("nowhere")
    tree = Tree(spark, str(tmp_path))
    wanted = spark.createDataFrame([("node_modules/p",), ("node_modules/p/a.json",), ("node_modules/q",), ("b.ts",), ("gone",), (None,)], "path string")
    assert {tuple(r) for r in tree.probe(wanted).collect()} == {("node_modules/p", "folder", None), ("node_modules/p/a.json", "file", None), ("b.ts", "file", None), ("gone", None, "nowhere")}
    assert {tuple(r) for r in tree.contents(spark.createDataFrame([("bad.ts",), ("none.ts",), ("node_modules/p",)], "path string")).collect()} == {("bad.ts", "ok �")}


def follow(path, links, most=40):
    """What ``rewritten`` must give, step by step."""
    seen = [path]
    while True:
        steps = path.split("/")
        hit = next((n for n in range(1, len(steps) + 1) if "/".join(steps[:n]) in links), None)
        if hit is None:
            return path
        out = []
        for s in [*links["/".join(steps[:hit])].split("/"), *steps[hit:]]:
            if s == ".." and out and out[-1] != "..":
                out.pop()
            elif s not in ("", "."):
                out.append(s)
        path = "/".join(out)
        if path in seen or len(seen) > most:
            return None
        seen.append(path)


def test_links_are_followed_to_a_fixpoint(spark):
    links = {"nm/x": "libs/x", "nm/y": "nm/x", "nm/deep": "nm/y/inner", "r1": "r2", "r2": "r3", "r3": "r1", "grow": "grow/more", "libs/x/in": "shared", "a": "b", "b/c": "d"}
    table = spark.createDataFrame(list(links.items()), "link string, target string")
    wanted = ["nm/x", "nm/x/src/i.ts", "nm/y/in/z", "nm/deep/t", "r1", "r2/q", "grow/k", "plain/p", "a/c/e", "a", "nm/xy", "libs/x", "libs/x/in"]
    got = {r["path"]: r["real"] for r in rewritten(spark.createDataFrame([(w,) for w in [*wanted, "a", None]], "path string"), table, most_hops=9).collect()}
    assert got == {w: follow(w, links, 9) for w in wanted}
    assert got["nm/deep/t"] == "libs/x/inner/t" and got["r2/q"] is None and got["grow/k"] is None and got["nm/y/in/z"] == "shared/z"


def test_random_links(spark):
    rng = random.Random(2)
    name = lambda: "/".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    links = {}
    while len(links) < 9:
        links[name()] = name()
    wanted = {name() + rng.choice(["", "/z"]) for _ in range(60)}
    got = rewritten(spark.createDataFrame([(w,) for w in wanted], "path string"), spark.createDataFrame(list(links.items()), "link string, target string"))
    assert {r["path"]: r["real"] for r in got.collect()} == {w: follow(w, links) for w in wanted}


def test_aliases_meet_specifiers_by_prefix(spark):
    """Every alias that may mean a specifier, no other, and never one row for each alias of the project."""
    rng = random.Random(4)
    pieces = ["a", "b/", "ab", "/", "x"]
    word = lambda n: "".join(rng.choice(pieces) for _ in range(rng.randint(1, n)))
    aliases = {(f"p{i % 2}", word(3) + rng.choice(["", "*", "/*", "*b"])) for i in range(60)} | {("p0", "*")}
    sources = {(f"p{i % 2}", word(5)) for i in range(80)}
    got = claimed(spark.createDataFrame(list(sources), "project string, source string"), spark.createDataFrame([(p, a, "t", 0, "") for p, a in aliases], "project string, alias string, target string, ord int, base_url string"))
    want = {(p, s, a) for p, s in sources for q, a in aliases if p == q and (a == s if "*" not in a else s.startswith(a.split("*")[0]))}
    assert {(r["project"], r["source"], r["alias"]) for r in got.collect()} == want


def test_joined_rows_follow_specifiers_not_aliases(spark):
    """2,000 aliases and 100,000 specifiers: as many rows as specifiers meet aliases."""
    aliases = spark.range(2000).select((F.col("id") % 1).cast("string").alias("project"), F.format_string("@w/lib%04d/*", "id").alias("alias"), F.lit("t/*").alias("target"), F.lit(0).alias("ord"), F.lit("").alias("base_url"))
    sources = spark.range(100_000).select((F.col("id") % 1).cast("string").alias("project"), F.format_string("@w/lib%04d/part%d", F.col("id") % 4000, F.col("id")).alias("source"))
    found = claimed(sources, aliases)
    assert found.count() == 50_000 and found.select("alias").distinct().count() == 2000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_order_of_probing(spark):
    """Plain scripts count behind barrels only, and before declarations; a folder's index comes last."""
    files = ["s/x.js", "s/x.d.ts", "s/x/index.ts", "s/y/index.js", "s/y/index.d.ts", "s/z.tsx", "s/z.ts", "s/w.jsx"]
    wanted = [("s/a.ts", f"./{n}", "p", barrel) for n in ("x", "y", "z", "w", "z.js", "none") for barrel in (False, True)]
    empty = spark.createDataFrame([], "project string, alias string, target string, ord int, base_url string")
    packages = spark.createDataFrame([], "package string, dir string, entry string")
    r = resolve(spark.createDataFrame(wanted, "path string, source string, project string, barrel boolean"), spark.createDataFrame([(f,) for f in files], "path string"), empty, packages)
    got = {(x["source"][2:], x["barrel"]): x["resolved"] for x in r.collect()}
    assert got == {
        ("x", False): "s/x.d.ts", ("x", True): "s/x.js", ("y", False): "s/y/index.d.ts", ("y", True): "s/y/index.js", ("z", False): "s/z.ts", ("z", True): "s/z.ts",
        ("w", False): None, ("w", True): "s/w.jsx", ("z.js", False): "s/z.ts", ("z.js", True): "s/z.ts", ("none", False): None, ("none", True): None,
    }


@pytest.mark.parametrize(
    ("manifest", "want"),
    [
        ({"types": "./t.d.ts", "main": "m.js", "exports": "./e"}, ["p/t.d.ts", "p/m.js", "p/e", "p"]),
        ({"exports": {".": {"import": "./i.js", "default": "./d.js"}}}, ["p/i.js", "p"]),
        ({"exports": {".": "./dot"}, "main": "m"}, ["p/m", "p/dot", "p"]),
        ({"exports": {"default": "./d", "types": "./t"}}, ["p/t", "p"]),
        ({"exports": {".": {"import": {"types": "./no"}, "default": "./d"}}}, ["p/d", "p"]),
        ({"main": ["no"], "exports": {"./sub": "./s"}}, ["p"]), ({}, ["p"]),
    ],
)
def test_entries_of_manifests(spark, manifest, want):
    row = spark.createDataFrame([(json.dumps(manifest),)], "j string").select(entry_bases(F.lit("p"), F.col("j")).alias("b")).first()
    assert row["b"] == want


LINKED = {
    "package.json": "{}",
    "tsconfig.base.json": json.dumps({"compilerOptions": {"paths": {"@fix/models": ["libs/models/src/index.ts"]}}}),
    "apps/one/project.json": '{"name": "one"}',
    "apps/one/src/a.ts": "import { widget, Renamed } from '@fix/wpkg';\nimport { deep } from '@fix/wpkg/src/deep';\nimport { twice } from 'twice';\nimport x from 'opaque';\nimport y from 'plain-entry';\n"
    "import z from 'round';\nimport t from 'typed/sub';\nimport q from 'typed/folder';\nimport n from 'nested-only';\nimport g from 'absent';\nuse(widget, Renamed, deep, twice, x, y, z, t, q, n, g);\n",
    "libs/wpkg/project.json": '{"name": "wpkg"}',
    "libs/wpkg/package.json": '{"name": "@fix/other-name", "types": "src/index.ts"}',
    "libs/wpkg/src/index.ts": "export * from './lib/widget';\nexport { default as Renamed } from './lib/renamed';\n",
    "libs/wpkg/src/lib/widget.ts": "export const widget = 1;\nexport const idle = 2;\n",
    "libs/wpkg/src/lib/renamed.ts": "export default class Renamed {}\n",
    "libs/wpkg/src/deep.ts": "export const deep = 1;\n",
    "libs/twice/project.json": '{"name": "twice"}',
    "libs/twice/index.ts": "export const twice = 1;\n",
    "node_modules/opaque/readme.md": "",
    "node_modules/plain-entry/package.json": '{"exports": {"types": "./lib/main"}}',
    "node_modules/plain-entry/lib/main.d.ts": "",
    "node_modules/typed/sub.d.ts": "",
    "node_modules/typed/folder/thing.js": "",
    "apps/one/node_modules/nested-only/index.d.ts": "",
    "apps/one/node_modules/never-imported/project.json": '{"name": "never"}',
}


@pytest.fixture(scope="module")
def linked(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("linked")
    fill(top, LINKED)
    modules = top / "node_modules"
    (modules / "@fix").mkdir()
    (modules / "@fix/wpkg").symlink_to("../../libs/wpkg")  # as package managers do
    (modules / ".store/twice@1/node_modules").mkdir(parents=True)
    (modules / "twice").symlink_to(".store/twice@1/node_modules/twice")  # a link to a link
    (modules / ".store/twice@1/node_modules/twice").symlink_to(top / "libs/twice")  # an absolute one
    (modules / "round").symlink_to("round2")
    (modules / "round2").symlink_to("round")
    return str(top)


def test_installed_and_linked_packages(spark, linked):
    a = Analysis(read_workspace(spark, linked))
    got = {r["source"]: r["resolved"] for r in a.resolution.where("path = 'apps/one/src/a.ts'").collect()}
    assert got == {
        "@fix/wpkg": "libs/wpkg/src/index.ts", "@fix/wpkg/src/deep": "libs/wpkg/src/deep.ts", "twice": "libs/twice/index.ts", "opaque": "node_modules/opaque", "plain-entry": "node_modules/plain-entry/lib/main.d.ts",
        "round": None, "typed/sub": "node_modules/typed/sub.d.ts", "typed/folder": "node_modules/typed/folder", "nested-only": "apps/one/node_modules/nested-only/index.d.ts", "absent": None,
    }
    ends = {r["name"]: r["resolved_path"] for r in a.imports.collect()}
    assert ends["widget"] == "libs/wpkg/src/lib/widget.ts" and ends["Renamed"] == "libs/wpkg/src/lib/renamed.ts"
    unused = {r["name"] for r in a.unused()["unused_exports"].collect()}
    assert "idle" in unused and not {"widget", "Renamed", "deep", "twice"} & unused
    assert {r["specifier"] for r in a.resolution_health()["unresolved_external"].collect()} == {"round", "absent"}


def test_links_behind_closed_folders_are_probed(spark, linked):
    tree = Tree(spark, linked)
    probed = tree.probe(spark.createDataFrame([("node_modules/twice",)], "path string"))
    links = {r["link"]: r["target"] for r in known_links(tree, probed).collect()}
    assert links == {"node_modules/twice": "node_modules/.store/twice@1/node_modules/twice", "node_modules/.store/twice@1/node_modules/twice": "libs/twice"}
    bare = spark.createDataFrame([("apps/one/src/a.ts", "twice/index")], "path string, source string")
    found, _ = installed_packages(tree, bare)
    assert [(r["folder"], r["real"]) for r in found.collect()] == [("node_modules/twice", "libs/twice")]


def test_node_modules_can_be_included(spark, linked):
    apart, all_in = read_workspace(spark, linked), read_workspace(spark, linked, exclude_node_modules=False)
    of = lambda ws: {r["path"] for r in ws.files.select("path").collect()}
    assert of(all_in) - of(apart) == {"apps/one/node_modules/nested-only/index.d.ts"}
    assert {r["name"] for r in all_in.projects.collect()} == {"one", "wpkg", "twice"}


def test_rules_files_in_turn_and_broken_ones(spark, tmp_path):
    fill(tmp_path, {"old.json": json.dumps({"boundaries": [{"sourceTag": "a", "allowedTags": []}]}), "broken.json": '{"boundaries": [', "p/project.json": '{"name": "p"}'})
    ws = read_workspace(spark, str(tmp_path), rules_file="new.json,old.json")
    assert [tuple(r) for r in ws.rules.collect()] == [("a", [])] and ws.skipped.isEmpty()
    ws = read_workspace(spark, str(tmp_path), rules_file="broken.json")
    assert ws.rules.isEmpty() and [r["path"] for r in ws.skipped.collect()] == ["broken.json"]
