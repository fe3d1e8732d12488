"""A small workspace of our own through discovery, facts, analyses, reports and the command line."""

import copy
import io
import itertools
import json

import pytest

from loomgraph import cli
from loomgraph.plans import report, sinks
from loomgraph.plans.analyses import Analysis
from loomgraph.plans.crosscheck import crosscheck
from loomgraph.sources.store import FactStore
from loomgraph.sources.workspace import facts, read_workspace

FILES = {
    "package.json": '{"dependencies": {"@angular/core": "^19.1.0"}}',
    "boundaries.json": '{"boundaries": [{"sourceTag": "type:ui", "allowedTags": ["type:ui"]}, {"sourceTag": "type:app", "allowedTags": ["*"]}]}',
    "tsconfig.base.json": '{ // base\n "compilerOptions": { "baseUrl": ".", "paths": { "@w/ui": ["libs/ui/src/index.ts"], "@w/util": ["libs/util/src/index.ts"], "@deep/*": ["libs/util/src/lib/*",] } } }',
    "apps/shop/project.json": '{"name": "shop", "tags": ["type:app"], "projectType": "application"}',
    "apps/shop/tsconfig.json": '{"extends": "../../tsconfig.base.json"}',
    "apps/shop/src/main.ts": "import { ShopComponent } from './shop.component';\nimport { gone } from './missing';\nimport 'zone.js';\nstart(ShopComponent);\n",
    "apps/shop/src/shop.component.ts": "import { Component } from '@angular/core';\nimport { BtnComponent, helper as h } from '@w/ui';\nimport { money } from '@w/util';\nimport { Ghost } from '@w/util';\n"
    "@Component({ selector: 'shop-root', imports: [BtnComponent, IdleComponent], templateUrl: './shop.component.html' })\nexport class ShopComponent { total = money(1); x = h(); }\nimport { IdleComponent } from '@w/ui';\n",
    "apps/shop/src/shop.component.html": "<ui-btn [label]=\"a | cut\" class='x'></ui-btn>",
    "apps/shop/src/routes.ts": "export const routes = [{ path: 'lazy', loadComponent: () => import('@deep/lazy').then(m => m.LazyPage) }];\n",
    "apps/shop/src/main.spec.ts": "import { onlyTested } from '@w/util';\nonlyTested();\n",
    "libs/ui/project.json": '{"name": "ui", "tags": ["type:ui"]}',
    "libs/ui/tsconfig.json": '{"extends": "../../tsconfig.base.json"}',
    "libs/ui/src/index.ts": "export * from './lib/btn';\nexport { Idle as IdleComponent } from './lib/idle';\nexport { helper } from './lib/helper';\nexport * from './lib/cut';\n",
    "libs/ui/src/lib/btn.ts": "import { Component, Input, input } from '@angular/core';\nimport { money } from '@w/util';\n@Component({ selector: 'ui-btn', template: '<b>{{ x }}</b>' })\nexport class BtnComponent { @Input() label = ''; size = input.required<number>(); y = money(2); }\n",
    "libs/ui/src/lib/idle.ts": "export class Idle {}\n",
    "libs/ui/src/lib/cut.ts": "@Pipe({ name: 'cut' })\nexport class CutPipe { transform(v: string) { return v; } }\n",
    "libs/ui/src/lib/helper.ts": "import { other } from './other';\nexport function helper() { return other() + local; }\nexport const local = 1, dead = 2;\n",
    "libs/ui/src/lib/other.ts": "import { helper } from './helper';\nexport function other() { return helper; }\n",
    "libs/util/project.json": '{"name": "util"}',
    "libs/util/src/index.ts": "export * from './lib/money';\nexport * from './lib/ghost';\n",
    "libs/util/src/lib/money.ts": "export function money(n: number): Money { return { n }; }\nexport interface Money { n: number }\nexport function onlyTested() {}\nexport function never() {}\n",
    "libs/util/src/lib/ghost.ts": "export class Ghost {}\n",
    "libs/util/src/lib/lazy.ts": "import { part } from './part';\nexport class LazyPage { p = part; }\n",
    "libs/util/src/lib/part.ts": "export const part = 1;\nexport const spare = 2;\n",
    "libs/util/src/lib/orphan.ts": "export const alone = 1;\n",
    "libs/util/src/lib/broken.ts": "export function broken( {\n",
    "libs/util/src/lib/view.tsx": "import { memo } from 'react';\nexport const Card = memo(({ a }) => <Badge color=\"red\" onClick={() => a({ b: 1 })} />);\nfunction Badge(p) { return <i>{p.color}</i>; }\n",
    "node_modules/zone.js/index.d.ts": "export {};\n",
    "dist/x/project.json": '{"name": "no"}',
    "libs/bad/project.json": '{"name": "bad", ',
    "libs/ng/project.json": '{"name": "ng"}',
    "libs/ng/tsconfig.json": '{ broken',
    "libs/ng/tsconfig.lib.json": '{"extends": "@cfg/base/strict"}',
    "libs/ng/package.json": '{"name": "@w/ng", "exports": "./src/all"}',
    "node_modules/@cfg/base/strict.json": '{"extends": "./one.json"}',
    **{f"node_modules/@cfg/base/{a}.json": json.dumps({"extends": f"./{b}.json"}) for a, b in itertools.pairwise("one two three four five six seven eight nine".split())},
    "node_modules/@cfg/base/nine.json": '{"extends": "./one.json", "compilerOptions": {"baseUrl": "../../..", "paths": {"@far/*": ["libs/ng/src/*"]}}}',
    "libs/ng/src/all.ts": "export * from './plain';\nexport * from './parts';\n",
    "libs/ng/src/shown.ts": "@Component({ selector: 'x-shown', template: '' })\nexport class NeverShown {}\n",
    "libs/ng/src/mod.ts": "import { NeverShown } from './shown';\n@NgModule({ declarations: [NeverShown] })\nexport class Mod {}\n",
    "libs/ng/src/ns.ts": "export const viaNs = 1;\n",
    "libs/ng/src/ns-user.ts": "import * as ns from './ns';\nimport { Mod } from './mod';\nuse(ns.viaNs, Mod);\n",
    "libs/ng/src/plain.js": "export const plain = 1;\n",
    "libs/ng/src/use.ts": "import { plain } from '@w/ng';\nimport { Zoom } from '@w/ng/src/parts';\nimport { Late } from '@far/parts';\nimport * as all from '@w/ng';\nuse(plain, Zoom, Late, all);\n",
    "libs/ng/src/parts.ts": "@Component({ selector: 'z-z', template: 'z', styleUrls: ['./a.css', './b.css'], styleUrl: './c.css', standalone: false })\nexport class Zoom {}\n"
    "@Component({ selector: 'l-l', template: '<b></b>' })\nexport class Late { @Input() a = ''; @Output() gone = 1; }\n"
    "@Directive({ selector: '[hl]', host: { '(click)': 'go()', '[class.x]': 'x' } })\nexport class Hl {}\n@Pipe({ name: 'raw', pure: false })\nexport class RawPipe {}\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("work")
    for name, content in FILES.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    return str(top)


@pytest.fixture(scope="module")
def a(spark, root):
    return Analysis(read_workspace(spark, root))


def names(df, *columns):
    return {tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_discovery(a):
    assert names(a.ws.projects, "name", "root") == {("shop", "apps/shop"), ("ui", "libs/ui"), ("util", "libs/util"), ("ng", "libs/ng")}
    assert names(a.ws.skipped, "path") == {"libs/bad/project.json", "libs/ng/tsconfig.json"}
    assert a.ws.default_standalone
    assert not any("broken" in p for p in names(a.f["source_files"], "path"))


def test_resolution(a):
    health = a.resolution_health()
    assert names(health["unresolved_internal"], "file", "specifier") == {("apps/shop/src/main.ts", "./missing")}
    assert names(health["unresolved_external"], "specifier") == {"@angular/core", "react"}
    got = {(r["path"].split("/")[-1], r["name"]): r["resolved_path"] for r in a.imports.collect()}
    assert got[("shop.component.ts", "h")] == "libs/ui/src/lib/helper.ts" and got[("shop.component.ts", "IdleComponent")] == "libs/ui/src/lib/idle.ts"
    assert got[("main.ts", "")] == "node_modules/zone.js/index.d.ts"


def test_packages_barrels_and_far_configurations(a):
    got = {(r["source"], r["name"]): r["resolved_path"] for r in a.imports.where("path = 'libs/ng/src/use.ts'").collect()}
    assert got[("@w/ng", "plain")] == "libs/ng/src/plain.js" and got[("@w/ng/src/parts", "Zoom")] == got[("@far/parts", "Late")] == "libs/ng/src/parts.ts"
    assert "libs/ng/src/all.ts" in got.values()  # the namespace import stays at the barrel


def test_entities(a):
    t = {key: {r[0]: r for r in df.collect()} for key, df in a.entity_tables().items()}
    assert (t["components"]["Zoom"]["standalone"], t["components"]["Late"]["standalone"]) == (False, True)
    assert t["components"]["Zoom"]["style_paths"] == ["./a.css", "./b.css", "./c.css"] and t["components"]["Late"]["style_paths"] == []
    assert t["directives"]["Hl"]["host_bindings"] == ["go()", "x"]
    assert (t["pipes"]["RawPipe"]["pure"], t["pipes"]["CutPipe"]["pure"]) == (False, True)


def test_templates(a):
    assert names(a.template_usages, "component", "target", "via") == {("ShopComponent", "BtnComponent", "Selector"), ("ShopComponent", "CutPipe", "Pipe")}
    btn = next(r for r in a.f["entities"].collect() if r["name"] == "BtnComponent")
    assert btn["inputs"] == ["label", "size"]


def test_stats(a):
    s = a.stats()
    deps = {(r["from_project"], r["to_project"]): r for r in s["dependencies"].collect()}
    assert set(deps) == {("shop", "ui"), ("shop", "util"), ("ui", "util")} and deps[("shop", "util")]["lazy"]
    assert {x["name"]: x["count"] for x in deps[("ui", "util")]["symbols"]} == {"money": 1}
    projects = {r["name"]: r for r in s["projects"].collect()}
    assert (projects["util"]["afferent"], projects["util"]["efferent"], projects["shop"]["instability"]) == (2, 0, 1.0)
    assert names(a.boundaries(), "from_project", "to_project", "source_tag") == {("ui", "util", "type:ui")}
    assert [r["members"] for r in a.file_cycles().collect()] == [["libs/ui/src/lib/helper.ts", "libs/ui/src/lib/other.ts"]]


def test_unused(a):
    u = a.unused()
    base = lambda key: {(f.split("/")[-1], n) for f, n in names(u[key], "file", "name") if not f.startswith("libs/ng/")}
    assert base("unused_exports") == {("money.ts", "never"), ("ghost.ts", "Ghost"), ("helper.ts", "dead"), ("idle.ts", "Idle"), ("orphan.ts", "alone"), ("routes.ts", "routes"), ("view.tsx", "Card")}
    assert base("test_only_exports") == {("money.ts", "onlyTested")} and base("export_only") == {("money.ts", "Money"), ("helper.ts", "local")}
    assert base("unused_imports") == {("shop.component.ts", "Ghost")}
    assert {f.split("/")[-1] for f in names(u["orphan_files"], "file") if not f.startswith("libs/ng/")} == {"orphan.ts", "routes.ts", "view.tsx"}


def test_text_mentions(a):
    """``Ghost`` is imported, though never used, so a text search finds it; ``never`` stands nowhere else."""
    got = {(r["file"].split("/")[-1], r["name"]) for r in a.text_mentions()["exports"].collect()}
    assert ("ghost.ts", "Ghost") in got and ("money.ts", "never") not in got


def test_texts_contradict_nothing(a):
    assert {name: df.count() for name, df in crosscheck(a).items()} == {"exports": 0, "orphans": 0, "imports": 0}


def test_texts_contradict_wrong_findings(spark, a):
    """Findings made wrong on purpose: each arm of the search finds its own."""
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    wrong = copy.copy(a)
    wrong._made = {"unused": {
        "unused_exports": made([("libs/ui/src/lib/other.ts", "other"), ("libs/util/src/lib/never.ts", "never"), ("libs/util/src/lib/lazy.ts", "LazyPage")], "file string, name string"),
        "orphan_files": made([("libs/util/src/lib/part.ts",), ("libs/util/src/lib/lazy.ts",), ("libs/util/src/lib/orphan.ts",)], "file string"),
        "unused_imports": made([("libs/ui/src/lib/helper.ts", "other", "./other"), ("apps/shop/src/shop.component.ts", "Ghost", "@w/util")], "file string, name string, specifier string"),
    }}
    found = crosscheck(wrong)
    assert [tuple(r) for r in found["exports"].collect()] == [("libs/ui/src/lib/other.ts", "other", 1)]
    assert names(found["orphans"], "file") == {"libs/util/src/lib/part.ts"}
    assert [tuple(r) for r in found["imports"].collect()] == [("libs/ui/src/lib/helper.ts", "other", "./other", 1)]


def test_timings(a):
    rows = a.timings().collect()
    assert {r["project"] for r in rows} == {"shop", "ui", "util", "ng", None} and rows[-1]["project"] is None
    assert rows[-1]["files"] == sum(r["files"] for r in rows[:-1]) and abs(rows[-1]["total_ms"] - sum(r["total_ms"] for r in rows[:-1])) < 1e-6 and all(r["mean_ms"] > 0 for r in rows)


def test_components_and_symbols(a):
    shown = {r["name"]: r for r in a.react_usage().collect()}
    assert shown["Card"]["wrapped"] and shown["Card"]["usages"] == 0
    assert shown["Badge"]["usages"] == 1 and [p["prop"] for p in shown["Badge"]["props"]] == ["color", "onClick"]
    usages = a.symbol_usages("BtnComponent")
    assert names(usages["declarations"], "path", "kind") == {("libs/ui/src/lib/btn.ts", "Component")}
    assert names(usages["usages"], "via") == {"Import", "Template"}
    assert names(a.move_candidates(), "symbol") == {"BtnComponent", "CutPipe", "Ghost"}


def test_uses_by_namespace_and_unrendered_declarations(a):
    u = a.unused()
    assert names(u["declared_not_rendered"], "file", "name", "kind") == {("libs/ng/src/shown.ts", "NeverShown", "Component")}
    assert "viaNs" not in names(u["unused_exports"], "name")
    assert ("libs/ng/src/ns.ts", "viaNs", "libs/ng/src/ns-user.ts") in names(a.usages_index(), "path", "name", "from_path")


def written(nest, tmp_path):
    report.write(nest, str(tmp_path / "nest.json"))
    return json.loads((tmp_path / "nest.json").read_text())


def test_reports_and_policy(a, tmp_path):
    deps = a.stats()["dependencies"]
    assert any(line.startswith("  shop -.->|") for line in report.mermaid(deps))
    dot = list(report.project_dot(deps))
    assert dot[0] == "digraph projects {" and dot[-1] == "}" and '  "ui" -> "util" [label="1"];' in dot and any(x.startswith('  "shop" -> "util"') and "dashed" in x for x in dot)
    files = list(report.file_dot(a.edges))
    assert '  "libs/ui/src/lib/helper.ts" -> "libs/ui/src/lib/other.ts";' in files and files[1:-1] == sorted(files[1:-1]) and len(files) == a.edges.count() + 2
    results = written(report.sarif(a), tmp_path)["runs"][0]["results"]
    assert {r["ruleId"] for r in results} >= {"unused-export", "orphan-file", "circular-dependency", "boundary-violation", "declared-not-rendered"}
    assert all(r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in results) and {r["level"] for r in results} == {"warning", "note", "error"}
    base, parts = str(tmp_path / "baseline.json"), str(tmp_path / "baseline")
    report.write_baseline(a, base)
    report.write_baseline(a, parts)
    keys = json.loads(open(base).read())["findings"]
    assert keys == sorted(keys) and "orphan:libs/util/src/lib/orphan.ts" in keys
    spark = a.edges.sparkSession
    assert sorted(r["key"] for r in sinks.read_keys(spark, base).collect()) == sorted(r["key"] for r in sinks.read_keys(spark, parts).collect()) == keys
    assert [report.policy(a, ["unused"]), report.policy(a, ["all"], base), report.policy(a, ["all"], parts), report.policy(a, None, None, True), report.policy(a)] == [2, 0, 0, 3, 0]
    page = io.StringIO()
    report.html(a, page)
    assert page.getvalue().count("<script>") == 1 and page.getvalue().count("</script") == 1 and "{{" not in page.getvalue().split("const tables")[0].split("const report")[0]
    embedded = page.getvalue().split("const report = ")[1].split(";\nconst tables")[0]
    full = json.loads(embedded)
    assert full["source_files"] and full["stats"]["project_cycles"] == [] and {f["path"] for f in full["source_files"]} >= {"libs/ui/src/index.ts"}
    assert {i["resolved_path"] for f in full["source_files"] if f["path"] == "libs/ui/src/lib/other.ts" for i in f["imports"]} == {"libs/ui/src/lib/helper.ts"}
    with pytest.raises(ValueError):
        (tmp_path / "odd.json").write_text('{"other": 1}')
        sinks.read_keys(spark, str(tmp_path / "odd.json"))


def test_parts_are_ordered_ranges_with_a_manifest(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id * 7919 % 5000 as k", "cast(id as string) as v").repartition(7)
    path = str(tmp_path / "parts")
    sinks.write_parts(rows, path, "k")
    manifest = [r.asDict(True) for r in spark.read.json(f"{path}/_manifest").orderBy("part").collect()]
    assert sum(m["rows"] for m in manifest) == 5000 and all(a["last"]["k"] < b["first"]["k"] for a, b in itertools.pairwise(manifest))
    read = [json.loads(x)["k"] for m in manifest for x in (tmp_path / "parts" / m["part"]).read_text().splitlines()]
    assert read == list(range(5000))


def test_only_changed_files_are_lexed(spark, tmp_path):
    top = tmp_path / "w"
    for i in range(6):
        (top / f"p/src/f{i}.ts").parent.mkdir(parents=True, exist_ok=True)
        (top / f"p/src/f{i}.ts").write_text(f"export const v{i} = {i};\n")
    (top / "p/project.json").write_text('{"name": "p"}')
    (top / "p/src/broken.ts").write_text("export function ( {")

    def run():
        store = FactStore(spark, str(tmp_path / "store"))
        found = facts(read_workspace(spark, str(top)), store)
        return store.lexed, sorted(r["name"] for r in found["exports"].collect()), store

    assert run()[:2] == (7, [f"v{i}" for i in range(6)])
    (top / "p/src/f3.ts").write_text("export const changed = 1;\n")
    (top / "p/src/f4.ts").unlink()
    assert run()[:2] == (1, ["changed", "v0", "v1", "v2", "v5"])
    (top / "p/src/f3.ts").write_text("export const v3 = 3;\n")  # as it was: still known
    lexed, got, store = run()
    assert (lexed, got) == (0, ["v0", "v1", "v2", "v3", "v5"])
    for i in range(8):
        texts = [("f0.ts", f"export const again{i} = 1;"), ("f1.ts", "export const v1 = 1;"), (None, None)]
        got = {r["path"]: r["all"] for r in store.statements(spark.createDataFrame(texts, "path string, content string").where("path is not null")).collect()}
        assert got == {"f0.ts": [f"export const again{i} = 1"], "f1.ts": ["export const v1 = 1"]} and store.lexed == (2 if i == 0 else 1)
    assert len(store.generations()) < 8  # written as one when most was passed over


def test_command_line(spark, root, tmp_path, capsys):
    out = tmp_path / "full.json"
    assert cli.main(["-d", root, "-t", "false", "-p", "shop,ui,util", "analyze", "-o", str(out)], spark) == 0
    assert json.loads(out.read_text())["unused"]["orphan_files"]
    assert cli.main(["-d", root, "--store", str(tmp_path / "store"), "--fail-on", "cycles,boundaries", "cycles"], spark) == 2
    assert "helper.ts" in capsys.readouterr().out
    assert cli.main(["-d", root, "graph", "--level", "file"], spark) == 1
