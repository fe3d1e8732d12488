"""Reports: what analyses found as JSON, SARIF, diagrams, a page and text, and the exit code of a policy.

Rows are ordered and written as text by Spark; a document is put together from them as they come, one partition
at a time, so a report may be larger than the driver.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from pathlib import Path
from typing import IO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import SCRIPT_ESCAPES, mermaid_line, node_id
from loomgraph.operators import usage
from loomgraph.operators.findings import SARIF_RULES, sarif_results
from loomgraph.plans.analyses import Analysis
from loomgraph.plans.sinks import json_rows, lines, read_keys, write_json, write_keys


def full_report(a: Analysis) -> dict:
    """Every analysis, as a nest of tables for ``write_json``."""
    parts = {"resolution": a.resolution_health(), "stats": a.stats(), "unused": a.unused(), "entities": a.entity_tables()}
    singles = {"source_files": a.source_files(), "move_candidates": a.move_candidates(), "boundaries": a.boundaries(), "react_usage": a.react_usage(), "template_usages": a.template_usages.orderBy("component_path", "target_path", "target"), "file_cycles": a.file_cycles()}
    return parts | {"skipped_configurations": a.ws.skipped.orderBy("path")} | singles


def mermaid(deps: DataFrame) -> Iterator[str]:
    """The lines of a Mermaid diagram of the project graph; lazy edges are dashed."""
    yield "graph LR"
    line = mermaid_line(node_id(F.col("from_project")), node_id(F.col("to_project")), F.col("count"), F.col("lazy"))
    yield from lines(deps.orderBy("from_project", "to_project").select(line))


def project_dot(deps: DataFrame) -> Iterator[str]:
    """The lines of the project graph for Graphviz."""
    yield "digraph projects {"
    style = F.when(F.col("lazy"), ", style=dashed").otherwise("")
    yield from lines(deps.orderBy("from_project", "to_project").select(F.format_string('  "%s" -> "%s" [label="%d"%s];', "from_project", "to_project", "count", style)))
    yield "}"


def file_dot(edges: DataFrame) -> Iterator[str]:
    """The lines of the file graph for Graphviz."""
    yield "digraph files {"
    yield from lines(edges.orderBy("src", "dst").select(F.format_string('  "%s" -> "%s";', "src", "dst")))
    yield "}"


def sarif(a: Analysis) -> dict:
    """Findings of six rules in SARIF 2.1.0, as a nest for ``write_json``."""
    place = F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    results = sarif_results(a.found()).orderBy("rule", "file", "text").select(F.col("rule").alias("ruleId"), "level", F.struct("text").alias("message"), place.alias("locations"))
    driver = {"name": "loomgraph", "rules": [{"id": r, "defaultConfiguration": {"level": level}} for r, level in SARIF_RULES.items()]}
    return {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": _one({"tool": {"driver": driver}, "results": results})}


def _one(part: dict) -> Iterator[str]:
    """An array of one nest."""
    text = io.StringIO()
    write_json(text, part)
    yield text.getvalue()


_PAGE = """<!doctype html><meta charset="utf-8"><title>Workspace report</title><style>body{font:14px sans-serif;margin:2em}td,th{padding:2px 8px;text-align:left}th{cursor:pointer}</style>
<input id="q" placeholder="search"> <select id="project"><option value="">all projects</option></select> <select id="tag"><option value="">all tags</option></select> <select id="kind"><option value="">all kinds</option></select>
<div id="out"></div><script>
const report = %s;
const tables = Object.entries(report).flatMap(([k, v]) => Array.isArray(v) ? [[k, v]] : Object.entries(v).map(([j, w]) => [k + " / " + j, w]));
const projects = report.stats.projects, tagsOf = Object.fromEntries(projects.map(p => [p.name, p.tags || []])), sorted = {};
const named = r => [r.project, r.from_project, r.to_project, r.home, r.package_name].filter(Boolean).concat(r.root !== undefined ? [r.name] : []);
const chosen = id => document.getElementById(id).value;
function fill(id, values) { for (const v of [...new Set(values)].sort()) document.getElementById(id).add(new Option(v, v)); document.getElementById(id).onchange = show; }
function fits(r) {
  const project = chosen("project"), tag = chosen("tag"), kind = chosen("kind"), own = named(r);
  return JSON.stringify(r).toLowerCase().includes(chosen("q").toLowerCase()) && (!project || !own.length || own.includes(project))
    && (!tag || !own.length || own.some(p => (tagsOf[p] || []).includes(tag))) && (!kind || r.kind === undefined || r.kind === kind);
}
function show() {
  const out = document.getElementById("out");
  out.textContent = "";
  for (const [name, list] of tables) {
    const found = list.filter(fits), h = document.createElement("h2"), t = document.createElement("table"), columns = [...new Set(list.flatMap(Object.keys))], by = sorted[name];
    if (by) found.sort((a, b) => by.way * (a[by.column] > b[by.column] ? 1 : a[by.column] < b[by.column] ? -1 : 0));
    h.textContent = name + " (" + found.length + ")";
    const top = t.createTHead().insertRow();
    for (const c of columns) {
      const th = document.createElement("th");
      th.textContent = c;
      th.onclick = () => { sorted[name] = { column: c, way: by && by.column === c ? -by.way : 1 }; show(); };
      top.append(th);
    }
    const body = t.createTBody();
    for (const r of found) { const tr = body.insertRow(); for (const c of columns) tr.insertCell().textContent = typeof r[c] === "object" ? JSON.stringify(r[c]) : r[c] ?? ""; }
    out.append(h, t);
  }
}
fill("project", projects.map(p => p.name));
fill("tag", projects.flatMap(p => p.tags || []));
fill("kind", tables.flatMap(([, list]) => list.map(r => r.kind).filter(Boolean)));
document.getElementById("q").oninput = show; show();
</script>"""


class _Safe:
    """A stream into a page's script."""

    def __init__(self, out: IO[str]):
        self.out = out

    def write(self, text: str) -> None:
        for char, escape in SCRIPT_ESCAPES:
            text = text.replace(char, escape)
        self.out.write(text)


def html(a: Analysis, out: IO[str]) -> None:
    """One page that works offline, with the report in it, a search over it, filters and sorting by column."""
    head, tail = _PAGE.split("%s")
    out.write(head)
    write_json(_Safe(out), full_report(a))
    out.write(tail)


def text_table(df: DataFrame, title: str, most: int | None = None) -> Iterator[str]:
    """A result as lines of text; with ``most``, a preview that says how many more there are."""
    total = df.count()
    yield f"{title} ({total})"
    for r in json_rows(df if most is None else df.limit(most)):
        yield "  " + "  ".join(str(v) for v in json.loads(r).values())
    if most is not None and total > most:
        yield f"  ... and {total - most} more"


def write(part: dict, path: str) -> None:
    """A nest as a JSON file."""
    with Path(path).open("w") as out:
        write_json(out, part)


def write_baseline(a: Analysis, path: str) -> None:
    """The sorted finding keys as a document, or as a folder of parts if the path doesn't end in .json."""
    write_keys(a.finding_keys(), path)


def policy(a: Analysis, fail_on: list[str] | None = None, baseline: str | None = None, strict: bool = False) -> int:
    """0: fine; 2: findings of a category of ``fail_on``, new ones if there is a baseline; 3: unresolved imports under ``strict``."""
    if strict and not a.resolution_health()["unresolved_internal"].isEmpty():
        return 3
    if not fail_on:
        return 0
    keys = a.finding_keys()
    if baseline is not None:
        keys = usage.new_findings(keys, read_keys(keys.sparkSession, baseline))
    if "all" not in fail_on:
        keys = keys.where(usage.fail_category(F.col("key")).isin(*fail_on))
    return 0 if keys.isEmpty() else 2
