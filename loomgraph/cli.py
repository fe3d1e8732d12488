"""Command line: ``python -m loomgraph.cli -d WORKSPACE stats`` and the like."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterable
from pathlib import Path
from typing import IO

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.usage import FAIL_PREFIXES
from loomgraph.plans import report
from loomgraph.plans.analyses import Analysis
from loomgraph.plans.crosscheck import crosscheck
from loomgraph.plans.sinks import write_json
from loomgraph.sources.store import FactStore
from loomgraph.sources.workspace import ALL_SCRIPTS, TS_ONLY, read_workspace


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph")
    p.add_argument("-d", "--directory", "--project-path", default=".")
    p.add_argument("-v", "--verbose", action="store_true", help="counts of facts and time taken, to stderr")
    p.add_argument("-p", "--projects", help="only these projects are read, by names apart by commas")
    p.add_argument("-t", "--typescript-only", choices=("true", "false"), default="true")
    p.add_argument("-n", "--exclude-node-modules", choices=("true", "false"), default="true", help="false: files of ignored folders below a project are the project's")
    p.add_argument("--rules", help="files of boundary rules in the workspace's root, apart by commas; the first that exists counts")
    p.add_argument("--store", help="folder for what was read off files; with it, only changed files are lexed again")
    p.add_argument("--baseline")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--fail-on", default="", help="categories apart by commas: unused, cycles, boundaries, all")
    sub = p.add_subparsers(dest="command")
    for name in ("analyze", "html", "sarif", "baseline"):
        sub.add_parser(name).add_argument("-o", "--output", default={"html": "report.html", "sarif": "report.sarif"}.get(name, f"{name}.json"))
    for name in ("stats", "unused", "move-candidates", "cycles", "boundaries"):
        s = sub.add_parser(name)
        s.add_argument("--project", dest="shown")
        if name == "unused":
            s.add_argument("--kind", action="append", default=[])
    sub.add_parser("crosscheck", help="unused findings that a search of texts contradicts")
    s = sub.add_parser("usages")
    s.add_argument("symbol")
    s.add_argument("--from", dest="from_project")
    g = sub.add_parser("graph")
    g.add_argument("--format", choices=("mermaid", "dot", "json"), default="mermaid")
    g.add_argument("--level", choices=("project", "file"), default="project")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one command; returns the exit code: 0, 1 for an error, or that of the policy."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("loomgraph").getOrCreate()
    try:
        categories = [c for c in args.fail_on.split(",") if c]
        if wrong := set(categories) - {*FAIL_PREFIXES, "all"}:
            raise ValueError(f"no such category: {', '.join(sorted(wrong))}")
        began = time.monotonic()
        only = args.projects.split(",") if args.projects else None
        a = Analysis(read_workspace(spark, args.directory, only, TS_ONLY if args.typescript_only == "true" else ALL_SCRIPTS, args.rules, args.exclude_node_modules == "true"), store=FactStore(spark, args.store) if args.store else None)
        if args.verbose:
            counts = ", ".join(f"{df.count()} {name.replace('_', ' ')}" for name, df in a.f.items())
            print(f"{counts}; {time.monotonic() - began:.1f} s", file=sys.stderr)
            say(report.text_table(a.timings(), "Reading by project"), sys.stderr)
        lost = a.resolution_health()["unresolved_internal"]
        for r in a.ws.skipped.orderBy("path").collect():
            print(f"warning: {r['path']} can't be parsed and is skipped", file=sys.stderr)
        if not lost.isEmpty():
            say(report.text_table(lost, "Imports without a target", 10), sys.stderr)
        command = args.command or "analyze"
        if command == "baseline":
            report.write_baseline(a, args.output)
            return 0
        show(a, command, args)
        return report.policy(a, categories, args.baseline, args.strict)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def say(lines: Iterable[str], to: IO[str] | None = None) -> None:
    """Print lines as they come."""
    for line in lines:
        print(line, file=to or sys.stdout)


def show(a: Analysis, command: str, args: argparse.Namespace) -> None:
    """Print or write what a command asks for."""
    output = getattr(args, "output", "analyze.json")
    if command == "html":
        with Path(output).open("w") as out:
            report.html(a, out)
    elif command in ("analyze", "sarif"):
        report.write(report.sarif(a) if command == "sarif" else report.full_report(a), output)
    elif command == "stats":
        s = a.stats()
        near = (F.col("from_project") == args.shown) | (F.col("to_project") == args.shown)
        say(report.text_table(s["projects"] if not args.shown else s["projects"].where(F.col("name") == args.shown), "Projects"))
        say(report.text_table(s["dependencies"] if not args.shown else s["dependencies"].where(near), "Dependencies"))
        say(report.text_table(s["project_cycles"], "Project cycles"))
    elif command == "unused":
        kinds = [k.lower() for k in args.kind]
        for name, df in a.unused().items():
            if name in ("unused_imports", "orphan_files") and (kinds or (args.shown and name == "orphan_files")):
                continue
            if args.shown and "project" in df.columns:
                df = df.where(F.col("project") == args.shown)
            if kinds:
                df = df.where(F.lower("kind").isin(kinds))
            say(report.text_table(df, name))
    elif command == "cycles":
        say(report.text_table(a.file_cycles(), "File cycles"))
        say(report.text_table(a.stats()["project_cycles"], "Project cycles"))
    elif command == "move-candidates":
        moves = a.move_candidates()
        say(report.text_table(moves if not args.shown else moves.where((F.col("home") == args.shown) | (F.col("to_project") == args.shown)), "Move candidates"))
    elif command == "boundaries":
        say(report.text_table(a.boundaries(), "Boundary violations"))
    elif command == "crosscheck":
        found = crosscheck(a)
        for name, df in found.items():
            say(report.text_table(df, f"Unused {name} that texts contradict"))
        for name, df in a.text_mentions().items():
            say(report.text_table(df, f"Unused {name} that other files mention"))
    elif command == "usages":
        write_json(sys.stdout, a.symbol_usages(args.symbol, args.from_project))
        print()
    elif command == "graph":
        deps = a.stats()["dependencies"]
        if args.level == "file" and args.format == "mermaid":
            raise ValueError("the file graph has no Mermaid form")
        if args.format == "json":
            write_json(sys.stdout, deps if args.level == "project" else a.edges.orderBy("src", "dst"))
            print()
        elif args.level == "file":
            say(report.file_dot(a.edges))
        else:
            say(report.mermaid(deps) if args.format == "mermaid" else report.project_dot(deps))


if __name__ == "__main__":
    sys.exit(main())
