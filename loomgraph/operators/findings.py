"""Findings of all analyses as one table: keys for baselines and policies, results for scanners.

Both take tables by the name of their analysis, with the columns that ``KEYS`` and ``RESULTS`` name; what isn't
given isn't reported. Rows pass once, without a shuffle but for what makes keys distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Forms of finding keys and the columns that fill them, by analysis.
KEYS = {
    "unused_exports": ("unused:%s:%s", ("file", "name")),
    "test_only_exports": ("test-only:%s:%s", ("file", "name")),
    "export_only": ("export-only:%s:%s", ("file", "name")),
    "declared_not_rendered": ("not-rendered:%s:%s", ("file", "name")),
    "unused_imports": ("unused-import:%s:%s:%s", ("file", "name", "specifier")),
    "orphan_files": ("orphan:%s", ("file",)),
    "file_cycles": ("cycle:%s", ("members",)),
    "project_cycles": ("project-cycle:%s", ("members",)),
    "boundaries": ("boundary:%s->%s:%s", ("from_project", "to_project", "source_tag")),
}
#: Rules of the SARIF report and their levels.
SARIF_RULES = {"unused-export": "warning", "export-only": "note", "declared-not-rendered": "warning", "orphan-file": "warning", "circular-dependency": "warning", "boundary-violation": "error"}
#: The rule of each analysis, its message and the columns that fill it.
RESULTS = {
    "unused_exports": ("unused-export", "%s is exported and never used", ("name",)),
    "export_only": ("export-only", "%s is used in its own file only", ("name",)),
    "declared_not_rendered": ("declared-not-rendered", "%s is declared and never rendered", ("name",)),
    "orphan_files": ("orphan-file", "No file imports this one", ()),
    "file_cycles": ("circular-dependency", "%s", ("members",)),
    "boundaries": ("boundary-violation", "%s must not depend on %s (%s)", ("from_project", "to_project", "source_tag")),
}


def _filled(form: str, columns: tuple[str, ...], between: str) -> Column:
    """``form`` with a row's columns; arrays are joined."""
    return F.format_string(form, *[F.array_join(c, between) if c == "members" else F.col(c) for c in columns]) if columns else F.lit(form)


def _united(arms: list[DataFrame]) -> DataFrame:
    out = arms[0]
    for arm in arms[1:]:
        out = out.unionByName(arm)
    return out


def finding_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """(key) of all findings, each once."""
    return _united([tables[name].select(_filled(form, columns, "->").alias("key")) for name, (form, columns) in KEYS.items() if name in tables]).distinct()


def sarif_results(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, level, text, file) of the findings that have a rule; a cycle is at its first file, a boundary at the project's configuration."""
    places = {"file_cycles": F.element_at("members", 1), "boundaries": F.lit("project.json")}
    arms = []
    for name, (rule, form, columns) in RESULTS.items():
        if name in tables:
            place = places[name] if name in places else F.col("file")
            arms.append(tables[name].select(F.lit(rule).alias("rule"), F.lit(SARIF_RULES[rule]).alias("level"), _filled(form, columns, " -> ").alias("text"), place.alias("file")))
    return _united(arms)
