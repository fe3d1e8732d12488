"""Text functions of reports and configuration files as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_jsonc(text: Column) -> Column:
    """JSON without comments and trailing commas; what strings hold stays."""
    string = r'"(?:[^"\\]|\\.)*+"'
    bare = F.regexp_replace(text, rf"(?s)({string})|//[^\n]*|/\*.*?(?:\*/|\z)", "$1")
    return F.regexp_replace(bare, rf"(?s)({string})|,(\s*[\]}}])", "$1$2")


def json_object(text: Column, schema: str) -> Column:
    """A JSON object with comments as a struct of ``schema``; null if it can't be parsed or is something else."""
    clean = strip_jsonc(text)
    return F.when(F.try_parse_json(clean).isNotNull() & clean.rlike(r"^\s*\{"), F.from_json(clean, schema))


def version_major(version: Column) -> Column:
    """The first run of digits as a number, null if there is none."""
    return F.nullif(F.regexp_extract(version, r"(\d+)", 1), F.lit("")).cast("int")


def node_id(name: Column) -> Column:
    """A name as a diagram's node id."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}]", "_")


def mermaid_line(source: Column, target: Column, count: Column, lazy: Column) -> Column:
    """An edge of a Mermaid diagram between node ids; lazy ones are dashed."""
    return F.format_string("  %s %s|%d| %s", source, F.when(lazy, "-.->").otherwise("-->"), count, target)


#: What JSON within a page's script may not hold, and what stands for it.
SCRIPT_ESCAPES = (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029"))


def html_safe(json: Column) -> Column:
    """JSON that may stand within a page's script."""
    for char, escape in SCRIPT_ESCAPES:
        json = F.replace(json, F.lit(char), F.lit(escape))
    return json
