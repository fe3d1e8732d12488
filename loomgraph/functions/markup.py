"""Component templates and selectors as column expressions: elements, attributes, pipes, matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.brackets import PAIR, paired_parentheses, unmarked

_ELEMENT = r"""<([A-Za-z0-9_-]+)((?:\s*[^\s=>/"']+\s*=\s*(?:"[^"]*"|'[^']*')|[^>])*)>"""
_ATTRIBUTE = r"""[^\s=>/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))?"""
_PIPE = r"(?<!\|)\|(?!\|)\s*([A-Za-z0-9_$]+)"
#: Of parentheses by pairs.
_BLOCK = rf"(?s)@\w+\s*\(({PAIR})(.*?)\1\)"


def without_comments(html: Column) -> Column:
    """Markup without its comments; one that is not closed runs to the end."""
    return F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")


def attribute_name(raw: Column) -> Column:
    """An attribute's name without binding marks; null for references and animations."""
    plain = F.regexp_replace(raw, r"^\[\((.*)\)\]$|^\[(?:attr\.)?(.*)\]$|^\((.*)\)$|^\*(.*)$", "$1$2$3$4")
    return F.when(~raw.rlike(r"^[#@]"), plain)


def is_binding(raw: Column) -> Column:
    """Whether an attribute's value is an expression."""
    return raw.rlike(r"^\[.*\]$|^\(.*\)$|^\*")


def elements(html: Column) -> Column:
    """Array of (tag, attributes, classes) of the opening tags."""
    tags = F.regexp_extract_all(without_comments(html), F.lit(_ELEMENT), F.lit(0))

    def element(tag: Column) -> Column:
        inside = F.regexp_extract(tag, _ELEMENT, 2)
        raw = F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), F.lit(0))
        names = F.transform(raw, lambda a: attribute_name(F.regexp_extract(a, r"^([^\s=]+)", 1)))
        valued = F.filter(raw, lambda a: (attribute_name(F.regexp_extract(a, r"^([^\s=]+)", 1)) == "class") & a.contains("="))
        classes = F.flatten(F.transform(valued, lambda a: F.filter(F.split(F.regexp_replace(a, r"""^[^=]*=\s*|["']""", ""), r"\s+"), lambda c: c != "")))
        return F.struct(
            F.regexp_extract(tag, _ELEMENT, 1).alias("tag"), F.array_sort(F.array_distinct(F.array_compact(names))).alias("attributes"),
            F.array_sort(F.array_distinct(classes)).alias("classes"),
        )

    return F.transform(tags, element)


def pipes_in(expression: Column) -> Column:
    """Names after a single ``|``."""
    return F.regexp_extract_all(expression, F.lit(_PIPE), F.lit(1))


def interpolation_pipes(text: Column) -> Column:
    """Pipes within ``{{ }}``."""
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)\{\{(.*?)\}\}"), F.lit(1)), pipes_in))


def template_pipes(html: Column) -> Column:
    """Sorted names of all pipes of a template: interpolations, bindings and control flow."""
    clean = without_comments(html)
    text = F.regexp_replace(clean, r"""<[A-Za-z/!](?:"[^"]*"|'[^']*'|[^>"'])*>""", "<")
    tags = F.regexp_extract_all(clean, F.lit(_ELEMENT), F.lit(2))
    raw = F.flatten(F.transform(tags, lambda t: F.regexp_extract_all(t, F.lit(_ATTRIBUTE), F.lit(0))))
    bound = F.filter(raw, lambda a: is_binding(F.regexp_extract(a, r"^([^\s=]+)", 1)) & a.contains("="))
    flow = F.regexp_extract_all(paired_parentheses(text), F.lit(_BLOCK), F.lit(2))
    found = F.concat(
        interpolation_pipes(text), F.flatten(F.transform(raw, interpolation_pipes)), F.flatten(F.transform(bound, pipes_in)), F.flatten(F.transform(flow, pipes_in)),
    )
    return F.array_sort(F.array_distinct(found))


def parse_selector(selector: Column) -> Column:
    """Alternatives (element, attributes, classes) of a selector list; ``:not(...)`` and the like are skipped."""
    plain = unmarked(F.regexp_replace(paired_parentheses(selector), rf":[A-Za-z-]+(?:\(({PAIR}).*?\1\))?|\(({PAIR}).*?\2\)", ""))

    def alternative(text: Column) -> Column:
        text = F.trim(text)
        return F.struct(
            F.nullif(F.regexp_extract(text, r"^([A-Za-z0-9_-]+)", 1), F.lit("")).alias("element"),
            F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\]=]*)[^\]]*\]"), F.lit(1)), F.trim), lambda a: a != "").alias("attributes"),
            F.regexp_extract_all(F.regexp_replace(text, r"\[[^\]]*\]", ""), F.lit(r"\.([A-Za-z0-9_-]+)"), F.lit(1)).alias("classes"),
        )

    parsed = F.transform(F.split(plain, ","), alternative)
    return F.filter(parsed, lambda s: s.element.isNotNull() | (F.size(s.attributes) > 0) | (F.size(s.classes) > 0))


def matches(selectors: Column, element: Column) -> Column:
    """Whether any alternative matches the element."""
    return F.exists(
        selectors,
        lambda s: (s.element.isNull() | (s.element == element["tag"])) & (F.size(F.array_except(s.attributes, element["attributes"])) == 0) & (F.size(F.array_except(s.classes, element["classes"])) == 0),
    )
