"""Source files to facts: one small lexer per file, everything else as column expressions.

A file becomes its top-level statements in a canonical spelling: comments gone, tokens apart by one
space, strings in double quotes. Facts are then extracted by regular expressions over statements, in
Spark's own functions, and joined as tables.
"""

from __future__ import annotations

import json
import re
import time

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from loomgraph.functions.brackets import PAIR, paired, unmarked

_TOKEN = re.compile(
    r"(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|[^\S\n]+)|(?P<line>\n)|(?P<string>'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\")|(?P<template>`(?:[^`\\]|\\.)*`)"
    r"|(?P<word>[A-Za-z_$#][\w$]*|\d[\w.]*)|(?P<mark>=>|\.\.\.|\?\.|.)",
    re.S,
)
_REGEX = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_OPEN, _CLOSE = "([{", {")": "(", "]": "[", "}": "{"}
_STARTS = frozenset("import export const let var function class interface type enum abstract async declare namespace module if for while do switch try return throw @".split())
_JOINS_BEFORE = frozenset("export default async abstract declare from extends implements new typeof await = , | & => ( [ { . ?. ? : + - * / < ! && ||".split())
_JOINS_AFTER = frozenset("else catch finally from as extends implements . ?. , = | & ? : + - * / => && || ) ] } instanceof".split())


def split_statements(text: str | None) -> list[str] | None:
    """Top-level statements of a script, canonically spelt; None if its brackets don't match."""
    text = text or ""
    statements, now, stack, fresh, at = [], [], [], False, 0
    last = ""
    while at < len(text):
        m = _TOKEN.match(text, at)
        kind, token = m.lastgroup, m.group()
        if token == "/" and (last == "" or last in "(,=:[!&|?{};" or last in ("return", "=>")) and not (last == "}" and text.startswith("/>", at)) and (r := _REGEX.match(text, at)):
            kind, token, m = "string", '"' + r.group() + '"', r
        at = m.end()
        if kind == "skip":
            continue
        if kind == "line":
            fresh = True
            continue
        if kind == "string":
            token = json.dumps(token[1:-1], ensure_ascii=False)
        elif kind == "template":
            inner = re.findall(r"\$\{([^}]*)\}", token)
            token = " ".join([json.dumps(token[1:-1], ensure_ascii=False), *("( " + " ".join(x.group() for x in _TOKEN.finditer(e) if x.lastgroup in ("word", "mark")) + " )" for e in inner)])
        if not stack and now and (fresh and last not in _JOINS_BEFORE and token not in _JOINS_AFTER and not (now[0] == "@" and "class" not in now)):
            if token in _STARTS or last in (")", "}") or last[:1] in '"' or last[:1].isalnum() or last[:1] in "_$]":
                statements.append(now)
                now = []
        fresh = False
        if token in _OPEN:
            stack.append(token)
        elif token in _CLOSE:
            if not stack or stack.pop() != _CLOSE[token]:
                return None
        if token == ";" and not stack:
            if now:
                statements.append(now)
            now = []
        else:
            now.append(token)
        last = token
    if stack:
        return None
    return [" ".join(s) for s in [*statements, now] if s]


@F.pandas_udf(StructType([StructField("all", ArrayType(StringType())), StructField("took_us", LongType())]))
def statements(content: pd.Series) -> pd.DataFrame:
    """``split_statements`` of a column, and the microseconds that each text took."""
    found, took = [], []
    for text in content:
        began = time.perf_counter_ns()
        found.append(split_statements(text))
        took.append((time.perf_counter_ns() - began) // 1000)
    return pd.DataFrame({"all": pd.Series(found, dtype=object), "took_us": took})


_STRING = r'"(?:[^"\\]|\\.)*"'
#: Of a statement's brackets by pairs.
_DECORATORS = rf"^(?:@ [\w$.]+(?: \. [\w$]+)* (?:\(({PAIR}).*?\1\) )?)+(?=export |abstract |class |default )"
_NAME = r"([A-Za-z_$][\w$]*)"


def _flat(marked: Column) -> Column:
    """A statement, brackets by pairs, without strings and what brackets hold."""
    return F.regexp_replace(F.regexp_replace(marked, _STRING, "''"), rf"[(\[{{]({PAIR}).*?\1[)\]}}]", "_")


def _variables(flat: Column) -> Column:
    """Names that a flat variable statement declares."""
    body = F.regexp_extract(flat, r"^(?:export )?(?:declare )?(?:const|let|var) (.*)$", 1)
    return F.filter(F.transform(F.split(body, " , "), lambda d: F.regexp_extract(d, rf"^{_NAME}(?: [=:!].*)?$", 1)), lambda n: n != "")


def identifiers(stmt: Column) -> Column:
    """Distinct identifiers of a statement: no property names after a dot, no keys of object literals."""
    plain = F.regexp_replace(stmt, _STRING, '""')
    found = F.regexp_extract_all(plain, F.lit(rf"(?<=[{{,] )[A-Za-z_$][\w$]*(?= : )|(?<![\w$])(?<!(?<!\.)\. )(?<!\?\. ){_NAME}"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda n: n != ""))


def lexed(files: DataFrame, *kept: str) -> DataFrame:
    """(path, .., all, took_us): the statements of each file, null where brackets don't match, and the time it took; columns named in ``kept`` stay."""
    return files.select("path", *kept, statements("content").alias("s")).select("path", *kept, "s.all", "s.took_us")


def units(files: DataFrame) -> DataFrame:
    """``units_of`` files (path, content)."""
    return units_of(lexed(files))


def units_of(split: DataFrame) -> DataFrame:
    """(path, n, stmt, marked, head, flat) of every statement, ``marked`` with brackets by pairs; files whose brackets don't match have none."""
    out = split.where("all is not null").select("path", F.posexplode("all").alias("n", "stmt"))
    bare = F.regexp_replace("marked", _DECORATORS, "")
    return out.withColumn("marked", paired("stmt")).withColumn("head", unmarked(bare)).withColumn("flat", unmarked(_flat(bare)))


def imports(u: DataFrame) -> DataFrame:
    """(path, n, source, name, alias, kind): local names with, as alias, the exported one if it differs."""
    rows = u.where(F.col("stmt").rlike(r'^import (?!\()')).select(
        "path", "n", F.regexp_replace(F.regexp_extract("stmt", rf'(?:^import| from) ({_STRING})', 1), '^"|"$', "").alias("source"),
        F.regexp_extract("stmt", r'^import (?:type (?!from ))?(.*) from "', 1).alias("clause"),
    ).where("source <> ''")
    item = lambda name, alias, kind: F.struct(name.alias("name"), alias.alias("alias"), F.lit(kind).alias("kind"))
    default, star = F.regexp_extract("clause", rf"^{_NAME}(?: ,|$)", 1), F.regexp_extract("clause", rf"\* as {_NAME}", 1)
    named = F.filter(F.split(F.regexp_extract("clause", r"\{ (.*?) ?\}", 1), " ?, ?"), lambda x: x != "")

    def specifier(x: Column) -> Column:
        x = F.regexp_replace(x, r"^type (?!as )", "")
        return item(F.regexp_extract(x, rf"{_NAME}$", 1), F.when(x.contains(" as "), F.regexp_extract(x, r"^([\w$]+)", 1)), "Named")

    none = F.lit(None).cast("string")
    items = F.concat(
        F.when(default != "", F.array(item(default, none, "Default"))).otherwise(F.array()), F.when(star != "", F.array(item(star, none, "Namespace"))).otherwise(F.array()),
        F.transform(named, specifier), F.when(F.col("clause") == "", F.array(item(F.lit("").cast("string"), none, "SideEffect"))).otherwise(F.array()),
    )
    return rows.select("path", "n", "source", F.posexplode(items).alias("k", "i")).select("path", "n", "k", "source", "i.name", "i.alias", "i.kind")


def dynamic_imports(u: DataFrame) -> DataFrame:
    """(path, source) of ``import("...")`` calls."""
    return u.select("path", F.explode(F.regexp_extract_all("stmt", F.lit(r'(?<![\w$.] )import \( "([^"]*)" \)'), F.lit(1))).alias("source"))


#: Declaration keywords and the export kinds they give.
KINDS = {"class": "Class", "function": "Function", "const": "Variable", "let": "Variable", "var": "Variable", "interface": "Interface", "type": "TypeAlias", "enum": "Enum", "const enum": "Enum"}
_DECLARATION = rf"(?:declare )?(?:abstract )?(?:async )?(const enum|class|function|interface|type|enum|const|let|var)(?: \*)? {_NAME}"


def _declared(u: DataFrame, prefix: str) -> DataFrame:
    word, name = F.regexp_extract("head", prefix + _DECLARATION, 1), F.regexp_extract("head", prefix + _DECLARATION, 2)
    names = F.when(word.isin("const", "let", "var"), _variables(F.col("flat"))).when(word != "", F.array(name)).otherwise(F.array().cast("array<string>"))
    return u.select("*", word.alias("word"), F.explode(names).alias("name"))


def exports(u: DataFrame) -> DataFrame:
    """(path, n, name, kind, from_module, original): one row for each exported name."""
    none = F.lit(None).cast("string")
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    plain = _declared(u, "^export ").select("path", "n", "name", kind[F.col("word")].alias("kind"), none.alias("from_module"), F.col("name").alias("original"))
    given = F.regexp_extract("head", r"^export default (?:async )?(?:abstract )?(?:class|function)(?: \*)? (?!extends |implements )([A-Za-z_$][\w$]*)", 1)
    default = u.where("head like 'export default %'").select("path", "n", F.when(given == "", "default").otherwise(given).alias("name"), F.lit("Default").alias("kind"), none.alias("from_module"), F.lit("default").alias("original"))
    source = F.nullif(F.regexp_extract("head", r' from "([^"]*)"$', 1), F.lit(""))
    stars = u.where(F.col("head").rlike(r'^export (?:type )?\* ')).withColumn("ns", F.regexp_extract("head", rf"^export (?:type )?\* as {_NAME}", 1))
    stars = stars.select(
        "path", "n", F.when(F.col("ns") == "", F.concat(F.lit("* from "), source)).otherwise(F.col("ns")).alias("name"),
        F.when(F.col("ns") == "", "ReExportAll").otherwise("ReExport").alias("kind"), source.alias("from_module"), F.lit("*").alias("original"),
    )
    listed = u.where(F.col("head").rlike(r"^export (?:type )?\{")).select("path", "n", source.alias("from_module"), F.explode(F.split(F.regexp_extract("head", r"\{ (.*?) ?\}", 1), " ?, ?")).alias("x")).where("x <> ''")
    listed = listed.withColumn("x", F.regexp_replace("x", r"^type (?!as )", "")).select("path", "n", F.regexp_extract("x", r"([\w$]+)$", 1).alias("name"), F.lit("ReExport").alias("kind"), "from_module", F.regexp_extract("x", r"^([\w$]+)", 1).alias("original"))
    return plain.unionByName(default).unionByName(stars).unionByName(listed)


def top_names(u: DataFrame) -> DataFrame:
    """(path, n, name) of names that statements declare."""
    default = exports(u).where("kind = 'Default'").select("path", "n", "name")
    return _declared(u, "^(?:export )?").select("path", "n", "name").unionByName(default)


def used_names(u: DataFrame) -> DataFrame:
    """(path, name): identifiers that occur outside import declarations."""
    return u.where(~F.col("stmt").rlike(r"^import (?!\()")).select("path", F.explode(identifiers(F.col("stmt"))).alias("name")).distinct()


def local_references(u: DataFrame) -> DataFrame:
    """(path, from_name, to_name) between names of one file; from statements that declare none, from_name is empty."""
    names = top_names(u)
    counted = u.where(~F.col("head").rlike(r"^import (?!\()|^export (?:type )?[{*]"))
    used = counted.select("path", "n", F.explode(identifiers(F.col("stmt"))).alias("to_name")).join(names.select("path", F.col("name").alias("to_name")).distinct(), ["path", "to_name"])
    used = used.join(names.select("path", "n", F.col("name").alias("to_name")), ["path", "n", "to_name"], "left_anti")
    return used.join(names.select("path", "n", F.col("name").alias("from_name")), ["path", "n"], "left").select("path", F.coalesce("from_name", F.lit("")).alias("from_name"), "to_name").distinct()


def jsx_usages(u: DataFrame) -> DataFrame:
    """(path, component, props) of each capitalised opening tag in files that may hold some."""
    text = F.regexp_replace(F.regexp_replace("marked", _STRING, "''"), "=>", "~")
    text = unmarked(F.regexp_replace(text, rf"\{{({PAIR})[^<]*?\1\}}", "''"))  # what braces hold goes unless there is a tag in it
    tags = F.regexp_extract_all(text, F.lit(r"(?<![\w$)\]] )< [A-Z][\w$]*(?: [^<>]*?)?(?: /)? >"), F.lit(0))
    found = u.where(F.col("path").rlike(r"\.[tj]sx$")).select("path", F.explode(tags).alias("tag"))
    props = F.regexp_extract_all(F.regexp_replace("tag", r"^< [\w$]+|''|/? >$|\{[^{}]*\}", " "), F.lit(r"([A-Za-z_][\w$]*)"), F.lit(1))
    return found.select("path", F.regexp_extract("tag", r"^< ([\w$]+)", 1).alias("component"), props.alias("props"))


def react_components(u: DataFrame) -> DataFrame:
    """(path, name, wrapped) of capitalised functions, function constants and wrapped ones in script files with markup."""
    scripts = u.where(F.col("path").rlike(r"\.[tj]sx$"))
    named = _declared(scripts, "^(?:export )?").where("name rlike '^[A-Z]'")
    wrapped = F.col("head").rlike(r"= (?:[\w$]+ \. )?(?:memo|forwardRef) (?:< .* > )?\(")
    arrow = F.col("head").rlike(r"^(?:export )?(?:const|let|var) [^=]*= (?:async )?(?:function|\(.*?\)(?: :.*?)? =>|[\w$]+ =>)")
    plain = named.where((F.col("word") == "function") | (F.col("word").isin("const", "let", "var") & (arrow | wrapped))).select("path", "name", (wrapped & (F.col("word") != "function")).alias("wrapped"))
    default = scripts.select("path", F.regexp_extract("head", r"^export default (?:async )?function ([A-Z][\w$]*)", 1).alias("name"), F.lit(False).alias("wrapped")).where("name <> ''")
    return plain.unionByName(default)


def entities(u: DataFrame) -> DataFrame:
    """Decorated classes: path, name, kind and what their metadata says."""
    decorator = "(?:^| )@ (Component|Injectable|NgModule|Directive|Pipe) "
    kind = F.regexp_extract("stmt", rf"{decorator}\(", 1)
    meta = F.regexp_extract("marked", rf"{decorator}\(({PAIR}) (\{{.*?\}}) ,? ?\2\)", 3)
    found = u.select("path", kind.alias("kind"), meta.alias("meta"), F.regexp_extract("head", rf"(?:^| )class {_NAME}", 1).alias("name"), F.regexp_extract("marked", r"(?:^| )class [A-Za-z_$].*?(\{.*)$", 1).alias("body")).where("kind <> '' and name <> ''")
    own = rf"[{{,](?:{PAIR})?"  # what stands before a key
    value = lambda key: F.nullif(F.regexp_extract("meta", rf'{own} {key} : "((?:[^"\\]|\\.)*)"', 1), F.lit(""))
    listed = lambda key: unmarked(F.regexp_extract("meta", rf"{own} {key} : \[({PAIR}) (.*?) ?\1\]", 2))
    idents = lambda key: F.regexp_extract_all(F.regexp_replace(listed(key), _STRING, '""'), F.lit(rf"(?<!(?<!\.)\. ){_NAME}"), F.lit(1))
    member = lambda mark, call: F.transform(
        F.regexp_extract_all("body", F.lit(rf"@ {mark} (?:\(({PAIR}).*?\1\) )?(?:(?:public|protected|private|readonly|override) )*[A-Za-z_$][\w$]*|[A-Za-z_$][\w$]*(?: : [^=;]+?)? = (?:{call})(?: \. [\w$]+)?(?: < [^=;]*? >)? \("), F.lit(0)),
        lambda x: F.when(x.startswith("@"), F.regexp_extract(x, r"([\w$]+)$", 1)).otherwise(F.regexp_extract(x, r"^([\w$]+)", 1)),
    )
    strings = lambda key: F.regexp_extract_all(listed(key), F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    truth = lambda key: F.nullif(F.regexp_extract("meta", rf"{own} {key} : (true|false)", 1), F.lit("")).cast("boolean")
    host = unmarked(F.regexp_extract("meta", rf"{own} host : \{{({PAIR}) (.*?) ?\1\}}", 2))
    bindings = F.regexp_extract_all(host, F.lit(r'(?:"(?:[^"\\]|\\.)*"|[\w$-]+) : "((?:[^"\\]|\\.)*)"'), F.lit(1))
    apart = lambda xs: F.filter(xs, lambda x, i: (i == 0) | (x != F.get(xs, i - 1)))
    return found.select(
        "path", "name", "kind", value("selector").alias("selector"), value("templateUrl").alias("template_path"), value("template").alias("template_inline"), value("name").alias("pipe_name"),
        value("providedIn").alias("provided_in"), truth("standalone").alias("standalone"), F.coalesce(truth("pure"), F.lit(True)).alias("pure"),
        F.concat(strings("styleUrls"), F.array_compact(F.array(value("styleUrl")))).alias("style_paths"), bindings.alias("host_bindings"),
        *[idents(k).alias(k) for k in ("imports", "declarations", "exports", "providers", "bootstrap")], apart(member("Input", "input|model")).alias("inputs"), apart(member("Output", "output")).alias("outputs"),
    )
