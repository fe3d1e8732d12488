"""Brackets nested fifty deep wherever the extraction meets some."""

import random
import re

from pyspark.sql import functions as F

from loomgraph.functions import markup
from loomgraph.functions.brackets import PAIR, number_pairs, paired, unmarked
from loomgraph.sources import scripts

DEEP = 50


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "x string").select(function(F.col("x")).alias("y")).first()["y"]


def nested(inner, left="(", right=")"):
    return left * DEEP + inner + right * DEEP


def facts(spark, source, path="a.tsx"):
    return scripts.units(spark.createDataFrame([(path, source)], "path string, content string"))


def test_pairs(spark):
    marked = number_pairs("a(b[c]{})d)")
    assert re.sub(PAIR, "", marked) == "a(b[c]{})d)" and re.search(rf"a\(({PAIR})(.*?)\1\)d", marked).group(2).count("\x01") == 8
    assert number_pairs("(]") == "(]" and number_pairs(None) is None and number_pairs("") == ""
    assert number_pairs("([)") == "(\x010\x01[\x010\x01)"
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("()[]{}ab") for _ in range(rng.randint(0, 30)))
        assert re.sub(PAIR, "", number_pairs(text)) == text
    assert one(spark, 'f ( "( [" )', lambda x: unmarked(paired(x))) == 'f ( "( [" )'
    assert one(spark, 'f ( "( [" )', lambda x: F.regexp_extract(paired(x), rf"\(({PAIR}) (.*?) \1\)", 2)) == '"( ["'


def test_templates(spark):
    html = "@if " + nested("a | deepPipe") + " { <p>{{ b | c }}</p> } @for (x of y | z; track f(x)) { }"
    assert one(spark, html, markup.template_pipes) == ["c", "deepPipe", "z"]
    selector = "a:not" + nested(".no") + ".yes, b:is(.x, :not([q])):hover, (c) d"
    got = one(spark, selector, markup.parse_selector)
    assert [(s["element"], s["attributes"], s["classes"]) for s in got] == [("a", [], ["yes"]), ("b", [], []), ("d", [], [])]


def test_elements_and_pipes_as_in_plain_templates(spark):
    html = '<div class="row main"><ui-button [tip]="t" (click)="go()" *when="ok">X</ui-button></div><!-- <fake-tag> --> @if (show) { <fix-badge label="x" /> } @else { <p>none</p> }'
    found = {e["tag"]: e for e in one(spark, html, markup.elements)}
    assert set(found) == {"div", "ui-button", "fix-badge", "p"} and found["ui-button"]["attributes"] == ["click", "tip", "when"] and found["div"]["classes"] == ["main", "row"]
    assert one(spark, """<span [title]="price | money:'X'">{{ items | some | async }}</span><p>{{ a || b }}</p><li *ngFor="let u of users | sorted"></li>""", markup.template_pipes) == ["async", "money", "some", "sorted"]


def test_statements(spark):
    u = facts(spark, f"const a = {nested('{ x: [1] }')}, b = f({nested('y')}), c = 1;\nexport const d = {nested('z', '[', ']')};\n")
    names = {r["name"] for r in scripts.top_names(u).collect()}
    assert names == {"a", "b", "c", "d"}
    deep = "<Card a={" + nested("{ q: 1 }") + "} b={() => " + nested("<Inner c={{ d: 1 }} />") + "} e />"
    shown = {r["component"]: r["props"] for r in scripts.jsx_usages(facts(spark, f"export const x = () => {deep};\n")).collect()}
    assert shown["Inner"] == ["c"] and "Card" not in shown or shown["Card"][0] == "a"


def test_metadata(spark):
    source = (
        f"@Wrap({nested('q', '[', ']')})\n@Component({{ selector: 'x-y', imports: [A, ...[B, [C, ns.D]], cond ? [E] : []], providers: [{{ provide: T, useFactory: () => {nested('g')} }}, P],\n"
        f"  styleUrls: ['./a.css', ...['./b.css']], host: {{ '(click)': 'go({nested('1')})', '[class.on]': 'on' }}, template: '<b class=\"k\">' }})\n"
        f"export class Deep {{ @Input({{ transform: (v) => {nested('v')} }}) size = 1; @Output() gone = 2; plain = input({nested('3')}); }}\n"
    )
    u = facts(spark, source, "a.ts")
    e = scripts.entities(u).collect()[0]
    assert (e["name"], e["kind"], e["selector"]) == ("Deep", "Component", "x-y")
    assert e["imports"] == ["A", "B", "C", "ns", "cond", "E"]
    assert "P" in e["providers"] and "T" in e["providers"] and e["style_paths"] == ["./a.css", "./b.css"]
    assert e["host_bindings"] == [f"go({nested('1')})", "on"] and e["inputs"] == ["size", "plain"] and e["outputs"] == ["gone"]
    assert [(r["name"], r["kind"]) for r in scripts.exports(u).collect()] == [("Deep", "Class")]
