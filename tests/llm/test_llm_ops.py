"""The corpus operators against brute force on small tables with nulls, ties, copies and odd texts."""

import hashlib
import html
import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from loomgraph.llm import common, families, fingerprints, html_text, license_scan, line_dedup, mixing, near_dups, neighbours, packing, quality, repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, clash=False):
    df = spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        for c in ("id", "key", "words", "hash", "score", "line", "copy", "gone", "rate", "shard", "bin", "near_key", "h", "at", "tid", "v"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def write(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def sentences(seed, n, words=40):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    return [" ".join(rng.choice(vocabulary) for _ in range(words)) for _ in range(n)]


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_license_scan(spark, tmp_path):
    texts = [
        None, "", "CC BY cc  by-nc cc", "All rights\nRESERVED. all rights reserved", "the GNU General Public License, version 3.", "İCC BY É all rights reservedx",
        "Permission is hereby granted, free of charge, to any kind person obtaining a copy of this software and associated documentation files", "cc by " * 3000, "Licensed under the Apache License, Version 2.1",
    ]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(2, texts[2], "s"), (None, texts[2], None)]
    write(documents(spark, rows, clash=True), tmp_path, "documents")
    out = [r.asDict() for r in license_scan.op1_license_scan(spark, str(tmp_path)).collect()]
    assert len(out) == len(rows)
    for i, t in enumerate(texts):
        words = re.findall(license_scan.WORD, (t or "").translate(LOW))
        places = [(k, label) for phrase, label in license_scan.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        for got in (r for r in out if r["doc_id"] == i):
            assert got["n_words"] == len(words) and got["n_base"] == len(places)
            assert got["first_word"] == min((k for k, _ in places), default=None) and got["last_word"] == max((k for k, _ in places), default=None)
            assert got["base_labels"] == ",".join(sorted({label for _, label in places}))
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[4]["labels"] == "gpl,gpl-3.0" and by_id[6]["labels"] == "mit" and by_id[8]["labels"] == ""
    assert sum(r["doc_id"] == 2 for r in out) == 2
    write(documents(spark, []), tmp_path, "documents")
    assert license_scan.op1_license_scan(spark, str(tmp_path)).count() == 0


def test_license_notices_with_an_edit_at_any_place(spark):
    """A long notice with one word inserted, changed or lost at any place, strays around it, keeps its label."""
    rows, want = [], {}
    for phrase, label in license_scan.NOTICES:
        words = phrase.split()
        if not license_scan.SHORT < len(words) < 60:
            continue
        for at in range(1, len(words)):
            for edited in (words[:at] + ["zzz"] + words[at:], words[:at] + ["zzz"] + words[at + 1 :], words[:at] + words[at + 1 :]):
                grams = set(zip(words, words[1:]))
                if len(grams & set(zip(edited, edited[1:]))) / len(words[1:]) >= 0.9:
                    want[len(rows)] = label
                    rows.append((len(rows), "you may the license " * 3 + "x " + " ".join(edited) + " the license you may of the", "s"))
    out = {r["id"]: {s["label"] for s in r["spans"]} for r in license_scan.spans(documents(spark, rows)).collect()}
    assert len(want) > 150 and [i for i in want if want[i] not in out[i]] == []


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("just a few words of text without any markup at all, but long enough to be a paragraph of content", None),
        ("<nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One\n  two<br>three<p>Four</article><footer>&copy; me</footer>", "A & B\n\nOne two three\n\nFour"),
        ("<body><header><h2>Site</h2></header><main><p>Short.</p><div class='sidebar'>side</div><section id=comments><p>Nice!</p></section></main><aside>x</aside>", "Short."),
        ("<article><p>a < b &lt; c &#233; &nosuch; </p><script>var t='</p>';</script><style>p{}</style><!-- no --><form>f</form><p hidden>h</p></article>", "a < b < c é &nosuch;"),
        ("<article><p>cut &am", "cut &am"), ("<article><p>kept</p><div class=ad>Buy</div><p class='lead'>too</p><p", "kept\n\ntoo"),
        ("<article><header><h1>Title</h1></header><p>Text.</p><article class=comment><p>no</p></article></article>", "Title\n\nText."),
        ("<div class='page has-sidebar'><article><p>In it.</p></article></div>", "In it."), ("<article class='post no-comments'><p>short one</p></article>", "short one"),
        ("<article><section id='search-algorithms'><p>On search.</p></section></article>", "On search."), ("<article><div class='post-header'><h1>Title</h1></div><p>Text.</p></article>", "Title\n\nText."),
        (f"<article><p>Text.</p><p class='notice'>{'word ' * 30}</p></article>", "Text.\n\n" + ("word " * 30).strip()), ("<article><p>one <svg class=x/> two</p><p>last</p></article>", "one two\n\nlast"),
        ("<noscript><article><p>Without scripts.</p></article>", "Without scripts."), ("<form><main><p>Text of it.</p><select><option>no</option></select></main></form>", "Text of it."),
        ("<article><p>x <math><mi>y</mi></math></p></article>", "x y"), ("<div class=sidebar><article><p>T</p><div id=comments><article class=reply>no</article></div></article></div>", "T"),
        ("<article><p>One.</p><div class='social-science'><p>Two of it.</p></div><section class='related-work'><h2>Related work</h2><p>Three.</p></section></article>", "One.\n\nTwo of it.\n\nRelated work\n\nThree."),
        ("<nav><a href=1>Home</a><article><p>After a menu without end.</p></article>", "After a menu without end."),
        ("<article><p>T</p><div class='td-social-share'>no</div><div class='comment-list'>no</div><div class='related-posts'>no</div><div class='ad-hoc-notes'>Kept notes of it.</div></article>", "T\n\nKept notes of it."),
        ("<div><p>" + "Long text of a page. " * 12 + "</p></div><div>Copyright 2020 Someone and Sons</div><div>© 2021 us</div>", ("Long text of a page. " * 12).strip()),
        ("<article><p>Copyright is a right.</p></article>", "Copyright is a right."),
        ("<div id='header'><p>Site name here</p></div><div class='cookie-notice'>We use cookies</div><main>Yes.</main>", "Yes."), ("<article>" + "<p>long</p>" * 20_000 + "</article>", "\n\n".join(["long"] * 20_000)),
    ],
)
def test_html_text(page, text):
    got = html_text.main_text(page)
    assert got == (page if text is None else text)


def test_html_tree_and_query(spark, tmp_path):
    x, y = html_text.labelled_blocks()
    tree = html_text.default_tree()
    assert np.mean([(html_text._share(tree, r) >= 0.5) == bool(v) for r, v in zip(x, y)]) > 0.97
    menu = "<div><a href=1>a</a> <a href=2>b</a></div>" * 5
    paragraph = "word " * 40
    assert html_text.main_text(menu + f"<div>{paragraph}</div>" + menu) == paragraph.strip()
    pages = spark.createDataFrame([(1, "u", f"<article><p>{paragraph}</article>", "t"), (1, None, None, "t"), (None, "v", "", "t")], "page_id long, url string, html string, text string")
    write(pages, tmp_path, "pages")
    out = html_text.op2_html_text(spark, str(tmp_path)).collect()
    assert sorted(r["n_chars"] for r in out) == [0, 0, len(paragraph.strip())]


def test_html_neighbours_decide_on_pages_without_article():
    """Blocks of the same words and links are content between paragraphs and boilerplate between links."""
    text, links, line = "<div>" + "word " * 50 + "</div>", "<div><a href=1>some</a> <a href=2>links</a></div>", "<div>just five words of it</div>"
    for around in (text, links):
        assert ("just five" in html_text.main_text(around * 2 + line + around * 2)) == (around == text)


def test_quality(spark, tmp_path):
    good, bad = sentences(1, 120), [" | ".join(t.upper().split()[:20]) + "!!" for t in sentences(2, 120)]
    rows = [(i, t, "s") for i, t in enumerate(good + bad)] + [(None, None, None), (900, "", "s"), (0, good[0], "s")]
    write(documents(spark, rows, clash=True), tmp_path, "documents")
    write(spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)] + [(None, 1, 0), (3, None, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    out = quality.op5_quality(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 240]
    assert held and all(r["predicted"] == int(r["doc_id"] < 120) for r in held)
    assert len({r["score"] for r in out if r["doc_id"] == 0}) == 1
    write(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert {round(r["score"], 3) for r in quality.op5_quality(spark, str(tmp_path)).collect()} == {0.5}


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.93


def brute_lines(rows):
    first, order = {}, []
    for i, t, _ in sorted((r for r in rows), key=lambda r: (r[0] is None, r[0])):
        for n, line in enumerate((t or "").split("\n")):
            if line.strip():
                order.append((i, n, line))
                first.setdefault(line, (i, n))
    sets = {x: frozenset(x[k : k + 8] for k in range(max(1, len(x) - 7))) for x in first}
    up = {x: x for x in first}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(first, 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 and top(a) != top(b):
            x, y = sorted((top(a), top(b)), key=first.get)
            up[y] = x
    kept = {}
    for i, n, line in order:
        if first[top(line)] != (i, n):
            kept.setdefault(i, set()).add(n)
    return kept


def test_line_dedup(spark):
    base = sentences(3, 12, 30)
    rng = random.Random(4)
    edited = []
    for b in base[:6]:
        w = b.split()
        w[rng.randrange(len(w))] = "zz"
        edited.append(" ".join(w))
    rows = [
        (1, "\n".join(base[:4]) + "\n\n", "s"), (2, base[0] + "\n" + edited[1] + "\nshort\n" + base[5], "s"), (3, "\n".join(edited), "s"),
        (4, "short\n \nshort", "s"), (5, None, "s"), (6, "", None), (7, base[7] + "\n" + base[7][:-3], "s"), (8, "é" * 50 + "\n" + "é" * 49, "s"),
    ]
    out = {r["doc_id"]: r for r in line_dedup.deduplicated(documents(spark, rows, clash=True)).collect()}
    gone = brute_lines(rows)
    for i, t, _ in rows:
        want = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ()))
        assert out[i]["text"] == want, i
    twice = line_dedup.deduplicated(documents(spark, [(1, base[0], "s"), (1, base[0], "s")])).collect()
    assert sorted(r["text"] for r in twice) == ["", base[0]]
    assert line_dedup.deduplicated(documents(spark, [])).count() == 0


def test_line_sketches_never_part_alike_lines(spark):
    """Lines with repeated shingles, below a shingle's length, with characters outside the basic plane and of 60,000 characters."""
    from pyspark.sql import functions as F

    base = sentences(9, 1, 40)[0]
    long = " ".join(sentences(11, 30, 300))
    lines = ["", "ab", "ab", "ababababababab" * 9, "ababababababab" * 8 + "c", base, base + " \U0001f600", base[6:], base * 3, base * 4, long, long[4000:], "x" + long]
    sets = [{x[k : k + 8] for k in range(len(x) - 7)} or {x} for x in lines]
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
    sketch = common.stored(line_dedup.sketches(texts), "line-sketches")
    assert {r["id"]: r["n"] for r in sketch.collect()} == {i: len(s) for i, s in enumerate(sets)}
    other = sketch.select(F.col("id").alias("b"), *line_dedup.prefixed(sketch, "b_"))
    kept = {(r["id"], r["b"]) for r in sketch.join(other, F.col("id") < F.col("b")).where(line_dedup.may_be_alike("b_")).collect()}
    for i, j in itertools.combinations(range(len(lines)), 2):
        assert (i, j) in kept or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.8
    assert (5, 10) not in kept and (1, 5) not in kept


def test_line_dedup_blocks_join_components(spark):
    """A chain of lines each near the next one only is one component, whatever the buckets' first lines are."""
    words = sentences(5, 1, 60)[0].split()
    chain = []
    for i in range(45):
        words[i] = f"edit{i}"
        chain.append(" ".join(words))
    rows = [(i, t, "s") for i, t in enumerate(chain)]
    out = line_dedup.deduplicated(documents(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in out if r["text"]) == [0]


@pytest.mark.parametrize("screened", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_settles_whole_groups(spark, seed, screened, monkeypatch):
    """One group of edited, cut and unrelated lines, a stranger first and nothing linked yet, against all pairs."""
    rng = random.Random(seed)
    lines = sentences(seed + 50, 4, 25)
    for base in sentences(seed + 60, 3, 30):
        for _ in range(45):
            w = base.split()
            for _ in range(rng.randrange(7)):
                w[rng.randrange(len(w))] = rng.choice(["same", f"w{rng.randrange(40)}", ""])
            lines.append(" ".join(w[rng.choice([0, 0, 0, 4]) : rng.choice([30, 30, 22])]))
    lines = list(dict.fromkeys(lines))
    sets = [{x[k : k + 8] for k in range(len(x) - 7)} for x in lines]
    up = list(range(len(lines)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(lines)), 2):
        if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
            a, b = sorted((top(i), top(j)))
            up[b] = a
    groups = spark.createDataFrame([(7, i) for i in range(len(lines))], "g long, id long")
    nothing = spark.createDataFrame([], "id long, root long")
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
    sketch = common.stored(line_dedup.sketches(texts), "line-sketches")
    monkeypatch.setattr(families, "SCREENED", 20)  # so that groups take several rounds
    found = families.settled(groups, nothing, texts, line_dedup.compared, line_dedup.verified, "line", line_dedup.SIMILARITY, screen=(sketch, line_dedup.may_be_alike) if screened else None)
    found = {r["id"]: r["root"] for r in found.collect()}
    assert {i: found.get(i, i) for i in range(len(lines))} == {i: top(i) for i in range(len(lines))}
    if screened:
        pairs, left = line_dedup.within(groups, sketch, nothing, 2**31 - 1)
        pairs = {(r["a"], r["b"]) for r in pairs.collect()}
        alike = {(j, i) for i, j in itertools.combinations(range(len(lines)), 2) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
        assert alike <= pairs and len(pairs) < 2 * len(alike) and left.isEmpty()
    assert 20 < len({top(i) for i in range(len(lines))}) < len(lines) - 20


def plain_best_fit(lengths, sources, clusters, capacity):
    """All bins tried for each piece, the tightest that may take it, then the oldest."""
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters):
        fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= n and s not in b[1] and c not in b[2]]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([capacity, set(), set(), 0])
        out.append((i, bins[i][3]))
        bins[i] = [bins[i][0] - n, bins[i][1] | {s}, bins[i][2] | {c}, bins[i][3] + 1]
    return out


@pytest.mark.parametrize(("kinds", "copies"), [(3, 1), (30, 4), (500, 60), (1, 1)])
def test_best_fit_is_the_tightest_compatible_bin(kinds, copies):
    rng = random.Random(kinds)
    lengths = sorted((rng.choice([0, 1, rng.randint(0, 100), rng.randint(0, 30)]) for _ in range(500)), reverse=True)
    sources, clusters = [rng.choice([None, *range(kinds)]) for _ in lengths], [rng.randrange(500 // copies) for _ in lengths]
    assert packing.best_fit(lengths, sources, clusters, 100) == plain_best_fit(lengths, sources, clusters, 100)


def test_packing_does_not_depend_on_partitions(spark):
    rows = [(i % 150, t, f"s{i % 7}") for i, t in enumerate(sentences(31, 200, 20))] + [(7, "same words", "s")] * 9
    found = [sorted(map(str, packing.pack(documents(spark, rows).repartition(n), capacity=64, shard_rows=40).collect())) for n in (1, 6)]
    assert found[0] == found[1]


@pytest.mark.parametrize("capacity", [7, 64])
def test_packing(spark, capacity):
    rng = random.Random(capacity)
    texts = sentences(6, 60, 20)
    rows = [(i, " ".join(texts[i % 40].split()[: rng.randint(0, 20)]), f"s{i % 3 if i % 2 else 0}") for i in range(80)] + [(200, texts[0] * 9, None), (201, None, None), (None, texts[1], "s1"), (5, texts[2], "s1"), (5, texts[2], "s1")]
    out = packing.pack(documents(spark, rows, clash=True), capacity=capacity, shard_rows=40).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, t, _ in rows for _ in range(max(1, -(-len((t or "").split()) // capacity))))
    assert sum(r["n_words"] for r in out) == sum(len((t or "").split()) for _, t, _ in rows)
    bins = {}
    for r in out:
        bins.setdefault((r["shard"], r["bin"]), []).append(r)
    for b in bins.values():
        assert sum(r["n_words"] for r in b) <= capacity and sorted(r["slot"] for r in b) == list(range(len(b)))
        assert len({r["source"] for r in b}) == len(b)
    assert packing.pack(documents(spark, [])).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(1)
    lengths = sorted((rng.randint(0, 60) for _ in range(150)), reverse=True)
    sources, clusters = [rng.randrange(9) for _ in lengths], [rng.randrange(60) for _ in lengths]
    places = packing.best_fit(lengths, sources, clusters, 60)
    bins = []
    for n, s, c, (b, slot) in zip(lengths, sources, clusters, places):
        fits = [(60 - sum(x[0] for x in v), k) for k, v in enumerate(bins) if sum(x[0] for x in v) + n <= 60 and all(x[1] != s and x[2] != c for x in v)]
        assert b == (min(fits)[1] if fits else len(bins))
        if b == len(bins):
            bins.append([])
        assert slot == len(bins[b])
        bins[b].append((n, s, c))


@pytest.mark.parametrize("window, gram", [(8, 3), (100, 32)])
def test_repeated_spans(spark, window, gram):
    rng = random.Random(window)
    alphabet = "ab" if window == 8 else "abcdefgé"
    piece = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [piece(window * 2), piece(window), piece(window + 7)]
    texts = [piece(rng.randint(0, 2 * window)) + rng.choice(shared) + piece(rng.randint(0, window)) + rng.choice(shared)[: rng.randint(0, 2 * window)] for _ in range(40)] + ["", "a" * (3 * window), "a" * (window + 1), shared[0]]
    table = spark.createDataFrame(list(enumerate(texts)), "tid long, text string")
    spans = {r["tid"]: [tuple(s) for s in r["spans"]] for r in repeats.repeated_spans(table, window, gram).collect()}
    seen = set()
    for i, t in enumerate(texts):
        raw, covered = t.encode(), set()
        for k in range(len(raw) - window + 1):
            if raw[k : k + window] in seen:
                covered |= set(range(k, k + window))
            seen.add(raw[k : k + window])
        assert {k for s, e in spans.get(i, []) for k in range(s, e)} == covered, i


def test_repeats_query(spark, tmp_path):
    shared = sentences(7, 1, 30)[0]
    rows = [(5, "x" + shared + "y", "s"), (1, shared, "s"), (2, shared, "s"), (3, "tiny", "s"), (4, "tiny", "s"), (6, None, "s"), (None, shared + "z" * 150, "s"), (3, "tiny", "s")]
    write(documents(spark, rows, clash=True), tmp_path, "documents")
    out = {}
    for r in repeats.op6_repeats(spark, str(tmp_path)).collect():
        out.setdefault(r["doc_id"], []).append(r)
    n = len(shared)
    assert (out[1][0]["n_removed"], out[2][0]["n_removed"], out[2][0]["n_spans"]) == (0, n, 1)
    assert out[5][0]["kept_sha256"] == hashlib.sha256(b"xy").hexdigest() and out[5][0]["n_removed"] == n
    assert [r["n_removed"] for r in out[3] + out[4] + out[6]] == [0] * 4
    assert out[None][0]["n_removed"] == n + 149 and out[None][0]["n_spans"] == 2
    write(documents(spark, []), tmp_path, "documents")
    assert repeats.op6_repeats(spark, str(tmp_path)).count() == 0


def near_pairs(texts):
    sets = [near_dups.shingles(t) for t in texts]
    return [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if near_dups.probability_jaccard(sets[i], sets[j]) >= 0.8]


def test_near_dups(spark, tmp_path):
    base = sentences(8, 6, 120)
    rng = random.Random(9)

    def edit(t, n):
        w = t.split()
        for _ in range(n):
            w[rng.randrange(len(w))] = f"new{rng.randrange(999)}"
        return " ".join(w)

    texts = base + [edit(base[0], k % 3) for k in range(30)] + [edit(base[1], 8) for _ in range(10)] + [base[2].upper(), "", None, "  ", "one", "One!"]
    chain = [base[3]]
    for _ in range(12):
        chain.append(edit(chain[-1], 1))
    texts += chain[1:]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, base[0], "s"), (None, base[4], "s")]
    write(documents(spark, rows, clash=True), tmp_path, "documents")
    out = near_dups.op7_near_dups(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in near_pairs(texts):
        a, b = sorted((top(i), top(j)))
        up[b] = a
    got = {r["doc_id"]: r["class_id"] for r in out}
    assert {i: top(i) for i in range(len(texts))} == {i: got[i] for i in range(len(texts))}
    kept = near_dups.deduplicated(documents(spark, rows, clash=True))
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids) == sorted({top(i) for i in range(len(texts))})
    assert near_dups.near_classes(documents(spark, [])).count() == 0


def test_near_dups_of_one_family_in_blocks(spark):
    """Members that the first of a bucket is not near to still meet each other."""
    base = sentences(10, 1, 150)[0].split()
    rng = random.Random(11)
    texts = []
    for _ in range(300):
        w = list(base)
        for k in rng.sample(range(len(w)), rng.randint(0, 7)):
            w[k] = f"v{rng.randrange(5)}"
        texts.append(" ".join(w))
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in near_pairs(texts):
        a, b = sorted((top(i), top(j)))
        up[b] = a
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    classes = {r["class_id"] for r in near_dups.near_classes(documents(spark, rows)).collect()}
    assert classes == {top(i) for i in range(len(texts))}


def test_near_dups_of_heavy_shingles_in_a_block():
    """Texts that a repeated passage makes alike are linked, however few of their distinct shingles they share."""
    rng = random.Random(14)
    texts = []
    for times in (1000, 1000, 300, 150, 100, 20, 1):
        for _ in range(2):
            texts.append(" ".join(["again"] * (times + 4) + [f"w{rng.randrange(10**9)}" for _ in range(100)]))
    texts += ["again " * 400, " ".join(sentences(15, 1, 30)[0].split() * 30), ""]
    near = near_pairs(texts)
    assert (0, 1) in near and len(near) > 1
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = pd.DataFrame({"id": [b"%03d" % i, b"%03d" % j], "root": [b"%03d" % i, b"%03d" % j], "text": [texts[i], texts[j]]})
        assert len(near_dups._block(both)) == ((i, j) in near), (i, j)


def test_near_dups_settle_heavy_and_plain_texts(spark):
    """One group of edited texts, some of which repeat a phrase often, too large to be linked at once, against all pairs."""
    rng = random.Random(16)
    texts = []
    for base in sentences(17, 3, 60):
        for _ in range(30):
            w = base.split()
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(6)}"
            w += w[5:15] * rng.choice([0, 0, 1, 2, 30])
            texts.append(" ".join(w))
    texts = list(dict.fromkeys(texts)) + ["", "  ", "one two"]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in near_pairs(texts):
        a, b = sorted((top(i), top(j)))
        up[b] = a
    key = lambda i: b"%04d" % i
    groups = spark.createDataFrame([(7, key(i)) for i in range(len(texts))], "g long, id binary")
    nothing = spark.createDataFrame([], "id binary, root binary")
    known = spark.createDataFrame([(key(i), t) for i, t in enumerate(texts)], "id binary, text string")
    found = families.settled(groups, nothing, known, lambda rows: rows.mapInPandas(near_dups._compared, near_dups.APART), near_dups._verified, "near", near_dups.SIMILARITY)
    found = {bytes(r["id"]): bytes(r["root"]) for r in found.collect()}
    assert {i: found.get(key(i), key(i)) for i in range(len(texts))} == {i: key(top(i)) for i in range(len(texts))}


def test_near_dups_settle_a_large_family_in_one_round(spark, monkeypatch):
    """Texts that share a passage which outweighs their own words, edited copies, long and odd texts: blocks that meet lose no link, and their tables don't grow with the family."""
    rng = random.Random(21)
    passage, own = sentences(22, 1, 8)[0], sentences(23, 260, 160)
    texts = [" ".join([passage] * 60 + own[k].split()[: rng.randrange(20, 160)]) for k in range(200)]
    for base in own[200:203]:
        for _ in range(40):
            w = base.split()
            for _ in range(rng.randrange(9)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(6)}"
            texts.append(" ".join([passage] * rng.choice([0, 0, 1, 60]) + w))
    texts += [" ".join(own[k % 40 : k % 40 + 20]) + f" end{k % 3}" * k for k in range(6)] + ["", "  ", "...", "one two", passage]
    texts = list(dict.fromkeys(texts))
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in near_pairs(texts):
        a, b = sorted((top(i), top(j)))
        up[b] = a
    key = lambda i: b"%04d" % i
    known = spark.createDataFrame([(key(i), t) for i, t in enumerate(texts)], "id binary, text string")
    groups = spark.createDataFrame([(7, key(i)) for i in range(len(texts))], "g long, id binary")
    made, real = [], families.stored
    monkeypatch.setattr(families, "stored", lambda df, label: made.append(label) or real(df, label))
    for linked in ([], [(key(i), key(top(i))) for i in range(0, len(texts), 3)]):
        found = spark.createDataFrame(linked, "id binary, root binary")
        found = families.in_blocks(groups, found, known, near_dups._linked, 20, near_dups._met, 60, 60_000, "near")
        found = {bytes(r["id"]): bytes(r["root"]) for r in found.collect()}
        assert {i: found.get(key(i), key(i)) for i in range(len(texts))} == {i: key(top(i)) for i in range(len(texts))}
    made.clear()
    monkeypatch.setattr(near_dups, "CELL", 60)
    classes = near_dups.near_classes(documents(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    assert {r["class_id"] for r in classes.collect()} == {top(i) for i in range(len(texts))}
    assert len(made) <= 3


def test_near_dups_shuffle_only_likely_texts(spark):
    """Texts of unwanted keys are dropped before texts are joined with the wanted keys, all but a few."""
    rows = spark.range(5000).selectExpr("unhex(lpad(hex(id), 32, '0')) as key", "cast(id as string) as text")
    wanted = rows.where("cast(text as long) % 50 = 0").select("key")
    got = near_dups.likely(rows, wanted)
    assert got.columns == ["key", "text"] and got.join(wanted, "key").count() == 100 and got.count() < 110
    assert near_dups.likely(rows, wanted.limit(0)).count() == 0
    joined = got.hint("merge").join(wanted, "key")._jdf.queryExecution().optimizedPlan().toString()
    assert joined.index("bits") > joined.index("Join") and "LeftSemi" not in joined


def test_probability_jaccard_and_its_estimate():
    rng = np.random.default_rng(2)
    for _ in range(5):
        keys = np.sort(rng.choice(10_000, 60, replace=False)).astype(np.uint64)
        a, b = (keys[:45], rng.integers(1, 5, 45)), (keys[10:], rng.integers(1, 5, 50))
        wa, wb = dict(zip(a[0].tolist(), a[1].tolist())), dict(zip(b[0].tolist(), b[1].tolist()))
        want = sum(1 / sum(max(wa.get(y, 0) / wa[x], wb.get(y, 0) / wb[x]) for y in wa.keys() | wb.keys()) for x in wa.keys() & wb.keys())
        assert near_dups.probability_jaccard(a, b) == pytest.approx(want)
        s = near_dups.signatures([(near_dups._mix(a[0]), a[1]), (near_dups._mix(b[0]), b[1])], 4096)
        assert (s[0] == s[1]).mean() == pytest.approx(want, abs=0.04)


def test_neighbours(spark, tmp_path):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 16))
    x = (centers[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(5000, None, 0), (5050, [0.0] * 16, 0), (5100, [float("nan")] + [1.0] * 15, 0), (5150, [None] + [1.0] * 15, 0), (None, x[0].tolist(), 0), (5200, [1.0, 2.0], 0)]
    write(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), tmp_path, "embeddings")
    out = neighbours.op8_neighbours(spark, str(tmp_path)).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 3000, 50):
        got = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == [1, 2, 3, 4, 5]
        s = unit @ unit[q]
        s[q] = -2
        best = sorted(range(3000), key=lambda i: (-round(s[i], 12), i))[:5]
        hits += len({r["vec_id"] for r in got} & set(best))
        total += 5
        assert all(r["score"] == pytest.approx(s[r["vec_id"]], abs=1e-12) for r in got)
    assert hits / total >= 0.95 and {r["query_id"] for r in out} == set(range(0, 3000, 50))
    assert [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == 200), key=lambda r: r["rank"])] == [100, 101, 102, 103, 104]
    mixed = [(i, v.tolist(), 0) for i, v in enumerate(x[:200])] + [(1000 + i, v[:2].tolist(), 0) for i, v in enumerate(x[:40])] + [(2000, [3.0], 0)]
    write(spark.createDataFrame(mixed, "vec_id long, embedding array<float>, label int"), tmp_path, "embeddings")
    out = neighbours.op8_neighbours(spark, str(tmp_path)).collect()
    assert {r["query_id"]: sum(o["query_id"] == r["query_id"] for o in out) for r in out} == {q: 5 for q in (0, 50, 100, 150, 1000)}
    assert all((r["query_id"] < 1000) == (r["vec_id"] < 1000) for r in out)
    write(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), tmp_path, "embeddings")
    assert neighbours.op8_neighbours(spark, str(tmp_path)).count() == 0


def test_neighbours_keep_the_sample_off_the_driver(spark, monkeypatch):
    """Centroids come from the vectors of the smallest hashes, and no vector is collected."""
    from pyspark.sql import functions as F

    x = np.random.default_rng(4).normal(size=(3000, 8))
    groups = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(7)
    want = [r["v"] for r in groups.orderBy(F.xxhash64("v"), "v").limit(300).collect()]
    assert [r["v"] for r in neighbours.picked(groups, 3000, 300).collect()] == want
    assert neighbours.picked(groups, 3000, 5000).count() == 3000 and neighbours.picked(groups.limit(0), 0, 300).count() == 0
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    frame, got = type(vectors), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: got.append((self.columns, rows := collect(self))) or rows)
    out = neighbours.search(vectors, vectors.where("vec_id % 50 = 0"), sample_rows=300)
    assert [(columns, len(rows)) for columns, rows in got] == [(["dims", "centroids"], 1)]
    assert out.count() == 300
    lists = np.frombuffer(got[0][1][0]["centroids"], np.float32).reshape(-1, 8)
    kept = np.array([r["v"] for r in collect(vectors.select(F.col("embedding").cast("array<double>").alias("v")).orderBy(F.xxhash64("v"), "v").limit(300))])
    assert (lists == neighbours.even_centroids(neighbours.unit(kept), -(-300 // min(neighbours.CENTROIDS, 3000 // neighbours.LIST_ROWS))).astype(np.float32)).all()


def test_fingerprints(spark, tmp_path):
    texts = sentences(12, 20, 60) + ["", None, "é", "long " * 3000]
    rows = [(3 * i, t, "s") for i, t in enumerate(texts)] + [(None, "no id", "s"), (0, texts[0], "s")]
    write(documents(spark, rows, clash=True), tmp_path, "documents")
    out = fingerprints.op9_fingerprints(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    for r, n in zip(order, order[1:] + order[:1]):
        t, half = r[1] or "", len(r[1] or "") // 2
        want[(r[0], len(t), hashlib.sha256((t[: len(t) - half] + (n[1] or "")[:half]).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out) == want
    assert len({r["fingerprint"] for r in out if r["doc_id"] == 0}) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    write(documents(spark, [(1, "alone", "s")]), tmp_path, "documents")
    assert fingerprints.op9_fingerprints(spark, str(tmp_path)).first()["near_next"] == 1.0
    write(documents(spark, []), tmp_path, "documents")
    assert fingerprints.op9_fingerprints(spark, str(tmp_path)).count() == 0


def test_likeness_follows_edits():
    texts = sentences(13, 12, 400)
    rng = random.Random(1)
    for t in texts:
        chars = list(t)
        for _ in range(12):
            k = rng.randrange(len(chars))
            chars[k : k + 1] = rng.choice([[], ["q"], [chars[k], "q"]])
        other = sentences(99, 1, 400)[0]
        a, b, c = fingerprints.fingerprints([t, "".join(chars), other])
        assert fingerprints.alike(a[None], b[None])[0] > 0.35 > 0.15 > fingerprints.alike(a[None], c[None])[0]
        assert (fingerprints.fingerprints([t])[0] == a).all()


def test_fingerprint_classes(spark):
    texts = sentences(14, 6, 300)
    near = [t.replace(" ", "  ", 2) for t in texts[:3]]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in texts + near + texts], "text string").withColumn("fingerprint", fingerprints.fingerprint(F.col("text")))
    classes = {r["fingerprint"]: r["class"] for r in fingerprints.near_classes(df).collect()}
    prints = fingerprints.as_hex(fingerprints.fingerprints(texts + near))
    for i in range(3):
        assert classes[prints[i]] == classes[prints[6 + i]]
    assert len(set(classes.values())) == 6


def test_mixing(spark, tmp_path):
    rng = random.Random(15)
    rows = [(i, "x" * rng.randint(0, 50), "hot" if i % 3 else f"s{i % 7}") for i in range(600)] + [(None, None, None), (1000, "rare " * 3, "rare"), (5, "again", "hot")]
    write(documents(spark, rows), tmp_path, "documents")
    got = mixing.op10_mixing(spark, str(tmp_path)).toPandas()
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = connection.execute(mixing.ORACLES["op10_mixing"]).df()
    key = list(want.columns)
    as_rows = lambda df: sorted(tuple("" if pd.isna(x) else str(int(x) if isinstance(x, float) and x == int(x) else x) for x in r) for r in df[key].itertuples(index=False))
    assert as_rows(got) == as_rows(want) and got["mix_order"].is_monotonic_increasing
    weighted = mixing.mix(documents(spark, rows, clash=True), weights={"hot": 1, "rare": 1}).groupBy("source").count().collect()
    assert {r["source"] for r in weighted} <= {"hot", "rare"}
    big = mixing.mix(documents(spark, [(i, "word", "a" if i < 50 else "b") for i in range(4000)]), weights={"a": 1, "b": 1}).groupBy("source").count().collect()
    counts = {r["source"]: r["count"] for r in big}
    assert abs(counts["a"] / 2000 - 1) < 0.15 and abs(counts["b"] / 2000 - 1) < 0.1
    assert mixing.mix(documents(spark, [])).count() == 0


def test_columns_of_clashing_names_keep_their_values(spark):
    """Operators that hand on columns give back whatever the user called them."""
    from pyspark.sql import functions as F

    clashes = ("near_id", "near_class", "near_key", "key", "class_id", "_key", "_gone", "gone", "_copy", "copy", "row", "lines", "kept", "_source", "_rate", "rate", "n", "doc", "source_key", "doc_key", "id", "g", "root", "a.b")
    df = documents(spark, [(1, "one line\nand more of it", "s"), (2, "one line\nand more of it", "t"), (None, None, None)])
    for c in clashes:
        df = df.withColumn(c, F.concat_ws(":", F.lit(c), F.col("doc_id").cast("string")))
    df = df.withColumn("n_kept", F.lit("mine"))
    for out in (line_dedup.deduplicated(df), near_dups.deduplicated(df), mixing.mix(df, temperature=1.0)):
        assert out.columns[: len(df.columns)] == df.columns
        for r in out.collect():
            assert all(r[c] == (f"{c}:{r['doc_id']}" if r["doc_id"] is not None else c) for c in clashes)


def test_components(spark):
    rng = random.Random(16)
    links = [(a, a + 1) for a in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, k) for k in range(301, 340)] + [(None, 1), (7, 7)]
    found = {r["id"]: r["root"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    assert found == {x: top(x) for x in up}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
