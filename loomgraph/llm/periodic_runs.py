"""Runs of repeating words by a suffix automaton with link-cut access.

A run is a stretch of words with a period q, at least two periods long, that no neighbour extends. The
suffix automaton of a text has a node for each set of substrings that end at the same places; its suffix
links form a tree, and the path from a prefix to the root holds all its suffixes. Appending a word
recolours that path with the new end: what is read off each segment of one colour is the place where those
suffixes last ended and, from the segment's deepest node, how long a suffix ended there. If the distance
of the two ends is at most that length, a square ends here, and the length says how far its period reaches
to the left; the ends at which one period and start are met again extend it to the right. A link-cut
tree keeps the coloured paths as splay trees, so that a text of n words recolours O(n log n) segments.

A square of a period that isn't the smallest never shows: its suffix ended one smaller period ago.
Runs are looked for where they can be: every run of twelve words or more lies in a stretch of six-word
grams that are met again within half of that stretch, gaps of up to five grams aside, and so do its extensions.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import own_columns, row_of

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: A run has so many words at least, and two periods.
LEAST = 12
#: In a run of ``LEAST`` words grams of half its length are met again, but for fewer in a row than that.
_GRAM = LEAST // 2


def automaton(words: list) -> tuple[list[int], list[int], list[int]]:
    """The node of each prefix, and each node's suffix link and longest length; node 0 is the empty word."""
    link, length, steps, ends, last = [-1], [0], [{}], [], 0
    for word in words:
        new, at = len(link), last
        length.append(length[last] + 1)
        steps.append({})
        link.append(0)
        while at >= 0 and word not in steps[at]:
            steps[at][word] = new
            at = link[at]
        if at >= 0:
            to = steps[at][word]
            if length[to] > length[at] + 1:
                twin = len(link)
                length.append(length[at] + 1)
                steps.append(dict(steps[to]))
                link.append(link[to])
                link[to] = twin
                while at >= 0 and steps[at].get(word) == to:
                    steps[at][word] = twin
                    at = link[at]
                to = twin
            link[new] = to
        ends.append(new)
        last = new
    return ends, link, length


class Paths:
    """A link-cut tree over suffix links whose preferred paths are those of one last occurrence."""

    def __init__(self, link: list[int]):
        self.up, self.shallower, self.deeper = list(link), [-1] * len(link), [-1] * len(link)
        self.last = [-1] * len(link)  # of the top of a splay tree: where its path was last recoloured

    def _to_top(self, x: int) -> None:
        """Splay x to the top of its splay tree, which hands it its colour."""
        up, low, high = self.up, self.shallower, self.deeper
        while (p := up[x]) >= 0 and (low[p] == x or high[p] == x):
            g = up[p]
            inner = g >= 0 and (low[g] == p or high[g] == p)
            if inner:
                self._rotate(p if (low[g] == p) == (low[p] == x) else x)
            else:
                self.last[x] = self.last[p]
            if inner and not ((q := up[up[x]]) >= 0 and (low[q] == up[x] or high[q] == up[x])):
                self.last[x] = self.last[g]
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        up, low, high = self.up, self.shallower, self.deeper
        p = up[x]
        g = up[p]
        if low[p] == x:
            moved, high[x] = high[x], p
            low[p] = moved
        else:
            moved, low[x] = low[x], p
            high[p] = moved
        if moved >= 0:
            up[moved] = p
        up[p], up[x] = x, g
        if g >= 0:
            if low[g] == p:
                low[g] = x
            elif high[g] == p:
                high[g] = x

    def access(self, x: int, now: int) -> Iterator[tuple[int, int]]:
        """Recolour the path from x to the root; (last, deepest) of each segment that had a colour."""
        below, at = -1, x
        while at >= 0:
            self._to_top(at)
            last = self.last[at]
            if last >= 0:
                yield last, at
            if (cut := self.deeper[at]) >= 0:
                self.last[cut] = last
            self.deeper[at] = below
            below, at = at, self.up[at]
        self._to_top(x)
        self.last[x] = now


def squares(words: list) -> dict[tuple[int, int], int]:
    """The last word of each maximal repetition of at least two periods, by (start, period)."""
    ends, link, length = automaton(words)
    paths, found = Paths(link), {}
    for i, node in enumerate(ends):
        for last, deepest in paths.access(node, i):
            period, common = i - last, length[deepest]
            if common >= period:
                found[last - common + 1, period] = i
    return found


def stretches(words: list[str]) -> list[tuple[int, int]]:
    """Where (start, end) runs of ``LEAST`` words may be; each run is inside one of them, its extensions too.

    A gram of a run with period q is met again q words away, so the nearest equal gram is at most half the stretch
    away. Grams are compared by hashes, whose collisions only make stretches longer.
    """
    n = len(words) - _GRAM + 1
    if len(words) < LEAST:
        return []
    named, grams = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), np.zeros(n, np.uint64)
    for k in range(_GRAM):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + named[k : n + k]
    order = np.argsort(grams, kind="stable")
    same, gap = np.diff(grams[order]) == 0, np.diff(order)
    nearest = np.full(n, len(words))
    nearest[order[1:][same]] = gap[same]
    nearest[order[:-1][same]] = np.minimum(nearest[order[:-1][same]], gap[same])
    at = np.flatnonzero(nearest < len(words))
    while len(at):
        first = np.flatnonzero(np.diff(at, prepend=-LEAST) > _GRAM)
        bounds = np.append(first[1:], len(at))
        sizes = at[bounds - 1] + _GRAM - at[first]
        kept = (nearest[at] <= np.repeat(sizes // 2, bounds - first)) & np.repeat(sizes >= LEAST, bounds - first)
        if kept.all():
            return list(zip(at[first].tolist(), (at[bounds - 1] + _GRAM).tolist()))
        at = at[kept]
    return []


def runs_of(words: list[str]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    found = []
    for begin, end in stretches(words):
        for (start, period), last in squares(words[begin:end]).items():
            if (size := last - start + 1) >= max(LEAST, 2 * period):
                found.append((begin + start, size, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """What stays if each run keeps its first period only."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, size, period in runs:
        gone[start + period] += 1
        gone[start + size] -= 1
    return [w for w, dropped in zip(words, np.cumsum(gone).tolist()) if not dropped]


Edit = Callable[[str | None, list[str]], list[str]]
_RUNS = "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"


def with_runs(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """``docs`` with runs (array of start, length, period in words, by start and period) and collapsed (the
    words that stay where each run keeps its first period, joined by spaces); columns of these names are replaced.

    A null or empty text has no words, no runs and an empty ``collapsed``. Rows are read by themselves,
    each text whole: repeated rows have the same result, other columns are handed on, empty in is empty out. ``edit``
    may change the words of a row, (decimal doc_id or None, words), before they are read.
    """

    @F.pandas_udf(_RUNS)
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            found, left = [], []
            for doc_id, text in zip(ids, texts):
                words = WORDS.findall(text)
                if edit is not None:
                    words = edit(doc_id, words)
                runs = runs_of(words)
                found.append([{"start": start, "length": size, "period": period} for start, size, period in runs])
                left.append(" ".join(collapsed(words, runs) if runs else words))
            yield pd.DataFrame({"runs": pd.Series(found, dtype=object), "collapsed": pd.Series(left, dtype=object)})

    rows = docs.select(row_of(docs).alias("row"), read(F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))).alias("found"))
    return rows.select(*own_columns(docs, runs=F.col("found.runs"), collapsed=F.col("found.collapsed")))


def planted(doc_id: str | None, words: list[str]) -> list[str]:
    """The contract's edit: in about a tenth of documents all words from some place on repeat; a null id plants nothing."""
    h, n = 1 if doc_id is None else zlib.crc32(doc_id.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    once = words[start : start + period]
    return words[:start] + (once * ((n - start) // period + 1))[: n - start]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in every document, after the contract's edit.

    Null texts are empty, null ids are not edited, repeated rows repeat their result, empty in is empty out.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_runs(docs, planted).select("doc_id", "runs", "collapsed")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines: Column = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLES: dict[str, str] = {}
