"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Spark computes the statistics of every whole text and scores them in Arrow batches. Only the
fitting, over a bounded sample of labelled rows, runs on the driver. A fitted model is a few flat
arrays, which numpy walks for all rows of a batch at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "space", "comma", "stop", "sentence_mark",
    "dollar_percent", "pipe", "bracket", "other_mark", "non_ascii", "newline", "distinct_words", "top_word", "twice_pair",
    "repeated_lines", "line_words", "upper_words", "short_words", "long_words", "marked_words",
)
_CLASS_OF = np.full(256, 13, np.int64)
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", ",", ".", "!?", "$%&#*@^~", "|", "()[]{}<>", "\"'-:;/\\_=+`", "", "\n")):
    _CLASS_OF[list(_chars.encode())] = _i
_CLASS_OF[128:] = 10
_WORD = re.compile(r"\S+")


def features(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of ``FEATURES``; a null counts as an empty text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, raw.size)
    counts = np.bincount(_CLASS_OF[raw], minlength=14) / n if raw.size else np.zeros(14)
    words = _WORD.findall(text)
    k = max(1, len(words))
    by_word = Counter(words)
    lines = [x for x in text.split("\n") if x]
    joined = len("".join(words))
    return [
        np.log1p(raw.size), np.log1p(len(words)), joined / k,
        counts[0], counts[1], counts[2], counts[3], counts[4], counts[5], counts[6], counts[7], counts[8], counts[9], counts[10], counts[11],
        len(by_word) / k, max(by_word.values(), default=0) / k,
        1 - len(set(zip(words, words[1:]))) / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        1 - len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)),
        sum(map(str.isupper, words)) / k, sum(len(w) < 3 for w in words) / k, sum(len(w) > 14 for w in words) / k,
        sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words) / k,
    ]


@dataclass(frozen=True)
class Trees:
    """A forest as flat arrays of (tree, node): a node's children are 2i+1 and 2i+2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 32, rate: float = 0.15, least: float = 4.0) -> Trees:
    """Boost ``trees`` regression trees of the logistic loss on binned features, level by level."""
    n, f = x.shape
    nodes = 2 ** (depth + 1) - 1
    feature, cut, value = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if n else 0.5
    base = float(np.log(mean / (1 - mean)))
    if n < 10 or y.min() == y.max():
        return Trees(feature, cut, value, depth, base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(f)], 1)
    flat = binned + np.arange(f) * bins
    raw = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (f * bins) + flat).ravel()
            g = np.bincount(at, np.repeat(grad, f), width * f * bins).reshape(width, f, bins).cumsum(2)
            h = np.bincount(at, np.repeat(hess, f), width * f * bins).reshape(width, f, bins).cumsum(2)
            g_all, h_all = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
            gain[(h < least / 4) | (h_all - h < least / 4)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for i, b in enumerate(best):
                j, k = divmod(int(b), bins)
                if gain[i, j, k] > 1e-6 and k < len(edges[j]):
                    feature[t, first + i], cut[t, first + i] = j, edges[j][k]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        g, h = np.bincount(node, grad, nodes), np.bincount(node, hess, nodes)
        value[t] = rate * g / (h + 1)
        raw += value[t, node]
    return Trees(feature, cut, value, depth, base)


def _features_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"x": [features(t) for t in b["text"]], "y": b["y"]})


def train(docs: DataFrame, labels: DataFrame, held_out: int | None = 0, sample_rows: int = 20_000) -> Trees:
    """Fit on at most ``sample_rows`` labelled documents, those whose hashed ids are smallest.

    With ``held_out`` set, rows whose crc32(doc_id) mod 5 equals it are never learnt from. Labels
    without a document, or with null fields, don't count; without labels the model scores 0.5. However often
    rows of an id repeat, at most ``sample_rows`` of all, those of the smallest hashes, reach the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if held_out is not None:
        known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != held_out)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
        .select("text", "y").mapInPandas(_features_of, "x array<double>, y int").orderBy(F.xxhash64("x", "y")).limit(sample_rows).toPandas()
    )
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T)  # the fit does not depend on the order in which Spark returns the rows
    return fit(x[order], rows["y"].to_numpy(float)[order])


def score(docs: DataFrame, model: Trees, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with each whole text's score added as column ``name``, which replaces one of that name; every row stays, in place; null texts are empty."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(model.score(np.array([features(t) for t in s], float).reshape(-1, len(FEATURES))))

    return docs.withColumn(name, scored(F.col(text)))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality score; repeated rows give repeated results, null ids are scored too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"),
    )


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
