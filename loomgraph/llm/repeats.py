"""Exact removal of repeated passages: every byte of a 100-byte string that also starts earlier.

No suffixes are sorted here. In place of the digits of a radix sort, passes group by hashes of longer strings, from one
shorter than the threshold to whole windows, so that equal groups of the last pass are the repeated windows, and all but the first
of them are removed. No bytes are compared, so results are right but for collisions of 64-bit hashes. Three things keep that small:

* Passes deal out representatives. Each window is represented by the position of the smallest
  hash among its ``GRAM``-byte strings. Equal windows choose alike, so a run of some dozens of
  windows shares one representative, and only that is dealt out.
* A string whose group has one member has no repeated window; it drops out before the next pass.
  The strings are the representative's gram; then, where a gram's runs of windows don't span equal bytes
  throughout, the bytes that ``BLOCK`` neighbouring windows have in common; then single windows.
* Equal texts are one text from the start.

Counts and firsts are aggregated before they are shuffled, so a passage in a third of all documents
is a few rows from each task. Texts are stored once, bucketed, and joined without another shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import stored, text_key
from loomgraph.scratch import bucketed, discard

WINDOW = 100
GRAM = 32
BLOCK = 8
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


@cache
def _byte_codes(base: int) -> np.ndarray:
    return np.random.default_rng(base % 2**32).integers(0, 2**64, 256, np.uint64)


_power_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below n."""
    if base not in _power_cache or len(_power_cache[base][0]) < n:
        size = 1 << (n - 1).bit_length()
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        _power_cache[base] = up, down
    up, down = _power_cache[base]
    return up[:n], down[:n]


class Ranges:
    """Hashes of any byte ranges of one text."""

    def __init__(self, data: np.ndarray, base: int):
        up, self.down = _powers(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_codes(base)[data] * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def runs(data: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram hash, position, first window, last window) of each run of windows with one representative."""
    n = len(data) - window + 1
    if n <= 0:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    h = Ranges(data, _BASES[0])(slice(0, len(data) - gram + 1), slice(gram, None))
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # ties: the leftmost
    width, span = 1, window - gram + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: width - span], least[span - width :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)[:n]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    return h[at[first]], at[first], first, last


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def removed(spans: np.ndarray) -> np.ndarray:
    """Maximal runs (start, end) covered by ``spans``; touching ones are one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[fresh, 0], reach[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(spans) - 1]])]], 1)


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: (key, first_id, tid) of distinct texts, tid counting them in order, and (tid, text), bucketed by tid.

    The order is that of the smallest doc_id with the text, nulls last, then of the key.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(text_key(F.col("text"))))
    firsts = keyed.select("key", "doc_id").groupBy("key").agg(F.min("doc_id").alias("first_id"))
    placed = stored(firsts.orderBy(F.col("first_id").asc_nulls_last(), "key").withColumn("place", F.monotonically_increasing_id()), "order")
    part = F.shiftright("place", 33)
    sizes = [(r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()]  # one row for each task
    starts = [(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)]
    base = F.broadcast(spark.createDataFrame(starts, "part long, start long").repartition(1))
    order = placed.join(base, part == F.col("part")).select("key", "first_id", (F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("tid"))
    texts = keyed.groupBy("key").agg(F.first("text").alias("text")).join(order.select("key", "tid"), "key").select("tid", "text")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return order, bucketed(texts.repartition(buckets, "tid"), "texts", "tid")


def repeated_spans(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(tid, spans) of ``texts`` (tid, text): an array of (start, end) byte ranges that cover what repeats.

    Order is that of tid and position. Texts shorter than ``window`` bytes have no window.
    """
    longest = texts.agg(F.max(F.octet_length("text")), F.max("tid")).first()
    bits = int(longest[0] or 1).bit_length()
    if bits + int(longest[1] or 1).bit_length() > 62:
        raise ValueError("too many texts of this length to number all bytes in 62 bits")
    tid = lambda at: F.shiftright(at, bits)

    def representatives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(t, runs(_bytes(text), window, gram)) for t, text in zip(b["tid"], b["text"])]
            yield pd.DataFrame({
                "h": np.concatenate([r[0] for _, r in found]).view(np.int64),
                "at": np.concatenate([(t << bits) | r[1] for t, r in found]),
            })

    names = ("h", "core", "whole", "at", "off", "n")

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, text, places in zip(b["tid"], b["text"], b["places"]):
                data = _bytes(text)
                h, at, first, last = runs(data, window, gram)
                mine = np.isin(at, places)
                h, at, first, last = h[mine], at[mine], first[mine], last[mine]
                whole = Ranges(data, _BASES[1])(first, last + window) ^ (((at - first) << 8) | (last - first)).astype(np.uint64)
                out.append((h.view(np.int64), np.zeros(len(h), np.int64), whole.view(np.int64), (t << bits) | first, at - first, last - first + 1))
            if out:
                yield pd.DataFrame({k: np.concatenate([x[i] for x in out]) for i, k in enumerate(names)})

    def pieces(size: int):
        """Runs cut into pieces of at most ``size`` windows, at the same places by their representatives."""

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for t, text, h, start, off, n in zip(b["tid"], b["text"], b["hs"], b["starts"], b["offs"], b["ns"]):
                    hashed = Ranges(_bytes(text), _BASES[1])
                    lowest, highest = -off // size, (n - 1 - off) // size
                    many = highest - lowest + 1
                    run = np.repeat(np.arange(len(many)), many)
                    rep = (start + off)[run]
                    low = rep + size * (lowest[run] + np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many))
                    first, last = np.maximum(low, start[run]), np.minimum(low + size, (start + n)[run]) - 1
                    core = hashed(low + size - 1, low + window) ^ (low - rep).astype(np.uint64)  # in every window of the piece
                    whole = hashed(first, last + window) ^ (first - rep).astype(np.uint64)
                    out.append((h[run], core.view(np.int64), whole.view(np.int64), (t << bits) | first, rep - first, last - first + 1))
                if out:
                    yield pd.DataFrame({k: np.concatenate([x[i] for x in out]) for i, k in enumerate(names)})

        return cut

    def later(rows: DataFrame) -> DataFrame:
        """Rows that are not the first of their (h, whole)."""
        firsts = rows.groupBy("h", "whole").agg(F.min("at").alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
        return rows.join(firsts, ["h", "whole"]).where("at > first").select("at", "n")

    inside = F.col("at").bitwiseAND((1 << bits) - 1)
    reps = stored(texts.select("tid", "text").mapInPandas(representatives, "h long, at long"), "representatives")
    digits = reps.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
    places = reps.join(digits, "h").groupBy(tid("at").alias("tid")).agg(F.collect_list(inside).alias("places"))
    kind = "h long, core long, whole long, at long, off long, n long"
    rows = stored(texts.join(places, "tid").select("tid", "text", "places").mapInPandas(contexts, kind), "contexts")
    discard(reps)
    spans = stored(later(rows), "spans")
    for size in (BLOCK, 1):
        kinds = rows.groupBy("h", "core", "whole").agg(F.min("at").alias("at"), F.min("off").alias("off"), F.min("n").alias("n"))
        several = kinds.groupBy("h", "core").agg(F.count("*").alias("m")).where("m > 1").select("h", "core")
        runs_of = F.collect_list(F.struct("h", inside.alias("start"), "off", "n"))
        opened = kinds.join(several, ["h", "core"]).groupBy(tid("at").alias("tid")).agg(runs_of.alias("r")).select("tid", F.col("r.h").alias("hs"), F.col("r.start").alias("starts"), F.col("r.off").alias("offs"), F.col("r.n").alias("ns"))
        cut = stored(texts.join(opened, "tid").select("tid", "text", "hs", "starts", "offs", "ns").mapInPandas(pieces(size), kind), "pieces")
        discard(rows)
        rows = cut
        spans = spans.unionByName(stored(later(rows), "spans"))
    discard(rows)
    return spans.groupBy(tid("at").alias("tid")).agg(F.collect_list(F.struct(inside.alias("start"), (inside + F.col("n") - 1 + window).alias("end"))).alias("spans"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, first_id, n_bytes, n_removed, n_spans, kept) of each distinct text, ``kept`` its remaining bytes.

    This is what the first document with the text keeps; in later ones all repeats if it has
    ``window`` bytes.
    """
    order, texts = distinct_texts(docs)
    spans = repeated_spans(texts, window)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, text, found in zip(b["tid"], b["text"], b["spans"]):
                data = _bytes(text)
                gone = removed(np.array([(s["start"], s["end"]) for s in found] if found is not None else [], np.int64).reshape(-1, 2))
                left = np.ones(len(data), bool)
                for start, end in gone:
                    left[start:end] = False
                rows.append((t, len(data), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), data[left].tobytes()))
            yield pd.DataFrame(rows, columns=["tid", "n_bytes", "n_removed", "n_spans", "kept"])

    cuts = texts.join(spans, "tid", "left").select("tid", "text", "spans").mapInPandas(cut, "tid long, n_bytes long, n_removed long, n_spans long, kept binary")
    out = cuts.join(order, "tid").drop("tid")
    out.made_of = texts  # the bucketed texts, to be discarded once this is stored
    return out


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps once passages of 100 bytes that start earlier are removed.

    Null texts are empty. Rows with the same id and text are one document and have its result;
    those with the same id and other texts follow each other in the order of their text keys; null
    ids come last.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cuts = without_repeats(docs)
    by_text = stored(cuts.select("key", "first_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")), "cuts")
    discard(cuts.made_of)
    rows = docs.select("doc_id", F.unhex(text_key(F.col("text"))).alias("key")).join(by_text, "key")
    again = ~F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("n_bytes") >= WINDOW)
    return rows.select(
        "doc_id", "n_bytes", F.when(again, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(again, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(again, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("sha")).alias("kept_sha256"),
    )


#: Brute force: all windows, by their bytes in hex.
SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, row_number() OVER (ORDER BY doc_id) AS o FROM documents),
w AS (SELECT o, i, substr(h, 2 * i + 1, {2 * WINDOW}) AS g FROM (SELECT o, h, unnest(range(0, greatest(0, length(h) // 2 - {WINDOW - 1}))) AS i FROM d)),
later AS (SELECT o, i FROM (SELECT o, i, row_number() OVER (PARTITION BY g ORDER BY o, i) AS k FROM w) WHERE k > 1),
runs AS (SELECT o, i, sum(fresh) OVER (PARTITION BY o ORDER BY i) AS run
  FROM (SELECT o, i, CASE WHEN i <= lag(i) OVER (PARTITION BY o ORDER BY i) + {WINDOW} THEN 0 ELSE 1 END AS fresh FROM later)),
spans AS (SELECT o, min(i) AS s, max(i) + {WINDOW} AS e FROM runs GROUP BY o, run),
gaps AS (SELECT o, s, e, coalesce(lag(e) OVER (PARTITION BY o ORDER BY s), 0) AS p FROM spans),
cut AS (SELECT o, sum(e - s) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * p + 1, 2 * (s - p)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS kept
  FROM gaps JOIN d USING (o) GROUP BY o)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (o)
"""

QUERIES = {"op6_repeats": op6_repeats}
ORACLES = {"op6_repeats": SQL}
