"""Document fingerprints by a randomised edit embedding.

A text is read by a pointer that, at each step, stays or advances by one character: which, a random
table shared by all texts decides from the step and the character. Two texts that differ by few edits
are read in step nearly everywhere, whatever was inserted or deleted, so edit distance turns into
Hamming distance between the two readings. A text of n characters is read in 2n steps on average;
a reading has a few standard deviations more, so that it gets to the text's end.

A fingerprint samples that reading at ``SLOTS`` steps. Each slot has a fixed random sequence of steps,
the records of a random order of all steps, and takes the last one that the reading has: texts of
different lengths then mostly sample the same steps, over their whole lengths. A slot keeps four bits
of the few characters at the pointer; bands of some slots find candidates, all slots verify them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from loomgraph.llm.common import components, stored
from loomgraph.llm.families import linked
from loomgraph.scratch import discard

SLOTS = 128
BANDS, BAND, STEP = 24, 8, 5
_WALKS = 4096  # the table of walks repeats after so many steps
_GRAM = 6
_SEED = 20_240_501
_FEW = 24  # so few texts are walked one by one


@cache
def _walks() -> np.ndarray:
    """Stay (0) or advance (1) by step and character class; class 0 is the end, where the pointer stays."""
    table = np.random.default_rng(_SEED).integers(0, 2, (_WALKS, 256))
    table[:, 0] = 0
    return table


@cache
def _walks_of_bytes() -> list[bytes]:
    return [row.astype(np.uint8).tobytes() for row in _walks()]


@cache
def _records(most: int) -> tuple[list[int], list[list[int]]]:
    """Steps below ``most`` at which slots sample, ascending, and the slots of each.

    A record after step j falls on j' with P(j' > n) = j / n, so the sequence of a slot never depends
    on ``most``: a larger one only continues it.
    """
    slots: dict[int, list[int]] = {}
    for slot in range(SLOTS):
        rng, step = np.random.default_rng([_SEED, slot]), 1
        while step <= most:
            slots.setdefault(step - 1, []).append(slot)
            step = int(step / (1.0 - rng.random())) + 1
    steps = sorted(slots)
    return steps, [slots[s] for s in steps]


def _reach(lengths: np.ndarray) -> np.ndarray:
    """Steps of a reading."""
    return 2 * lengths + 4 * np.sqrt(lengths).astype(np.int64) + 8


def fingerprints(texts: list[str]) -> np.ndarray:
    """Fingerprints of whole texts as rows of ``SLOTS`` digits from 0 to 15; all texts are walked side by side."""
    digits = np.zeros((len(texts), SLOTS), np.uint8)
    if not texts:
        return digits
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    points = np.frombuffer("\0".join([*(texts[i] for i in order), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = starts[1:] - 1
    classes = (((points * np.uint32(2654435761)) >> np.uint32(11)) % np.uint32(255)).astype(np.uint8)
    classes += np.uint8(1)
    classes[ends] = 0
    walks = _walks()
    reach = _reach(lengths)
    steps, slots = _records(1 << int(reach[0]).bit_length())
    pointer = starts[:-1].copy()
    seen, move = np.empty(len(texts), np.uint8), np.empty(len(texts), np.int64)
    raw = rows = None
    at, living = 0, len(texts)
    for step, sampled in zip(steps, slots):
        while living and reach[living - 1] <= step:
            living -= 1
        if not living:
            break
        if living > _FEW:
            here, c, d = pointer[:living], seen[:living], move[:living]
            for s in range(at, step):
                np.take(classes, here, out=c, mode="clip")
                np.take(walks[s % _WALKS], c, out=d, mode="clip")
                np.add(here, d, out=here)
        else:
            raw, rows = raw or classes.tobytes(), rows or _walks_of_bytes()
            for i in range(living):
                p = int(pointer[i])
                for s in range(at, step):
                    p += rows[s % _WALKS][raw[p]]
                pointer[i] = p
        at = step
        gram = np.zeros(living, np.uint64)
        for i in range(_GRAM):
            place = pointer[:living] + i
            inside = place < ends[:living]
            gram = (gram ^ np.where(inside, points[np.minimum(place, ends[:living])].astype(np.uint64) + np.uint64(1), np.uint64(0))) * np.uint64(0x9E3779B97F4A7C15)
            gram ^= gram >> np.uint64(29)
        for slot in sampled:
            digits[order[:living], slot] = (gram >> np.uint64(4 * (slot % 15))) & np.uint64(15)
    return digits


def as_hex(digits: np.ndarray) -> list[str]:
    """Rows of digits as strings, one hex digit for a slot."""
    packed = (digits[:, ::2] << 4) | digits[:, 1::2]
    return [row.tobytes().hex() for row in packed.astype(np.uint8)]


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots of two fingerprints, less what chance alone gives: 0 to 1."""
    return np.maximum(0.0, ((a == b).mean(1) - 1 / 16) / (15 / 16))


def in_runs(texts: list[str], most: int = 16_000_000) -> np.ndarray:
    """Fingerprints of any number of texts, with about ``most`` characters, or one text, at a time."""
    out, start, total = [], 0, 0
    for i, t in enumerate([*texts, None]):
        if t is None or (i > start and total + len(t) > most):
            out.append(fingerprints(texts[start:i]))
            start, total = i, 0
        total += len(t or "")
    return np.concatenate(out)


@F.pandas_udf(StringType())
def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The fingerprint of a column of whole texts; a null counts as an empty text."""
    for s in texts:
        yield pd.Series(as_hex(in_runs([t if isinstance(t, str) else "" for t in s])), dtype=object)


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """``alike`` of two columns of fingerprints without nulls."""
    rows = lambda s: np.frombuffer("".join(s).encode(), np.uint8).reshape(-1, SLOTS)
    return pd.Series(alike(rows(a), rows(b)))


def packed(prints: DataFrame) -> DataFrame:
    """(id, p0, p1, ...) of ``prints`` (id, fingerprint): 16 slots in each number."""
    return prints.select("id", *[F.conv(F.substring("fingerprint", 16 * i + 1, 16), 16, -10).cast("long").alias(f"p{i}") for i in range(SLOTS // 16)])


def at_least(least: float, other: str) -> Column:
    """Whether a row's packed fingerprint and the one that has ``other`` before its columns' names are alike by ``least``, exactly as ``alike`` tells."""
    most = max((k for k in range(SLOTS + 1) if alike(np.zeros((1, SLOTS)), np.arange(SLOTS)[None] < k)[0] >= least), default=-1)

    def apart(i: int) -> Column:
        x = F.col(f"p{i}").bitwiseXOR(F.col(f"{other}p{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111)))

    return reduce(add, [apart(i) for i in range(SLOTS // 16)]) <= most


def near_classes(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """Classes of near-equal fingerprints: (fingerprint, class) for distinct ``prints`` (fingerprint).

    ``BANDS`` overlapping runs of ``BAND`` slots give candidates: two prints of likeness 0.8 share one in 99 % of
    cases, unrelated ones once in 180 million. All slots verify them, as rows of packed slots meet: a bucket's members against its
    smallest, then against a few more, then all that is still in several classes against all (``families.linked``). Null fingerprints are left out; empty in, empty out.
    """
    distinct = stored(prints.select("fingerprint").where("fingerprint is not null").distinct().select(F.monotonically_increasing_id().alias("id"), "fingerprint"), "prints")
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("fingerprint", b * STEP + 1, BAND)) for b in range(BANDS)])
    buckets = distinct.select("id", F.explode(keys).alias("g"))
    firsts = stored(buckets.groupBy("g").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("g", "first"), "print-firsts")
    met = stored(buckets.join(firsts, "g"), "print-met")
    sketch = stored(packed(distinct), "print-packed")
    star = met.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    other = sketch.select(F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in sketch.columns[1:]])
    near = stored(star.join(sketch.withColumnRenamed("id", "a"), "a").join(other, "b").where(at_least(least, "b_")).select("a", "b"), "print-near")
    found = linked(met.select("g", "id"), components(near, "print-classes"), sketch, lambda b: at_least(least, b), lambda pairs: pairs, "print")
    roots = distinct.select(F.col("id").alias("root"), F.col("fingerprint").alias("class"))
    named = found.where("id <> root").join(roots, "root").select("id", "class")
    out = stored(distinct.join(named, "id", "left").select("fingerprint", F.coalesce("class", "fingerprint").alias("class")), "print-classes")
    for table in (distinct, firsts, met, sketch, near):
        discard(table)
    return out


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt out so that a task can stream each document with the one that follows it.

    Returns (part, wrap, own, id, text), partitioned by part and sorted by part, wrap, descending id and
    text. Parts are ranges of ids, bounded by quantiles. Texts are shuffled once: besides its own rows a
    part has, not as its own, the rows with which the next part begins, and the last part those with
    which the first does. Only one id for each part reaches the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce("id", F.lit(-(2**63)))
    ids = rows.select("id", key.alias("key"))
    bounds = sorted(set(ids.select(F.percentile_approx("key", F.array(*[F.lit((i + 1) / parts) for i in range(parts - 1)]), 10_000)).first()[0] or []), reverse=True)
    part = F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b > key)) if bounds else F.lit(0)
    heads = [(r["part"], r["head"]) for r in ids.groupBy(part.alias("part")).agg(F.max("key").alias("head")).orderBy("part").collect()]
    sent = spark.createDataFrame([(head, heads[i - 1][0], i == 0) for i, (_, head) in enumerate(heads)], "head long, to int, wrap boolean")
    beside = rows.join(F.broadcast(sent.repartition(1)), key == F.col("head"), "left")
    own = F.struct(part.alias("part"), F.lit(False).alias("wrap"), F.lit(True).alias("own"))
    carried = F.when(F.col("head").isNotNull(), F.struct(F.col("to").alias("part"), F.col("wrap"), F.lit(False).alias("own")))
    dealt = beside.select(F.inline(F.array_compact(F.array(own, carried))), "id", "text")
    # a number for each part that hashes to a task of its own
    slots = spark.range(40 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("slot")).agg(F.min("id").alias("n")).collect()
    numbers = {r["slot"]: r["n"] for r in slots}
    to = F.element_at(F.array(*[F.lit(int(numbers.get(i, -i - 1))) for i in range(parts)]), F.col("part") + 1)
    return dealt.withColumn("to", to).repartition(parts, "to").drop("to").sortWithinPartitions("part", "wrap", F.col("id").desc_nulls_last(), "text")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each own row and the row after it: the edited text's hash and the three fingerprints."""
    left = None
    for b in batches:
        rows = b if left is None else pd.concat([left, b], ignore_index=True)
        left = rows.tail(1)
        if len(rows) > 1:
            yield from _edit_run(rows)


def _edit_run(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    same = (rows["part"].to_numpy()[1:] == rows["part"].to_numpy()[:-1]) & rows["own"].to_numpy()[:-1]
    texts = rows["text"].tolist()
    at = np.flatnonzero(same)
    if not len(at):
        return
    edited = []
    for i in at:
        half = len(texts[i]) // 2
        edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
    prints = in_runs([*texts, *edited])
    own, after, new = prints[at], prints[at + 1], prints[len(texts) :]
    yield pd.DataFrame({
        "doc_id": rows["id"].iloc[at].astype("Int64"), "n_chars": [len(texts[i]) for i in at],
        "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
        "fingerprint": as_hex(own), "edited_fingerprint": as_hex(new), "near_edited": alike(own, new), "near_next": alike(own, after),
    })


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document, its edited text and, as a likeness, the next document; and its class.

    Null texts are empty; repeated ids follow each other in the order of their texts; null ids come
    last; a lone document follows itself. ``class_id`` is the smallest id of the documents whose fingerprints
    are near, by ``near_classes``, null where all are null.
    """
    rows = stored(beside_next(spark.read.parquet(f"{sf_dir}/documents.parquet")).mapInPandas(_edited, RESULT), "fingerprints")
    classes = near_classes(rows)
    lowest = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("low")).join(classes, "fingerprint")
    lowest = lowest.join(lowest.groupBy("class").agg(F.min("low").alias("class_id")), "class").select("fingerprint", "class_id")
    return rows.join(stored(lowest, "print-ids"), "fingerprint").select(*rows.columns, "class_id")


QUERIES = {"op9_fingerprints": op9_fingerprints}
ORACLES: dict[str, str] = {}
