"""Near-duplicate documents by ProbMinHash.

A text is a weighted set: its shingles of five words, each as often as it occurs. In ProbMinHash every
shingle sends arrivals of a Poisson process, at a rate that is its weight, to random registers; each
register keeps the shingle that came first. The share of equal registers of two texts estimates
their probability Jaccard similarity

    J_P(a, b) = sum over x of 1 / (sum over y of max(a_y / a_x, b_y / b_x)).

Arrivals stop mattering once they are later than every register, which ends the process early: a text
takes a few arrivals more than it has shingles. Bands of registers then give candidates, and J_P of
the whole texts verifies them.

Equal texts are one from the start. A bucket is never expanded into its pairs: all its members are
verified against its first, which leaves whole groups of copies in few components. Families of
candidates that are still in several are settled exactly: small ones each within a task, larger ones
in blocks (see ``families``), where sketches of the sets rule out most pairs before J_P is computed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import components, own_columns, row_of, stored, text_key
from loomgraph.llm.families import LAST, in_blocks
from loomgraph.scratch import discard

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6  # a pair at 0.8 is missed once in 16,000 times; unrelated texts all but never meet
BLOCK = 128  # a family of so many texts is linked within one task
CELL = 512  # a larger one is dealt out in blocks of about so many texts, of which any two meet within one task,
CELL_CHARS = 4_000_000  # and of about so many characters
BITS = 1024, 65_536  # of a sketch, by how large the sets of a cell are
PLACES = 2**24
_WORD = re.compile(r"\w+")


def shingles(text: str | None, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the text's shingles, ascending, and their counts. Fewer words than ``words`` are one shingle, none give none."""
    tokens = _WORD.findall((text or "").lower())
    if not tokens:
        return np.empty(0, np.uint64), np.empty(0)
    ids: dict[str, int] = {}
    order = np.fromiter((ids.setdefault(t, len(ids)) for t in tokens), np.int64, len(tokens))
    return np.unique(_rolled(_word_hashes(list(ids))[order], words), return_counts=True)


def _word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word that every process computes alike."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    lengths = np.array([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = (np.arange(len(data)) - np.repeat(starts, lengths)).astype(np.uint64)
    return _mix(np.add.reduceat(_mix(data * np.uint64(0x100000001B3) + place * np.uint64(0x9E3779B97F4A7C15)), starts) + lengths.astype(np.uint64))


def _mix(h: np.ndarray) -> np.ndarray:
    """Bits spread over all of 64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _rolled(hashes: np.ndarray, words: int) -> np.ndarray:
    n = max(1, len(hashes) - words + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(words, len(hashes))):
        out = _mix(out * np.uint64(31) + hashes[i : i + n])
    return out


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash registers (shingle hashes) of weighted sets, one row each; empty sets give zeros.

    All sets run side by side: a round draws the next arrival of each shingle that may still matter.
    """
    out = np.zeros((len(sets), registers), np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    if not len(owner):
        return out
    element = np.concatenate([h for h, _ in sets])
    weight = np.concatenate([w for _, w in sets]).astype(float)
    first = np.full((len(sets), registers), np.inf)
    arrival = np.zeros(len(element))
    state = element.copy()
    flat_first, flat_out = first.ravel(), out.ravel()
    while len(owner):
        state = _mix(state + np.uint64(0x9E3779B97F4A7C15))
        arrival = arrival - np.log1p(-(state >> np.uint64(11)).astype(float) / 2.0**53) / weight
        at = owner * registers + (_mix(state) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(flat_first, at, arrival)
        came = flat_first[at] == arrival
        flat_out[at[came]] = element[came]
        late = first.max(1)
        alive = arrival < late[owner]
        owner, element, weight, arrival, state = owner[alive], element[alive], weight[alive], arrival[alive], state[alive]
    return out


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two weighted sets of ascending hashes; of two empty sets 1."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    wa, wb = a[1][ia].astype(float), b[1][ib].astype(float)
    ratio = wb / wa
    order = np.argsort(ratio)
    r, xa, xb = ratio[order], wa[order], wb[order]
    # sum of max(a_y / a_x, b_y / b_x): a_y / a_x where b_y / a_y <= b_x / a_x, else b_y / b_x
    upto = np.searchsorted(r, r, side="right")
    sum_a, sum_b = np.concatenate([[0], np.cumsum(xa)]), np.concatenate([[0], np.cumsum(xb)])
    only_a, only_b = a[1].sum() - wa.sum(), b[1].sum() - wb.sum()
    below = (sum_a[upto] + only_a) / xa
    above = (sum_b[-1] - sum_b[upto] + only_b) / xb
    return float((1.0 / (below + above)).sum())


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each distinct text: its number of shingles and the hash of each band."""
    for b in batches:
        for start in range(0, len(b), 512):
            part = b.iloc[start : start + 512]
            sets = [shingles(t) for t in part["text"]]
            regs = signatures(sets).reshape(len(part), BANDS, ROWS)
            keys = np.zeros((len(part), BANDS), np.uint64)
            for r in range(ROWS):
                keys = _mix(keys * np.uint64(31) + regs[:, :, r] + np.uint64(r + 1))
            keys = _mix(keys + np.arange(BANDS, dtype=np.uint64)[None])
            yield pd.DataFrame({"id": part["id"], "n": [len(h) for h, _ in sets], "buckets": list(keys.view(np.int64))})


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        known: dict[str, tuple] = {}  # of this batch: a bucket's first text comes with many others
        near = []
        for x, y in zip(b["text_a"], b["text_b"]):
            if y not in known:
                known = known if len(known) < 64 else {}
                known[y] = shingles(y)
            near.append(probability_jaccard(shingles(x), known[y]) >= SIMILARITY)
        yield b.loc[near, ["a", "b"]]


def _block(pair: pd.DataFrame) -> pd.DataFrame:
    """Links between components among the few texts of a family, one link for each two that are alike."""
    none = pd.DataFrame({"a": [], "b": []}, dtype=object)
    if pair["root"].nunique() < 2:
        return none
    pair = pair.sort_values("id", ignore_index=True)
    sets = [shingles(t) for t in pair["text"]]
    sizes = np.array([len(h) for h, _ in sets])
    plain = np.array([bool((w == 1).all()) for _, w in sets])
    _, column = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    share = np.concatenate([w / w.sum() for _, w in sets if len(w)] or [np.empty(0)]).astype(np.float32)
    shared = np.zeros((len(sets), len(sets)), np.float32)
    covered = np.zeros_like(shared)  # which share of a row's weight is on shingles that the column's text has
    for start in range(0, int(column.max(initial=-1)) + 1, 4096):
        here = (column >= start) & (column < start + 4096)
        holds = np.zeros((len(sets), 4096), np.float32)
        holds[row[here], column[here] - start] = 1
        shared += holds @ holds.T
        if not plain.all():
            weighs = np.zeros_like(holds)
            weighs[row[here], column[here] - start] = share[here]
            covered += weighs @ holds.T
    alike = shared / np.maximum(1, sizes[:, None] + sizes[None] - shared)
    both_plain = plain[:, None] & plain[None]
    roots = pd.factorize(pair["root"])[0]
    covered = np.maximum(covered, 1e-9)
    maybe = np.where(both_plain, alike >= SIMILARITY, 1 / covered + 1 / covered.T <= 1 + 1 / (SIMILARITY - 0.001))  # see ``_cell``
    maybe &= roots[:, None] != roots[None]
    up = list(range(len(sets)))

    def top(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    links = []
    ids = pair["id"].tolist()
    for i, j in zip(*np.nonzero(np.triu(maybe, 1))):
        if top(roots[i]) != top(roots[j]) and (both_plain[i, j] or probability_jaccard(sets[i], sets[j]) >= SIMILARITY):
            links.append((ids[i], ids[j]))
            up[top(roots[i])] = top(roots[j])
    return pd.DataFrame(links, columns=["a", "b"], dtype=object) if links else none


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts as their shingles in bytes: ``hashes``, and ``counts``, empty where all are 1."""
    for b in batches:
        for start in range(0, len(b), 512):
            part = b.iloc[start : start + 512]
            sets = [shingles(t) for t in part["text"]]
            yield part.drop(columns="text").assign(hashes=[h.tobytes() for h, _ in sets], counts=[b"" if (w == 1).all() else w.astype(np.int64).tobytes() for _, w in sets])


def _sketches(sets: list[tuple[np.ndarray, np.ndarray]], bits: int) -> np.ndarray:
    """A row of bits for each set: whether an odd number of its elements fall on a bit. Rows differ in no more bits than their sets in elements."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    place = _mix(np.concatenate([h for h, _ in sets])) % np.uint64(bits)
    row = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    np.bitwise_xor.at(out.ravel(), row * (bits // 64) + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out


def _cell(cell: pd.DataFrame) -> pd.DataFrame:
    """Links between components among the texts of two blocks, or of one with itself, one link for each two components that have some.

    Let c and d be the shares of the weights of a and b that are on shingles which both have. By the sums over
    y of A and of B alone, x's term of J_P is at most q_x min(r / (1 + r (1 - d)), r / (r + 1 - c)), p and q being the normed weights and r = p_x / q_x.
    That is concave in r, and the q_x sum up to d, the q_x r to c; so J_P is at most 1 / (1 / c + 1 / d - 1), which for sets is what it is.
    As each shingle weighs 1 at least, the number of unshared ones bounds c and d, and sketches bound that number.
    """
    cell = cell.sort_values("id", ignore_index=True)
    sets = []
    for h, w in zip(cell["hashes"], cell["counts"]):
        h = np.frombuffer(h, np.uint64)
        sets.append((h, np.frombuffer(w, np.int64) if len(w) else np.ones(len(h), np.int64)))
    sizes, weights = np.array([len(h) for h, _ in sets]), np.array([w.sum() for _, w in sets])
    sketches = _sketches(sets, int(min(BITS[1], max(BITS[0], 2 ** np.ceil(np.log2(2 * np.percentile(weights, 75) + 1))))))
    label = pd.factorize(cell["root"])[0]
    ids = cell["id"].tolist()
    ours, theirs = (np.flatnonzero(cell["block"] == cell[c]) for c in ("lo", "hi"))
    within = cell["lo"].iat[0] == cell["hi"].iat[0]
    links = []
    for i in ours:
        js = theirs[theirs > i] if within else theirs
        js = js[label[js] != label[i]]
        apart = np.maximum(np.bitwise_count(sketches[js] ^ sketches[i]).sum(1, dtype=np.int64), np.abs(sizes[js] - sizes[i]))
        alone, other = (apart + sizes[i] - sizes[js]) / 2, (apart - sizes[i] + sizes[js]) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            far = alone / (weights[i] - alone) + other / (weights[js] - other)  # 1 / c + 1 / d - 2
        maybe = np.flatnonzero(~(far > 1 / SIMILARITY - 1 + 1e-9))
        for j in js[maybe[np.argsort(far[maybe], kind="stable")]]:
            if label[i] != label[j] and probability_jaccard(sets[i], sets[j]) >= SIMILARITY:
                links.append((ids[i], ids[j]))
                label[label == label[j]] = label[i]
    return pd.DataFrame(links or {"a": [], "b": []}, columns=["a", "b"], dtype=object)


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What texts and their pivots differ in, for ``settled``: shingles that one of them has.

    Let A and B be the sets of shingles of a and b, and e(a) what a's count of shingles exceeds |A| by. A
    term of J_P is at most max(a_x, b_x) over the sum of max(a_y, b_y), so J_P >= t means that the
    unshared shingles are at most (1 - t) / t of the sum of max over the shared ones, which is at most |A and B| +
    e(a) + e(b). Hence |A xor B| <= (1 - t) / (1 + t) (|A| + 2 e(a) + |B| + 2 e(b)).
    """
    for b in batches:
        known: dict[str, tuple] = {}
        near, room, apart = [], [], []
        for x, p in zip(b["text"], b["pivot_text"]):
            if p not in known:
                known = known if len(known) < 16 else {}
                known[p] = shingles(p)
            a, c = shingles(x), known[p]
            near.append(probability_jaccard(a, c) >= SIMILARITY)
            room.append((2 * a[1].sum() - len(a[0])) * (1 - SIMILARITY) / (1 + SIMILARITY))
            apart.append(np.append(np.setxor1d(a[0], c[0], assume_unique=True).view(np.int64), LAST))
        yield b[["family", "id", "root", "pivot"]].assign(near=near, room=np.array(room, float), apart=apart)


def near_classes(docs: DataFrame) -> DataFrame:
    """(key, class_key, class_id) of the texts of ``docs`` (doc_id, text): the class of each distinct text.

    ``key`` is ``text_key`` of the text, ``class_key`` that of one text of its class, ``class_id`` the smallest doc_id of its class, null only where
    all are null. Null texts are empty; texts without words are alike. Rows may repeat.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_of("text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    firsts = keyed.groupBy("key").agg(F.min("doc_id").alias("first_id"))
    signed = keyed.select(F.col("key").alias("id"), "text").mapInPandas(_signed, "id binary, n int, buckets array<long>")
    signed = stored(signed.dropDuplicates(["id"]), "signed")
    buckets = signed.select("id", F.explode("buckets").alias("bucket"))
    firsts_of = buckets.withColumn("b", F.min("id").over(Window.partitionBy("bucket")))  # one shuffle; an aggregate would need two
    star = stored(firsts_of.where("id <> b").select(F.col("id").alias("a"), "b").distinct(), "star")
    wanted = star.select(F.col("a").alias("key")).unionByName(star.select(F.col("b").alias("key"))).distinct()
    texts = likely(keyed.select("key", "text"), wanted).join(wanted, "key").groupBy("key").agg(F.first("text").alias("text"))
    texts = stored(texts.withColumnRenamed("key", "id"), "texts")
    links = stored(_verified(star, texts), "links")
    families = components(star, "families").select(F.xxhash64("root").alias("g"), "id")
    found = in_blocks(families, components(links, "classes"), texts, _linked, BLOCK, _met, CELL, CELL_CHARS, "near")
    for table in (signed, star, texts, links):
        discard(table)
    joined = firsts.join(found.withColumnRenamed("id", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = joined.where("root <> key or first_id is null").select("root").distinct()  # only these need a look at others
    lowest = joined.join(named, "root", "left_semi").groupBy("root").agg(F.min("first_id").alias("lowest"))
    return joined.join(lowest, "root", "left").select("key", F.col("root").alias("class_key"), F.coalesce("lowest", "first_id").alias("class_id"))


APART = "family binary, id binary, root binary, pivot binary, near boolean, room double, apart array<long>"


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts, found in ``texts`` (id, text), are alike."""
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInPandas(_verify, "a binary, b binary")


def _linked(members: DataFrame) -> DataFrame:
    """Links within families of at most ``BLOCK`` members (family, id, root, text)."""
    return members.groupBy("family").applyInPandas(lambda p: _block(p), "a binary, b binary")


def _met(dealt: DataFrame) -> DataFrame:
    """Links within and between blocks of larger families, from (g, id, root, block, others, text)."""
    sets = dealt.mapInPandas(_sets, "g long, id binary, root binary, block int, others array<int>, hashes binary, counts binary")
    cells = sets.withColumn("other", F.explode("others")).select("g", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "root", "hashes", "counts")
    return cells.groupBy("g", "lo", "hi").applyInPandas(lambda p: _cell(p), "a binary, b binary")


def likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """All of ``rows`` (key, text) whose key is in ``wanted`` (key), and a few others: it spares the shuffle most texts.

    Keys fall on ``PLACES`` bits, which are sent to each task as words, a row each: 4 MB at most, however many keys there are.
    A semi join must not follow, as Spark would put it first.
    """
    at = lambda df: df.withColumn("place", F.pmod(F.xxhash64("key"), F.lit(PLACES))).withColumn("word", F.shiftright("place", 6)).withColumn("bit", F.expr("shiftleft(1L, int(place & 63))"))
    words = at(wanted).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return at(rows).join(F.broadcast(words), "word").where("bits & bit <> 0").select(*rows.columns)


def key_of(text: str):
    """The 128-bit name of a column's text."""
    return F.unhex(text_key(F.col(text)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate class: that of the smallest doc_id, all columns of ``docs`` kept, whatever their names.

    Of several rows with that id one stays, as of rows without ids in a class without ids. Null texts
    are empty ones, and all texts without words are one class. Empty in, empty out.
    """
    rows = docs.select(row_of(docs).alias("row"), key_of("text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"))
    kept = rows.join(near_classes(docs), "key").where("class_id is null or doc_id = class_id")
    return kept.dropDuplicates(["class_key"]).select(*own_columns(docs))


def op7_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class, and whether it is the one that stays.

    Null and empty texts and all without words are one class; equal texts are in one class, repeated rows repeat their result, and
    rows of the class' smallest id are all marked kept. Null ids are never kept. Texts of any length count in whole. Empty in, empty out.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    keyed = docs.select("doc_id", key_of("text").alias("key"))
    return keyed.join(near_classes(docs), "key").select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"))


QUERIES = {"op7_near_dups": op7_near_dups}
ORACLES: dict[str, str] = {}
