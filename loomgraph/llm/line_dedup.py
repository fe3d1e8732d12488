"""Fuzzy line dedup by MinHash, in DataFrame operations alone.

Lines are sets of shingles of eight characters. Equal lines are one from the start; each distinct line
gets a MinHash signature, ``SLOTS`` minima of shingle hashes, from one aggregate over the shingles where
the texts are, so that signatures are shuffled and texts are not. Overlapping bands of three slots find
candidates with high recall; exact Jaccard similarity of the whole lines verifies them; connected
components over what is verified say which lines are one, and of each component the line that comes
first in the corpus stays.

A bucket's pairs are never written. Its members are verified against its first. Where that leaves them in several components, all
meet a few members picked at random, and last what is still outside of a bucket's largest component meets all of it (``families.linked``): a sketch of
1024 bits, the parity of the shingles that fall on each, tells as rows meet and without a text which pairs cannot be alike, and never takes
an alike pair for one; only the others are written and verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import components, own_columns, row_of, stored, text_key
from loomgraph.llm.families import across, linked, places_apart
from loomgraph.scratch import discard

CHARS = 8
SIMILARITY = 0.8
SLOTS = 12
#: So many places of a line are a row while its signature is made, the last place repeated.
AT_ONCE = 4
#: Words of 64 bits in a line's sketch, a power of two.
WORDS = 16
#: Every slot is in two bands. A pair at 0.8 shares one in 99.5 % of cases.
BANDS = ((0, 1, 2), (3, 4, 5), (6, 7, 8), (9, 10, 11), (0, 3, 6), (1, 4, 9), (2, 7, 10), (5, 8, 11))


def doc_key() -> Column:
    """A name of a row's doc_id and text."""
    return F.unhex(text_key(F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))))


def lines_of(docs: DataFrame) -> DataFrame:
    """(h1, h2, line) of all lines that are not blank: two hashes name a line."""
    lines = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).where("line rlike '\\\\S'")
    return lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), "line")


def places_of(docs: DataFrame) -> DataFrame:
    """(h1, h2, place) of all lines that are not blank; places are in the order of the corpus."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("doc_key"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "doc_key", "line_no")
    return lines.where("line rlike '\\\\S'").select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), place.alias("place"))


def shingles(line: Column) -> Column:
    """64-bit names of a line's shingles, repeated ones too; a line below ``CHARS`` characters is one shingle."""
    cut = F.when(F.char_length(line) < CHARS, F.array(line)).otherwise(F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{CHARS}}}))."), F.lit(1)))
    return F.transform(cut, lambda s: F.xxhash64(s))


def signatures(lines: DataFrame) -> DataFrame:
    """(h1, h2, s0, s1, ...) of the distinct ``lines`` (h1, h2, line): minima of the shingles' hashes.

    Slot i keeps the hash nearest to a constant of its own, by exclusive or: for random hashes that is
    as random a choice among a line's shingles as the smallest of a hash of its own.
    """
    wide = lines.select("h1", "h2", F.encode("line", "UTF-32").alias("wide"))
    # counting by the encoded line makes generated code encode before its loop over places, not in it
    last = F.greatest(F.lit(1), F.shiftright(F.octet_length("wide"), 2) - CHARS + 1)
    places = wide.select("h1", "h2", "wide", last.alias("last"), F.explode(F.sequence(F.lit(1), last, F.lit(AT_ONCE))).alias("i"))
    each = [F.hash(F.substring("wide", 4 * F.least(F.col("i") + k, "last") - 3, F.lit(4 * CHARS))).alias(f"k{k}") for k in range(AT_ONCE)]
    hashed = places.select("h1", "h2", *each)
    constants = [(i * 2654435761 + 97) % 2**32 - 2**31 for i in range(1, SLOTS + 1)]
    least = lambda c: F.min(F.least(*[F.col(f"k{k}").bitwiseXOR(F.lit(c)) for k in range(AT_ONCE)]))
    return hashed.groupBy("h1", "h2").agg(*[least(c).alias(f"s{i}") for i, c in enumerate(constants)])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose lines, found in ``texts`` (id, text), are alike: Jaccard of distinct shingles."""
    lines = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", shingles(F.col("x")).alias("x"), shingles(F.col("y")).alias("y"))
    return lines.where(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")) >= SIMILARITY).select("a", "b")


def sketches(texts: DataFrame) -> DataFrame:
    """(id, n, p0, p1, ...) of ``texts`` (id, text): a line's number of distinct shingles, and for each of 1024 places whether an odd number of them fall there."""
    each = texts.select("id", F.explode(F.array_distinct(shingles(F.col("text")))).alias("s"))
    placed = each.select("id", F.col("s").bitwiseAND(WORDS - 1).alias("word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(s, 32) & 63 as int))").alias("bit"))
    odd = [F.coalesce(F.bit_xor(F.when(F.col("word") == i, F.col("bit"))), F.lit(0).cast("long")).alias(f"p{i}") for i in range(WORDS)]
    return placed.groupBy("id").agg(F.count("*").alias("n"), *odd)


def may_be_alike(other: str) -> Column:
    """Whether a row's line and the one whose sketch has ``other`` before its columns' names may be alike; never false if they are.

    Lines are alike if and only if they differ in at most (|x| + |y|) (1 - t) / (1 + t) shingles, at threshold t. They
    differ in at least as many as their sizes do, and as their sketches have places apart.
    """
    room = (F.col("n") + F.col(f"{other}n")) * (1 - SIMILARITY) / (1 + SIMILARITY) + 1e-6
    return (F.abs(F.col("n") - F.col(f"{other}n")) <= room) & (places_apart(other, WORDS) <= room)


def prefixed(sketch: DataFrame, prefix: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}{c}") for c in sketch.columns if c != "id"]


def within(met: DataFrame, sketch: DataFrame, found: DataFrame, pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """For groups ``met`` (g, id): pairs that ``across`` finds to be alike at most by their ``sketch``, and (g, id) of groups with more members than ``pivots``, if given."""
    large = met.groupBy("g").agg(F.count("*").alias("n")).where(F.lit(False) if pivots is None else F.col("n") > pivots).select("g")
    return across(met, found, sketch, may_be_alike, "line", pivots), met.join(large, "g")


def compared(beside: DataFrame) -> DataFrame:
    """What lines and their pivots differ in, for ``settled``.

    Lines x and y are alike if and only if they differ in at most (|x| + |y|) (1 - t) / (1 + t) shingles, at
    threshold t. If they share none of D, then |D(x)| + |D(y)| is at most that, so each is alike to the pivot.
    """
    sets = beside.select("family", "id", "root", "pivot", shingles(F.col("text")).alias("x"), shingles(F.col("pivot_text")).alias("p"))
    n, added, apart = F.size(F.array_distinct("x")), F.size(F.array_except("x", "p")), F.concat(F.array_except("x", "p"), F.array_except("p", "x"))
    rows = sets.select("family", "id", "root", "pivot", n.alias("n"), added.alias("added"), apart.alias("apart"))
    near = (F.col("n") - F.col("added")) / (F.col("n") - F.col("added") + F.size("apart")) >= SIMILARITY
    return rows.select("family", "id", "root", "pivot", near.alias("near"), (F.col("n") * (1 - SIMILARITY) / (1 + SIMILARITY)).alias("room"), "apart")


def line_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: (id, h1, h2, slots) of the distinct lines, and (id, root) of those that are alike to others."""
    slots = F.array(*[f"s{i}" for i in range(SLOTS)]).alias("slots")
    signed = stored(signatures(lines_of(docs)).select(F.monotonically_increasing_id().alias("id"), "h1", "h2", slots), "line-signatures")
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.get("slots", F.lit(i)) for i in band]) for b, band in enumerate(BANDS)])
    buckets = signed.select("id", F.explode(keys).alias("g"))
    firsts = stored(buckets.groupBy("g").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("g", "first"), "line-firsts")
    met = stored(buckets.join(firsts, "g"), "line-met")
    star = stored(met.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct(), "line-star")
    wanted = star.select(F.col("a").alias("id")).unionByName(star.select(F.col("b").alias("id"))).distinct()
    named = stored(wanted.join(signed, "id").select("id", "h1", "h2"), "line-wanted")
    texts = stored(lines_of(docs).join(named, ["h1", "h2"]).groupBy("id").agg(F.min("line").alias("text")), "line-texts")
    sketch = stored(sketches(texts), "line-sketches")
    close = star.join(sketch.withColumnRenamed("id", "a"), "a").join(sketch.select(F.col("id").alias("b"), *prefixed(sketch, "b_")), "b").where(may_be_alike("b_")).select("a", "b")
    near = stored(verified(close, texts), "line-near")
    found = components(near, "line-classes")
    discard(near)
    found = linked(met.select("g", "id"), found, sketch, may_be_alike, lambda pairs: verified(pairs, texts), "line")
    for table in (firsts, met, star, named, texts, sketch):
        discard(table)
    return signed, found


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_key, gone): of each document that loses lines, their numbers (from 0).

    Lines compare in whole, case and white space included, across all documents and within one. The
    line that stays is the first by doc_id (nulls last), doc_key and number. Blank lines always stay.
    """
    signed, found = line_classes(docs)
    root = signed.select(F.col("id").alias("root"), F.struct("h1", "h2").alias("class"))
    moved = stored(found.where("id <> root").join(root, "root").join(signed.select("id", "h1", "h2"), "id").select("h1", "h2", "class"), "line-roots")
    discard(signed)
    firsts = places_of(docs).groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count("*").alias("n"))
    firsts = stored(firsts.join(moved, ["h1", "h2"], "left").withColumn("class", F.coalesce("class", F.struct("h1", "h2"))), "line-firsts")
    several = firsts.groupBy("class").agg(F.min("place").alias("winner"), F.sum("n").alias("n")).where("n > 1").select("class", "winner")
    winners = stored(firsts.select("h1", "h2", "class").join(several, "class").select("h1", "h2", "winner"), "line-winners")
    discard(firsts)
    gone = places_of(docs).join(winners, ["h1", "h2"]).where("place <> winner").select("place.doc_key", "place.line_no")
    gone = stored(gone.groupBy("doc_key").agg(F.collect_set("line_no").alias("gone")), "line-gone")
    discard(winners)
    return gone


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that repeat others, with n_lines and n_kept.

    The lines that stay are joined by a newline again. A text that loses nothing stays as it is; null
    texts stay null, with one line that stays. Of rows with the same id and text the first keeps its
    lines, and the others keep blank lines only. Other columns are handed on, whatever their names;
    columns called n_lines and n_kept are replaced. Empty in, empty out.
    """
    lost = dropped_lines(docs)
    keyed = docs.select(row_of(docs).alias("row"), doc_key().alias("doc_key"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines")).join(lost, "doc_key", "left")
    keyed = keyed.withColumn("copy", F.row_number().over(Window.partitionBy("doc_key").orderBy("doc_key"))).withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    blank = F.filter("lines", lambda x: ~x.rlike(r"\S"))
    kept = F.when(F.col("copy") > 1, blank).when(F.size("gone") == 0, F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)))
    keyed = keyed.withColumn("kept", kept)
    text = F.when(F.col("row.text").isNotNull(), F.array_join("kept", "\n"))
    return keyed.select(*own_columns(docs, text=text, n_lines=F.size("lines").cast("long"), n_kept=F.size("kept").cast("long")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines and what stays of them; nulls, copies and empty tables as in ``deduplicated``."""
    kept = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return kept.select("doc_id", "n_lines", "n_kept", F.char_length(text).cast("long").alias("n_chars"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLES: dict[str, str] = {}
