"""Best-fit packing of documents into sequences under conflicts.

Pieces of documents go, longest first, into the tightest bin that has room and no conflict: a bin
never holds two pieces of one source or of one duplicate cluster. Bins are ordered by what is left of
them, and each carries a bitmap of its sources and one of its clusters; the search starts at the
tightest bin with room and goes on to the next until one is compatible, else it opens a bin.

Pieces are dealt to shards of about ``shard_rows`` by hash, whatever their source or cluster, repeated
rows too, and Spark packs the shards in parallel; their number grows with the corpus, and what is in one depends
on the rows alone.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import stored, text_key

CAPACITY = 2048
SHARD_ROWS = 8192
#: Sources of at least one piece in so many have their rooms kept apart.
_FREQUENT = 64


def best_fit(lengths: list[int], sources: list[object], clusters: list[object], capacity: int) -> list[tuple[int, int]]:
    """(bin, slot) of each piece, pieces being taken in the given order; none is longer than ``capacity``.

    Bins are kept by what room they have left, and each source and cluster has the bitmap of the bins that hold it. The search goes
    from the tightest room that is long enough to the next that any bin has, and takes the first bin there that holds neither: all
    bins of a room that hold one are passed over in one step, and for a source of many pieces so are all rooms whose bins hold it. So a piece takes
    as many steps as there are different rooms, at most.
    """
    many = [s for s, n in Counter(sources).items() if n * _FREQUENT >= len(sources)]
    open_to = dict.fromkeys(many, 0)  # the rooms that have a bin without the source, as a bitmap
    repeated = {c for c, n in Counter(clusters).items() if n > 1}  # others can't conflict
    with_source: dict[object, int] = {}
    with_cluster: dict[object, int] = {}
    by_room: dict[int, int] = {}  # the bins of each room, as a bitmap
    rooms = 0  # the rooms that bins have, as a bitmap
    pieces: list[int] = []  # of each bin
    out = []
    for length, source, cluster in zip(lengths, sources, clusters):
        held = with_source.get(source, 0) | with_cluster.get(cluster, 0)
        room, left, free = length, open_to.get(source, rooms) >> length, 0
        while left:
            skip = (left & -left).bit_length() - 1
            room, left = room + skip, left >> skip
            free = by_room[room] & ~held
            if free:
                break
            room, left = room + 1, left >> 1
        if free:
            bit = free & -free
            by_room[room] ^= bit
            if not by_room[room]:
                rooms ^= 1 << room
            for s in many:
                if open_to[s] >> room & 1 and not by_room[room] & ~with_source.get(s, 0):
                    open_to[s] ^= 1 << room
        else:
            room, bit = capacity, 1 << len(pieces)
            pieces.append(0)
        b = bit.bit_length() - 1
        out.append((b, pieces[b]))
        pieces[b] += 1
        with_source[source] = with_source.get(source, 0) | bit
        if cluster in repeated:
            with_cluster[cluster] = with_cluster.get(cluster, 0) | bit
        by_room[room - length] = by_room.get(room - length, 0) | bit
        rooms |= 1 << (room - length)
        for s in many:
            if not with_source.get(s, 0) & bit:
                open_to[s] |= 1 << (room - length)
    return out


def pack(docs: DataFrame, cluster: str | None = None, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Places of all pieces: doc_id, source, piece, first_word, n_words, shard, bin, slot.

    A document's length is its number of words apart by white space. Longer ones than ``capacity`` are
    cut into full pieces and a rest; empty and null texts are one piece without words. ``cluster``
    names the column of duplicate clusters, a null there being none; by default equal texts are one.
    Null sources and ids are values like others; repeated rows are packed each on their own and, as
    one cluster, into different bins.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    key = text_key(text) if cluster is None else F.coalesce(F.col(cluster).cast("string"), F.concat(F.lit("own:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text_key(text)))
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").cast("string").alias("source"), key.alias("cluster"), words.alias("words"))
    same = rows.groupBy("doc_id", "source", "cluster", "words").agg(F.count("*").alias("n"))  # repeated rows are told apart by number, however they are dealt out
    rows = same.select("doc_id", "source", "cluster", "words", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    rows = stored(rows, "lengths")  # without texts: the number of pieces and the pieces come from it
    pieces = rows.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("words") / capacity)))).first()[0] or 0
    shards = max(1, -(-pieces // shard_rows))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("words") - 1) / capacity).cast("int")))))
    rows = rows.select(
        "doc_id", "source", "cluster", "piece", (F.col("piece") * capacity).cast("long").alias("first_word"),
        F.least(F.lit(capacity), F.col("words") - F.col("piece") * capacity).cast("long").alias("n_words"),
        F.pmod(F.xxhash64("doc_id", "source", "cluster", "piece", "copy"), F.lit(shards)).cast("int").alias("shard"),
    )

    def packed(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["n_words", "cluster", "piece", "doc_id", "source"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
        places = best_fit(p["n_words"].tolist(), [None if pd.isna(s) else s for s in p["source"]], p["cluster"].tolist(), capacity)
        return p.assign(bin=[b for b, _ in places], slot=[s for _, s in places]).drop(columns="cluster")

    schema = "doc_id string, source string, piece int, first_word long, n_words long, shard int, bin int, slot int"
    return rows.groupBy("shard").applyInPandas(packed, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document; nulls, empty texts, repeated rows and empty tables as in ``pack``."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_packing": op4_packing}
ORACLES: dict[str, str] = {}
