"""What several corpus operators share: keys of texts, columns of rows and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.scratch import discard, shared_dir, stored

__all__ = ["components", "own_columns", "row_of", "shared_dir", "stored", "text_key"]


def text_key(text: Column) -> Column:
    """128 bits that name a text: equal texts share them, and different ones don't in practice."""
    filled = F.coalesce(text, F.lit(""))
    return F.concat(F.lpad(F.hex(F.xxhash64(filled)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(7), filled)), 16, "0"))


def row_of(docs: DataFrame) -> Column:
    """All columns of ``docs`` in one struct, so that a column of theirs can't clash with one of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def own_columns(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of ``docs`` again out of a struct ``row``; those in ``new`` replace the ones of the same name or follow."""
    names = {c.lower() for c in docs.columns}
    lower = {n.lower(): c for n, c in new.items()}
    kept = [lower.get(c.lower(), F.col("row").getField(c)).alias(c) for c in docs.columns]
    return kept + [c.alias(n) for n, c in new.items() if n.lower() not in names]


def components(links: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``links`` (a, b) as (id, root), root the smallest id.

    Alternates large-star and small-star: each round hangs a node's larger neighbours, then its
    smaller ones, on the smallest. Only a count and a checksum reach the driver. Links to itself or
    with a null end are ignored; nodes without a link don't appear.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b and a is not null and b is not null").distinct()

    def kept(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = stored(df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("check")), label)
        return out, (seen.get["n"], seen.get["check"])

    edges, before = kept(edges)
    for _ in range(max_rounds if before[0] else 0):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        last, (edges, now) = edges, kept(small.unionByName(lowest.select("a", F.col("low").alias("b"))).where("a <> b").distinct())
        discard(last)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()
