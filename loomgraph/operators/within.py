"""Fixpoints that stay within a group: one pass over groups instead of rounds over everything."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from loomgraph.operators.graph import reachable
from loomgraph.scratch import stored

#: Groups of more references go through the rounds of ``reachable`` with all others of that size.
MOST = 100_000


def _closed(edges, seeds) -> list:
    """``seeds`` and all that ``edges`` (pairs) lead to from them."""
    after: dict = {}
    for e in edges:
        after.setdefault(e["src"], []).append(e["dst"])
    seen = dict.fromkeys(seeds)
    todo = list(seen)
    while todo:
        for to in after.get(todo.pop(), ()):
            if to not in seen:
                seen[to] = None
                todo.append(to)
    return list(seen)


def alive_within(refs: DataFrame, seeds: DataFrame, group: str = "path", most: int = MOST) -> DataFrame:
    """(group, node): ``seeds`` (group, node) and all that references (group, src, dst) lead to from them in their group.

    No reference leaves its group, so a group's references and seeds meet in one row and are followed there: one shuffle,
    whatever the longest way. Groups without seeds are not gathered, and those of more than ``most`` references never are: they go
    through global rounds instead, with the same result. Rows with nulls lead nowhere.
    """
    seeds = seeds.select(group, "node").where(F.col(group).isNotNull() & F.col("node").isNotNull()).distinct()
    refs = refs.select(group, "src", "dst").where(F.col(group).isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull())
    sizes = refs.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > most).select(group)
    large = stored(sizes, "large-groups")
    hot = not large.isEmpty()
    few = refs.join(F.broadcast(large), group, "left_anti") if hot else refs  # at most one in ``most`` references names a group here
    nodes = seeds.join(F.broadcast(large), group, "left_anti") if hot else seeds
    kind = nodes.schema["node"].dataType
    none = F.lit(None).cast(kind)
    rows = few.select(group, F.struct("src", "dst").alias("edge"), none.alias("node")).unionByName(nodes.select(group, F.lit(None).cast(few.select(F.struct("src", "dst").alias("e")).schema["e"].dataType).alias("edge"), "node"))
    gathered = rows.groupBy(group).agg(F.collect_list("edge").alias("edges"), F.collect_list("node").alias("seeds")).where(F.size("seeds") > 0)

    @F.pandas_udf(ArrayType(kind))
    def closed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for edges, starts in batches:
            yield pd.Series([_closed(e, s.tolist()) for e, s in zip(edges, starts)], dtype=object)

    led = gathered.where(F.size("edges") > 0).select(group, F.explode(closed("edges", "seeds")).alias("node"))
    out = led.unionByName(gathered.where(F.size("edges") == 0).select(group, F.explode("seeds").alias("node")))
    if hot:
        at = lambda c: F.struct(F.col(group).alias("g"), F.col(c).alias("n"))
        through = refs.join(F.broadcast(large), group, "left_semi").select(at("src").alias("src"), at("dst").alias("dst"))
        starts = seeds.join(F.broadcast(large), group, "left_semi").select(at("node").alias("node"))
        out = out.unionByName(reachable(through, starts, include_seeds=True).select(F.col("node.g").alias(group), F.col("node.n").alias("node")))
    return out
