"""Paths rewritten by a table of links, as a fixpoint of joins on their prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.paths import ancestors, normalize_path
from loomgraph.scratch import stored

#: So many links may follow each other, as in file systems.
MOST_HOPS = 40


def rewritten(wanted: DataFrame, links: DataFrame, most_hops: int = MOST_HOPS) -> DataFrame:
    """(path, real) of distinct ``wanted`` (path): the path with every step that is a link replaced by its target.

    ``links`` is (link, target). In each round a path's shortest prefix that is a link is replaced; paths are joined by
    equality on their prefixes, so the rows of a round are as many as the steps of paths still on their way. Links may lead to
    links or to what is below some; one that leads back to where it was, or on for more than ``most_hops``, has null as
    ``real``.
    """
    front = wanted.select("path", F.col("path").alias("real"), F.array("path").alias("seen")).where("path is not null").distinct()
    done = []
    for _ in range(most_hops):
        steps = front.select("path", "real", "seen", F.posexplode(F.concat(F.reverse(ancestors(F.col("real"))), F.array("real"))).alias("n", "link"))
        first = steps.join(links, "link").groupBy("path").agg(F.min_by(F.struct("real", "seen", "link", "target"), F.struct("n", "target")).alias("x"))
        rest = F.substring("x.real", F.length("x.link") + 1, F.length("x.real"))
        moved = first.select("path", normalize_path(F.concat("x.target", rest)).alias("real"), F.col("x.seen").alias("seen"))
        moved = stored(moved.select("path", "real", F.array_contains("seen", F.col("real")).alias("ring"), F.concat("seen", F.array("real")).alias("seen")), "links-moved")
        done.append(front.join(moved.select("path"), "path", "left_anti").select("path", "real"))
        done.append(moved.where("ring").select("path", F.lit(None).cast("string").alias("real")))
        front = moved.where("not ring").drop("ring")
        if front.isEmpty():
            break
    else:
        done.append(front.select("path", F.lit(None).cast("string").alias("real")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
