"""Longest-prefix join: each path with its nearest enclosing root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.paths import ancestors


def project_of(files: DataFrame, projects: DataFrame, path: str = "path", root: str = "root", value: str = "name", out: str = "project") -> DataFrame:
    """``files`` with column ``out``: the ``value`` of the longest ``root`` that encloses ``path``, null if none.

    A path is joined by equality on its enclosing directories, so whole steps match and no nested
    loop is needed; of equal roots the smallest value counts.
    """
    distinct = files.select(path).distinct()
    steps = distinct.select(F.col(path).alias("_path"), F.explode(F.concat(F.array(F.col(path)), ancestors(F.col(path)))).alias("_root"))
    roots = projects.groupBy(F.col(root).alias("_root")).agg(F.min(value).alias("_value"))
    nearest = steps.join(roots, "_root").groupBy("_path").agg(F.max_by("_value", F.length("_root")).alias(out))
    return files.join(nearest, F.col(path) == F.col("_path"), "left").drop("_path")
