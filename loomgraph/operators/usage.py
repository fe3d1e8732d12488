"""Relational operators over symbols and their uses, whatever tables these come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usage_index(uses: DataFrame, keys: list[str], is_test: Column) -> DataFrame:
    """Uses in production and in tests of each symbol."""
    return uses.groupBy(*keys).agg(F.count_if(~is_test).alias("prod_uses"), F.count_if(is_test).alias("test_uses"))


def never_used(symbols: DataFrame, uses: DataFrame, keys: list[str]) -> DataFrame:
    """Symbols without a use."""
    return symbols.join(uses, keys, "left_anti")


def all_uses_within(uses: DataFrame, allowed: DataFrame, entity: str, where: list[str]) -> DataFrame:
    """Entities that are used, and only at places of ``allowed`` (entity and place): relational division."""
    offenders = uses.join(allowed, [entity, *where], "left_anti")
    return uses.select(entity).distinct().join(offenders, entity, "left_anti")


def dependency_matrix(uses: DataFrame, lazy: Column, symbol: str = "symbol") -> DataFrame:
    """(from_project, to_project, refs, lazy, symbols) of uses across projects; counts by symbol come first."""
    across = uses.where(F.col("from_project") != F.col("to_project"))
    by_symbol = across.groupBy("from_project", "to_project", symbol).agg(F.count("*").alias("refs"), F.bool_or(lazy).alias("lazy"))
    return by_symbol.groupBy("from_project", "to_project").agg(F.sum("refs").alias("refs"), F.bool_or("lazy").alias("lazy"), F.count("*").alias("symbols"))


def coupling(projects: DataFrame, deps: DataFrame, name: str = "name") -> DataFrame:
    """``projects`` with afferent and efferent coupling and instability, 0 for those without dependencies."""
    ca = deps.groupBy(F.col("to_project").alias(name)).agg(F.countDistinct("from_project").alias("afferent"))
    ce = deps.groupBy(F.col("from_project").alias(name)).agg(F.countDistinct("to_project").alias("efferent"))
    out = projects.join(ca, name, "left").join(ce, name, "left").fillna(0, ["afferent", "efferent"])
    both = F.col("afferent") + F.col("efferent")
    return out.withColumn("instability", F.when(both == 0, 0.0).otherwise(F.col("efferent") / both))


def single_consumers(uses: DataFrame, keys: list[str]) -> DataFrame:
    """Symbols used in exactly one project besides their ``home``, and never at home."""
    return (
        uses.groupBy(*keys, "home").agg(
            F.count_if(F.col("project") == F.col("home")).alias("internal"), F.countDistinct(F.when(F.col("project") != F.col("home"), F.col("project"))).alias("others"),
            F.max(F.when(F.col("project") != F.col("home"), F.col("project"))).alias("to_project"), F.count("project").alias("external"),
        ).where("internal = 0 and others = 1").drop("others")
    )


def boundary_violations(deps: DataFrame, projects: DataFrame, rules: DataFrame) -> DataFrame:
    """(from_project, to_project, source_tag, allowed, to_tags) of dependencies that a rule of the source's tag doesn't allow.

    ``projects`` is (name, tags), ``rules`` (source_tag, allowed). Tags are joined by equality; ``*``
    allows all. Of several rules for one tag each counts by itself.
    """
    tagged = deps.select("from_project", "to_project").distinct().join(projects.select(F.col("name").alias("from_project"), F.explode(F.array_distinct("tags")).alias("source_tag")), "from_project")
    ruled = tagged.join(rules, "source_tag").join(projects.select(F.col("name").alias("to_project"), F.col("tags").alias("to_tags")), "to_project")
    return ruled.where(~(F.array_contains("allowed", "*") | F.arrays_overlap("allowed", "to_tags"))).select("from_project", "to_project", "source_tag", "allowed", "to_tags")


def first_by_rank(candidates: DataFrame, keys: list[str], value: str, rank: str) -> DataFrame:
    """The value of the lowest rank for each key; ranks are distinct within a key."""
    return candidates.groupBy(*keys).agg(F.min_by(value, rank).alias(value))


def by_priority(declared: DataFrame, keys: list[str], value: str, priority: str) -> DataFrame:
    """The value of the highest priority for each key."""
    return declared.groupBy(*keys).agg(F.max_by(value, priority).alias(value))


#: Ways in which a symbol is used, in the order of reports.
WAYS = ("Import", "Template", "Jsx", "LazyLoad")


def uses_of(uses: DataFrame, declared: DataFrame, on: str, is_test: Column) -> DataFrame:
    """Those of ``uses`` (via, ``on``, ...) that lead to one of ``declared``, and whether tests make them; templates are no tests."""
    return uses.join(declared.select(on), on, "left_semi").withColumn("test", is_test & (F.col("via") != "Template"))


def rank_of_way(via: Column) -> Column:
    """The place of a way of use among ``WAYS``, from 1."""
    return F.array_position(F.array(*[F.lit(w) for w in WAYS]), via)


def new_findings(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Keys of ``current`` that ``baseline`` lacks, each once."""
    return current.select("key").subtract(baseline.select("key"))


#: Finding-key prefixes by policy category.
FAIL_PREFIXES = {"unused": ("unused:", "unused-import:", "not-rendered:", "orphan:"), "cycles": ("cycle:", "project-cycle:"), "boundaries": ("boundary:",)}


def fail_category(key: Column) -> Column:
    """The policy category of a finding key, ``other`` for those that only ``all`` covers."""
    out = F.lit("other")
    for name, prefixes in FAIL_PREFIXES.items():
        any_of = F.lit(False)
        for p in prefixes:
            any_of = any_of | F.startswith(key, F.lit(p))
        out = F.when(any_of, name).otherwise(out)
    return out
