"""Graph operators over edges (src, dst): neighbours, reachability, cycles.

Long ways are cut short by doubled pointers before anything is followed edge by edge. What takes rounds
then expands by several edges in each, so that a round's write and job are paid for once in ``STEPS``
edges of the longest path; only counts and checksums reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from loomgraph.scratch import discard, stored

#: Edges that a round follows.
STEPS = 4
#: The order of nodes is used where one edge in so many, at most, goes against it.
ORDERED = 8
#: So many edges a node make a graph dense.
DENSE = 8


def edge_set(edges: DataFrame) -> DataFrame:
    """Distinct edges without null ends."""
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def kept(edges: DataFrame) -> DataFrame:
    """``edge_set`` of ``edges``, stored; what was stored by this stays as it is."""
    if getattr(edges, "is_edge_set", False):
        return edges
    out = stored(edge_set(edges), "edges")
    out.is_edge_set = True
    return out


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, targets) with sorted targets."""
    return edge_set(edges).groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("targets"))


def _observed(df: DataFrame, label: str, counted: str = "*") -> tuple[DataFrame, int]:
    """``df`` stored, and its number of rows, or of those in which ``counted`` isn't null."""
    seen = Observation()
    return stored(df.observe(seen, F.count(counted).alias("n")), label), seen.get["n"]


def followed(parents: DataFrame, label: str = "followed") -> DataFrame:
    """(node, head, low, circling) of each node of ``parents`` (node, parent), which has one parent each.

    ``head`` is the last of its parents' parents. Pointers double each round, so rounds are the logarithm of the
    longest way. Where parents go in circles ``circling`` is set and ``low`` is the smallest node met, in a circle that nothing hangs
    on its smallest.
    """
    at, n = _observed(parents.select("node", F.col("parent").alias("head"), F.least("node", "parent").alias("low")), label)
    live, rounds = n, 0
    while live and 2**rounds <= 2 * n:
        ahead = at.select(F.col("node").alias("head"), F.col("head").alias("next"), F.col("low").alias("next_low"))
        moved = at.join(ahead, "head", "left").select("node", F.coalesce("next", "head").alias("head"), F.least("low", "next_low").alias("low"), F.when(F.col("next").isNotNull(), True).alias("circling"))
        last, (at, live) = at, _observed(moved, label, "circling")
        discard(last)
        rounds += 1
    if "circling" not in at.columns:
        at = at.withColumn("circling", F.lit(None).cast("boolean"))
    return at.select("node", "head", "low", F.coalesce("circling", F.lit(False)).alias("circling"))


def reachable(edges: DataFrame, seeds: DataFrame, include_seeds: bool = False, max_rounds: int = 10_000, trace: list | None = None) -> DataFrame:
    """(node) that can be reached from any of ``seeds`` (node) by one edge or more.

    A node that one edge alone leads to is reached if and only if that edge's source is, so such nodes first hang on the
    nearest that isn't one, found by doubled pointers, and their own edges are its; long paths and trees vanish in a
    logarithm of their length, and this goes on while it removes a fifth of the edges. Through the rest a frontier
    of new nodes is followed along ``STEPS`` edges each round. What was seen is kept in a few
    tables, which are merged before they become many. Seeds count when a path leads back to them, or
    with ``include_seeds``. ``trace`` gets the name of each round.
    """
    edges, n = _observed(edge_set(edges), "edges")
    seeds = stored(seeds.select("node").where("node is not null").distinct(), "seeds")
    hung_on = []
    while n:
        single = edges.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("parent")).where("n = 1").select(F.col("dst").alias("node"), "parent")
        hung, hanging = _observed(single.join(seeds, "node", "left_anti"), "hanging")
        if 5 * hanging < n:
            discard(hung)
            break
        ends = followed(hung)
        hung_on.append(ends.where("not circling").select("node", "head"))
        left = edges.join(hung.select(F.col("node").alias("dst")), "dst", "left_anti").join(ends.select(F.col("node").alias("src"), "head", "circling"), "src", "left")
        last, (edges, n) = edges, _observed(left.where("circling is null or not circling").select(F.coalesce("head", "src").alias("src"), "dst").distinct(), "edges")
        discard(last)
        discard(hung)
        if trace is not None:
            trace.append("hung")
    frontier = seeds
    seen = [frontier if include_seeds else stored(frontier.limit(0), "seen")]
    for _ in range(max_rounds if n else 0):
        step, found = frontier, None
        for _ in range(STEPS):
            step = step.join(edges, step["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
            found = step if found is None else found.unionByName(step)
        for table in seen:
            found = found.join(table, "node", "left_anti")
        if trace is not None:
            trace.append("frontier")
        frontier = stored(found.distinct(), "frontier")
        if frontier.isEmpty():
            break
        seen.append(frontier)
        if len(seen) > 6:
            merged = stored(_union(seen), "seen")
            for table in seen[1 if include_seeds else 0 : -1]:
                discard(table)
            seen = [merged]
    else:
        if n:
            raise RuntimeError("reachability did not settle")
    out = _union(seen)
    for ends in reversed(hung_on):
        start = out if include_seeds else out.unionByName(seeds)
        out = out.unionByName(ends.join(start.select(F.col("node").alias("head")), "head", "left_semi").select("node"))
    discard(edges)
    return out


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _spread(labels: DataFrame, along: DataFrame, label: str, max_rounds: int = 10_000) -> DataFrame:
    """``labels`` (node, label) with the smallest label that leads to each node along edges (src, dst)."""
    before = None
    for _ in range(max_rounds):
        new = labels
        for _ in range(STEPS):
            moved = new.join(along, new["node"] == along["src"]).select(F.col("dst").alias("node"), "label")
            new = new.unionByName(moved).groupBy("node").agg(F.min("label").alias("label"))
        seen = Observation()
        new = stored(new.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("node", "label").cast("decimal(38,0)")).alias("check")), label)
        now = (seen.get["n"], seen.get["check"])
        if before is not None:
            discard(labels)
        if now == before:
            return new
        labels, before = new, now
    raise RuntimeError(f"{label} did not settle")


def _hubs(rest: DataFrame) -> DataFrame:
    """(node, parent) of nodes that lead to a smaller node and back, the smallest such."""
    back = rest.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return rest.join(back, ["src", "dst"], "left_semi").where("dst < src").groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("parent"))


def _links(rest: DataFrame) -> DataFrame:
    """(node, before, after) of nodes with one edge in and one out."""
    into = rest.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("before")).where("n = 1")
    out = rest.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("m"), F.min("dst").alias("after")).where("m = 1")
    return into.join(out, "node").select("node", "before", "after")


def _highest_before(rows: DataFrame, value: Column) -> DataFrame:
    """``rows`` (node, part) with ``before``, the highest ``value`` of all before a row in the order of nodes; parts are ranges of nodes. One row a part meets in one task."""
    parts = rows.groupBy("part").agg(F.max(value).alias("most"))
    carried = parts.select("part", F.max("most").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = F.max(value).over(Window.partitionBy("part").orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(F.broadcast(carried), "part").withColumn("before", F.greatest(inside, "carried")).drop("carried")


def _within_segments(rest: DataFrame, back: Column) -> DataFrame:
    """The edges of ``rest`` that may lie on a cycle, as edges against the order of nodes, ``back``, say.

    A cycle crosses each place between its first and last node both ways, so edges against the order span all of it. Hence no cycle
    leaves a segment, a stretch of nodes that such edges span without a gap, and only edges within one segment may lie on cycles.
    """
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    ends = F.array(F.struct(low.alias("node"), F.when(back, high).otherwise(low).alias("reach")), F.struct(high.alias("node"), high.alias("reach")))
    nodes = rest.select(F.inline(ends)).groupBy("node").agg(F.max("reach").alias("reach"))
    ordered = stored(nodes.repartitionByRange("node").withColumn("part", F.spark_partition_id()), "scc-order")
    starts = F.when(F.col("before").isNull() | (F.col("node") > F.col("before")), F.col("node"))
    begun = stored(_highest_before(ordered, F.col("reach")).select("node", "part", starts.alias("start")), "scc-starts")
    segments = stored(_highest_before(begun, F.col("start")).select("node", F.coalesce("start", "before").alias("segment")), "scc-segments")
    several = segments.join(segments.groupBy("segment").agg(F.count("*").alias("n")).where("n > 1").select("segment"), "segment")
    of = lambda end: several.select(F.col("node").alias(end), F.col("segment").alias(f"{end}_segment"))
    out = stored(rest.join(of("src"), "src").join(of("dst"), "dst").where("src_segment = dst_segment").select("src", "dst"), "scc-rest")
    for table in (ordered, begun, segments):
        discard(table)
    return out


def _picked(rest: DataFrame, each: int = 2) -> DataFrame:
    """Of each node ``each`` edges out and in, picked by hashes."""
    picks = []
    for end, other in (("src", "dst"), ("dst", "src")):
        mixed = [F.xxhash64(F.lit(i), end) for i in range(each)]
        if dict(rest.dtypes)[other] == "bigint":  # what is nearest to a random number by exclusive or is a random choice, and numbers aggregate by hash
            held = rest.groupBy(end).agg(*[F.min(F.col(other).bitwiseXOR(m)).alias(f"p{i}") for i, m in enumerate(mixed)])
            chosen = [F.col(f"p{i}").bitwiseXOR(m) for i, m in enumerate(mixed)]
        else:
            held = rest.groupBy(end).agg(*[F.min(F.struct(F.xxhash64(m, F.col(other)).alias("h"), F.col(other).alias("n"))).alias(f"p{i}") for i, m in enumerate(mixed)])
            chosen = [F.col(f"p{i}.n") for i in range(each)]
        picks.append(held.select(end, F.explode(F.array(*chosen)).alias(other)).select("src", "dst"))
    return picks[0].unionByName(picks[1])


def _joined_up(rest: DataFrame, ends: DataFrame) -> DataFrame:
    """``rest`` between the heads of ``ends`` (node, head), nodes without one as they are, and without edges from a node to itself."""
    of = lambda end: ends.select(F.col("node").alias(end), F.col("head").alias(f"{end}_head"))
    moved = rest.join(of("src"), "src", "left").join(of("dst"), "dst", "left").select(F.coalesce("src_head", "src").alias("src"), F.coalesce("dst_head", "dst").alias("dst"))
    return moved.where("src <> dst").distinct()


def scc(edges: DataFrame, trace: list | None = None) -> DataFrame:
    """(node, component) of every node on a cycle, ``component`` the smallest node that it shares cycles with.

    These are the strongly connected components of more than one node or with an edge to itself. Where few edges go against the order of
    nodes, only what these span is looked at. Of a graph with more than ``DENSE`` edges a node, a few edges of each node come first: what shares
    cycles by these does by all and becomes one, which leaves little of it. Edges into dead ends and out
    of sources lie on no cycle and go first. Then, while they are a twentieth of the edges, nodes that lead to each
    other become one, and nodes with one edge in and one out give way to an edge past them, both by doubled pointers; such a node
    shares a cycle with the two that it joined if and only if these share one.

    The rest is coloured: nodes have random priorities, fresh in each round, and a node's two colours are the first
    node that leads to it and the first that it leads to. Where both are the same node, that is its component. Nodes of a
    component have both colours in common, so edges between nodes of other colours go, which splits the rest as
    quicksort does: rounds are about the logarithm of the number of components, and each is linear in the edges. ``trace`` gets the name of each round.
    """
    edges = kept(edges)
    loops = edges.where("src = dst").select(F.col("src").alias("node"))
    rest, found, steps, colourings = edges.where("src <> dst"), [], [], 0
    note = trace.append if trace is not None else lambda _: None
    n, down = rest.agg(F.count("*"), F.count_if(F.col("src") > F.col("dst"))).first()
    if n and ORDERED * min(down, n - down) <= n:
        note("segments")
        rest = _within_segments(rest, F.col("src") > F.col("dst") if 2 * down <= n else F.col("src") < F.col("dst"))
    while True:
        n, nodes = rest.agg(F.count("*"), F.greatest(F.approx_count_distinct("src"), F.approx_count_distinct("dst"))).first()
        if n <= DENSE * nodes:
            break
        note("picked")
        ends = scc(_picked(rest), trace).where("node <> component").select("node", F.col("component").alias("head"))
        steps.append(("merged", ends))
        before, (rest, n) = n, _observed(_joined_up(rest, ends), "scc-rest")
        if 2 * n > before:
            break
    layers = 1
    while True:
        for _ in range(layers):
            targets, sources = rest.select(F.col("dst").alias("src")).distinct(), rest.select(F.col("src").alias("dst")).distinct()
            rest = rest.join(targets, "src", "left_semi").join(sources, "dst", "left_semi").select("src", "dst")
        before, (rest, n) = n, _observed(rest, "scc-rest")
        if not n:
            break
        layers = 3 if 10 * n < 9 * before else 1
        hubs, pairs = _observed(_hubs(rest), "scc-hubs")
        if 20 * pairs >= n:
            note("merged")
            ends = followed(hubs).select("node", "head")
            steps.append(("merged", ends))
            rest = _joined_up(rest, ends)
            continue
        links, chained = _observed(_links(rest), "scc-links")
        if 20 * chained >= n:
            note("chained")
            up = followed(links.select("node", F.col("before").alias("parent")), "scc-up")
            down = followed(links.select("node", F.col("after").alias("parent")), "scc-down")
            found.append(up.where("circling").select("node", F.col("low").alias("label")))
            chains = stored(up.where("not circling").select("node", "head").join(down.select("node", F.col("head").alias("tail")), "node"), "scc-chains")
            steps.append(("chained", chains))
            apart = rest.join(links.select(F.col("node").alias("src")), "src", "left_anti").join(links.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
            rest = apart.unionByName(chains.select(F.col("head").alias("src"), F.col("tail").alias("dst")).where("src <> dst")).distinct()
            continue
        note("coloured")
        nodes = rest.select(F.col("src").alias("node")).unionByName(rest.select(F.col("dst").alias("node"))).distinct()
        # ids in a random order: numbers that are names and priorities in one, so that all that follows hashes and compares numbers
        ids = stored(nodes.orderBy(F.xxhash64(F.lit(colourings), "node"), "node").select("node", F.monotonically_increasing_id().alias("id")), "scc-ids")
        of = lambda end: ids.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id"))
        numbered = stored(rest.join(of("src"), "src").join(of("dst"), "dst").select("src", "dst", "src_id", "dst_id"), "scc-numbered")
        there, back = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1  # the two colours of a node spread side by side
        both = F.array(F.struct(there("src_id").alias("src"), there("dst_id").alias("dst")), F.struct(back("dst_id").alias("src"), back("src_id").alias("dst")))
        along = stored(numbered.select(F.inline(both)), "scc-along")
        starts = ids.select(F.explode(F.array(there("id"), back("id"))).alias("node"), F.col("id").alias("label"))
        spread = _spread(starts, along, "scc-colours")
        side = lambda s: F.min(F.when(F.col("node") % 2 == s, F.col("label")))
        colours = stored(spread.groupBy(F.shiftright("node", 1).alias("id")).agg(side(0).alias("from"), side(1).alias("to")), "scc-both")
        found.append(stored(colours.where("from = to").join(ids, "id").select("node", F.col("from").alias("id")).join(ids.withColumnRenamed("node", "label"), "id").select("node", "label"), "scc-found"))
        of = lambda end: colours.where("from <> to").select(F.col("id").alias(f"{end}_id"), F.col("from").alias(f"{end}_from"), F.col("to").alias(f"{end}_to"))
        rest = stored(numbered.join(of("src"), "src_id").join(of("dst"), "dst_id").where("src_from = dst_from and src_to = dst_to").select("src", "dst"), "scc-rest")
        for table in (ids, numbered, along, spread, colours):
            discard(table)
        colourings += 1
    known = _union(found) if found else edges.select(F.col("src").alias("node"), F.col("src").alias("label")).limit(0)
    for kind, ends in reversed(steps):
        known = stored(known.groupBy("node").agg(F.min("label").alias("label")), "scc-known")
        of = lambda end, k=known: k.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
        if kind == "merged":
            more = ends.join(of("head"), "head", "left").withColumn("label", F.coalesce("head_label", "head"))
        else:
            more = ends.join(of("head"), "head", "left").join(of("tail"), "tail", "left").withColumn("label", F.coalesce("head_label", "head")).where(F.col("label") == F.coalesce("tail_label", "tail"))
        known = known.unionByName(more.select("node", "label")).unionByName(more.select(F.col("head").alias("node"), "label"))
    parts = known.groupBy("node").agg(F.min("label").alias("label"))
    named = stored(parts.groupBy("label").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1").join(parts, "label").select("node", "component"), "scc-components")
    return named.unionByName(loops.join(named, "node", "left_anti").select("node", F.col("node").alias("component")))


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(src, dst) between components and nodes on no cycle, without edges inside one: the acyclic graph that ``scc`` leaves."""
    of = lambda end: components.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part"))
    joined = (edges if getattr(edges, "is_edge_set", False) else edge_set(edges)).join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    return joined.select(F.coalesce("src_part", "src").alias("src"), F.coalesce("dst_part", "dst").alias("dst")).where("src <> dst").distinct()


def cycle_groups(components: DataFrame) -> DataFrame:
    """(component, members, size): the sorted members of each component."""
    return components.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"), F.count("*").alias("size"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (node) that no edge leads to."""
    return nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
