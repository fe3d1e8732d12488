"""Exact links within groups of candidates of any size, without their pairs.

Banding gives groups of texts that may be alike. Verifying each member against the first leaves most
groups in one component; what is left, members of one group in several components, is settled here.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import components, stored
from loomgraph.scratch import discard

#: With so many of its members the others of a group are compared in a round.
FIRSTS = 32
#: The same where sketches tell which pairs are worth verifying.
SCREENED = 512
#: In each of these rounds so many members of a group's largest component, and as many others, meet all of it.
PIVOTS = (3, 4)
#: Larger groups are dealt out to several tasks.
DEALT = 8192
#: A token that ``compare`` may give every member: it comes last in every order.
LAST = -(2**63)


def _edges(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("a"), F.col("root").alias("b"))


def mixed(groups: DataFrame, found: DataFrame, label: str) -> DataFrame:
    """(g, id, root, low) of the groups with members of several components; ``low`` is a group's smallest id."""
    held = groups.join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = held.groupBy("g").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("id").alias("low")).where("x < y").select("g", "low")
    return stored(held.join(several, "g").select("g", "id", "root", "low"), f"{label}-mixed")


def _partnered(dealt: DataFrame) -> DataFrame:
    """Those of ``dealt`` (g, id, root, main, slack, lo, hi) that may have a partner in their group."""
    other = lambda f, c: f(F.when(~F.col("main"), F.col(c)))
    known = dealt.groupBy("g").agg(
        F.count("*").alias("n"), F.max("slack").alias("slack_any"), F.min("lo").alias("lo_any"), F.max("hi").alias("hi_any"),
        other(F.max, "slack").alias("slack_out"), other(F.min, "lo").alias("lo_out"), other(F.max, "hi").alias("hi_out"),
    ).where("n > 1 and slack_any >= 0")
    of = lambda c: F.when(F.col("main"), F.col(f"{c}_out")).otherwise(F.col(f"{c}_any"))
    fits = (F.col("slack") + of("slack") >= 0) & (of("lo") <= F.col("hi")) & (of("hi") >= F.col("lo"))
    return dealt.join(known, "g").where(fits).select(*dealt.columns)


Step = Callable[[DataFrame], DataFrame]


def settled(groups: DataFrame, found: DataFrame, texts: DataFrame, compare: Step, verified: Callable[[DataFrame, DataFrame], DataFrame], label: str, similarity: float, small: Step | None = None, small_rows: int = 0, screen: tuple[DataFrame, Callable[[str], Column]] | None = None) -> DataFrame:
    """``found`` (id, root) with every link between members of one of ``groups`` (g, id) added; ``texts`` is (id, text).

    Groups with members of several components form families, each with a pivot p from its largest
    component. A member x is then what it differs from the pivot in, which is short: D(x), the xor of
    two sets, made by ``compare`` from (family, id, root, pivot, text, pivot_text) as (family, id, root,
    pivot, near, room, apart), ``near`` telling whether x and p are alike, ``apart`` being the array D(x). Rooms
    say how far alike texts may differ: D(x) xor D(y), which is also the xor of x and y, must have at most
    room(x) + room(y) elements for all alike x and y, and room(y) be at most room(x) / ``similarity``. With
    both D in one order, rarest first, no more elements than that come before the first shared one.
    Texts that share an element meet in a group of the next round if so; what one member alone has comes
    first and leads nowhere. Alike texts that share none must both be alike to the pivot, or share ``LAST``.
    Nor can the sizes of their D differ by more than both rooms. Members without a partner in the
    group by these bounds leave it; what is in the largest component needs one outside of it.

    Of each group made so the ``FIRSTS`` members with most room left are verified against all, and what is
    still in several components goes on without them, so rounds end. No link is missed and no group is expanded into its pairs. With ``small``,
    families of at most ``small_rows`` members are linked by it instead, from (family, id, root, text). ``screen`` is a
    table (id, ...) of sketches and a condition that rows hold whose text may be alike to the one whose sketch's columns have the
    prefix given; pairs that don't hold it aren't verified, and ``SCREENED`` members instead of ``FIRSTS`` meet all in a round.
    """
    first_count = FIRSTS if screen is None else SCREENED
    while True:
        held = mixed(groups, found, label)
        if held.isEmpty():
            discard(held)
            return found
        families = components(held.select(F.col("id").alias("a"), F.col("low").alias("b")), f"{label}-families")
        members = stored(held.select("id", "root").distinct().join(families.select("id", F.col("root").alias("family")), "id"), f"{label}-members")
        by_root = members.groupBy("family", "root").agg(F.count("*").alias("n"), F.min("id").alias("pivot"))
        pivots = by_root.groupBy("family").agg(F.max_by("pivot", F.struct("n", "pivot")).alias("pivot"), F.max_by("root", F.struct("n", "pivot")).alias("main"), F.sum("n").alias("n"))
        pivots = stored(pivots, f"{label}-pivots")
        links = None
        if small is not None:
            few = members.join(pivots.where(F.col("n") <= small_rows).select("family"), "family").join(texts, "id")
            links = small(few.select("family", "id", "root", "text"))
        pivot_texts = pivots.where(F.col("n") > small_rows).select("family", "pivot").join(texts.toDF("pivot", "pivot_text"), "pivot")
        beside = members.join(texts, "id").join(pivot_texts, "family").where("id <> pivot")
        beside = stored(compare(beside.select("family", "id", "root", "pivot", "text", "pivot_text")), f"{label}-apart")
        near = beside.where("near").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
        links = near if links is None else links.unionByName(near)

        each = beside.select("family", "id", "root", "room", F.size("apart").alias("all"), F.explode("apart").alias("token"))
        common = each.groupBy("family", "token").agg(F.count("*").alias("m")).where("m > 1")
        shared = each.join(common, ["family", "token"]).withColumn("m", F.when(F.col("token") == LAST, F.lit(2**62)).otherwise(F.col("m")))
        ordered = shared.groupBy("family", "id", "root", "room", "all").agg(F.sort_array(F.collect_list(F.struct("m", "token"))).alias("shared"))
        alone = F.col("all") - F.size("shared")  # what one member alone has comes first
        prefix = F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.floor(F.col("room") * (1 + 1 / similarity) + 1e-9).cast("int") + 1 - alone))
        dealt = ordered.select("family", "id", "root", "all", "room", alone.alias("alone"), F.posexplode(prefix).alias("at", "e")).join(pivots.select("family", "main"), "family")
        dealt = dealt.select(
            F.xxhash64("family", "e.token").alias("g"), "id", "root", (F.col("root") == F.col("main")).alias("main"), (F.col("room") + 1e-9 - F.col("alone") - F.col("at")).alias("slack"),
            (F.col("all") - F.col("room") - 1e-9).alias("lo"), (F.col("all") + F.col("room")).alias("hi"),
        )
        dealt = stored(_partnered(dealt), f"{label}-prefixes")
        dealt_on = _partnered(dealt)
        several = dealt_on.groupBy("g").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("g")
        met = stored(dealt_on.join(several, "g"), f"{label}-met")
        firsts = met.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("main", F.col("slack").desc(), "id"))).where(F.col("rank") <= first_count)
        firsts = stored(firsts.select("g", *[F.col(c).alias(f"first_{c}") for c in ("id", "root", "slack", "lo", "hi")]), f"{label}-firsts")
        ours, theirs, fits = met, firsts, F.lit(True)
        if screen is not None:
            sketch, fits = screen[0], screen[1]("first_")
            ours, theirs = met.join(sketch, "id"), firsts.join(sketch.select(*[F.col(c).alias(f"first_{c}") for c in sketch.columns]), "first_id")
        pairs = ours.join(theirs, "g").where("root <> first_root and slack + first_slack >= 0 and lo <= first_hi and first_lo <= hi").where(fits)
        pairs = pairs.select(F.greatest("id", "first_id").alias("a"), F.least("id", "first_id").alias("b"))
        links = stored(links.unionByName(verified(pairs.distinct(), texts)), f"{label}-near")
        last, groups = groups, stored(met.select("g", "id").join(firsts.select("g", F.col("first_id").alias("id")), ["g", "id"], "left_anti"), f"{label}-groups")
        if not links.isEmpty():
            found = components(_edges(found).unionByName(links), f"{label}-classes")
        for table in (held, members, pivots, beside, dealt, met, firsts, links):
            discard(table)
        if hasattr(last, "stored_at") and f"{label}-groups" in last.stored_at:
            discard(last)


def in_blocks(groups: DataFrame, found: DataFrame, texts: DataFrame, small: Step, small_rows: int, met: Step, rows: int, chars: int, label: str) -> DataFrame:
    """``found`` (id, root) with every link between members of one of ``groups`` (g, id) added, in one round; no id is in two groups.

    Groups with members of several components are settled: those of at most ``small_rows`` members by ``small`` from (family, id,
    root, text). Members of larger ones are dealt out to blocks of about ``rows`` members, or ``chars`` characters if that is fewer;
    the largest component has blocks of its own. Each two blocks meet, except for two of the largest component: ``met`` makes links (a, b)
    from (g, id, root, block, others, text), ``others`` being the blocks that a member's block meets. So a task holds two blocks whatever the
    size of a group, and a member is sent once for each block that its own one meets.
    """
    held = mixed(groups, found, label)
    if held.isEmpty():
        discard(held)
        return found
    by_root = held.join(texts.select("id", F.length("text").alias("chars")), "id").groupBy("g", "root").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    blocks = lambda n, size: F.ceil(F.greatest(n / rows, size / chars)).cast("int")
    sizes = by_root.groupBy("g").agg(F.max(F.struct("n", "root", "chars")).alias("main"), F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    sizes = sizes.select("g", "n", F.col("main.root").alias("main"), blocks(F.col("n") - F.col("main.n"), F.col("chars") - F.col("main.chars")).alias("outs"), blocks(F.col("main.n"), F.col("main.chars")).alias("mains"))
    sizes = stored(sizes, f"{label}-sizes")
    few = held.join(sizes.where(F.col("n") <= small_rows).select("g"), "g").join(texts, "id").select(F.col("g").alias("family"), "id", "root", "text")
    many = held.join(sizes.where(F.col("n") > small_rows).drop("n"), "g")
    main, at = F.col("root") == F.col("main"), lambda n: F.pmod(F.hash("id"), F.col(n))
    many = many.withColumn("block", F.when(main, F.col("outs") + at("mains")).otherwise(at("outs")))
    many = many.withColumn("others", F.sequence(F.lit(0), F.col("outs") - 1 + F.when(main, F.lit(0)).otherwise(F.col("mains"))))
    links = stored(small(few).unionByName(met(many.join(texts, "id").select("g", "id", "root", "block", "others", "text"))), f"{label}-near")
    if not links.isEmpty():
        found = components(_edges(found).unionByName(links), f"{label}-classes")
    for table in (held, sizes, links):
        discard(table)
    return found


def places_apart(other: str, words: int) -> Column:
    """How many bits of p0, p1, ... (``words`` numbers) differ from those of the columns with ``other`` before their names."""
    return reduce(add, [F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"{other}p{i}"))) for i in range(words)])


def merged(found: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """``found`` (id, root) with ``links`` (a, b) added: only the roots that links lead to are contracted anew."""
    known = lambda c: found.toDF(c, f"{c}_root")
    roots = links.join(known("a"), "a", "left").join(known("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    moved = components(roots, f"{label}-roots")
    kept = found.join(moved.toDF("root", "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    return stored(kept.unionByName(moved.join(found, "id", "left_anti")), f"{label}-classes")


def across(groups: DataFrame, found: DataFrame, sketch: DataFrame, may: Callable[[str], Column], label: str, pivots: int | None = None) -> DataFrame:
    """Pairs (a, b) of members of different components of one of ``groups`` (g, id) for which ``may`` holds, as for ``settled``.

    All members outside of a group's largest component meet all of its members. With ``pivots``, all
    members meet only so many of the largest component and so many others, picked at random. Sketches are compared
    as rows meet, and no other pair is written. Of large groups the members are dealt out, and those that they meet repeated.
    """
    held = groups.join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = held.groupBy("g", "root").agg(F.count("*").alias("m"))
    mains = sizes.groupBy("g").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.count("*").alias("roots"), F.sum("m").alias("n")).where("roots > 1")
    deals = F.ceil(F.col("n") / DEALT).cast("int").alias("deals")
    held = stored(held.join(mains, "g").select("g", "id", "root", (F.col("root") == F.col("main")).alias("main"), deals), f"{label}-held")
    if pivots is None:
        firsts, once = held.where(~F.col("main")), F.col("main") | (F.col("id") < F.col("first_id"))
    else:
        rank = F.row_number().over(Window.partitionBy("g", "main").orderBy(F.xxhash64("id", F.lit(pivots)), "id"))
        firsts, once = held.withColumn("rank", rank).where(F.col("rank") <= pivots).drop("rank"), F.lit(True)
    copies = firsts.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).join(sketch, "id")
    copies = copies.select("g", "deal", *[F.col(c).alias(f"first_{c}") for c in ("id", "root", *sketch.columns[1:])])
    dealt = held.withColumn("deal", F.pmod(F.hash("id"), F.col("deals"))).join(sketch, "id")
    pairs = dealt.join(copies, ["g", "deal"]).where(F.col("root") != F.col("first_root")).where(once).where(may("first_"))
    pairs = stored(pairs.select(F.greatest("id", "first_id").alias("a"), F.least("id", "first_id").alias("b")).distinct(), f"{label}-pairs")
    discard(held)
    return pairs


def linked(groups: DataFrame, found: DataFrame, sketch: DataFrame, may: Callable[[str], Column], verified: Step, label: str) -> DataFrame:
    """``found`` (id, root) with every link between members of one of ``groups`` (g, id) added.

    ``verified`` keeps the alike ones of pairs (a, b), for all of which ``may`` holds, as for ``settled``. In rounds members meet ``PIVOTS`` of their
    group, until that links few: whatever is like many is then one, by a link for each member at most and not by one for
    each pair. The last round compares all that is still in several components, and as few of these are alike, it writes little.
    """
    for pivots in (*PIVOTS, None):
        pairs = across(groups, found, sketch, may, label, pivots)
        links = stored(verified(pairs), f"{label}-near")
        if not links.isEmpty():
            found = merged(found, links, label)
        discard(pairs)
        discard(links)
    return found
