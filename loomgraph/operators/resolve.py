"""Module resolution as ranked candidates joined with the files that exist, and barrels followed to declarations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.paths import ancestors, dirname, in_ignored_dir, normalize_path, package_of, subpath_of
from loomgraph.operators.links import rewritten
from loomgraph.scratch import stored

#: Endings tried in turn, those tried for what a file exports from another, and the script
#: endings that a compiled one stands for.
ENDINGS = (".ts", ".tsx", ".d.ts", "/index.ts", "/index.tsx", "/index.d.ts")
BARREL_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".d.ts", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.d.ts")
COMPILED = (("js", "ts"), ("js", "tsx"), ("js", "d.ts"), ("jsx", "tsx"), ("mjs", "mts"), ("cjs", "cts"))
#: What a candidate is by its source, in the order of trial.
DIRECT, EXACT, WILDCARD, INSTALLED, NAMED = range(5)


def file_candidates(base: Column, barrel: Column | None = None) -> Column:
    """Array of (path, step): the files that a base path may mean, in the order they are tried; ``barrel`` tells where plain scripts count."""
    tried = [F.struct(base.alias("path"), F.lit(0).alias("step"))]
    tried += [F.when(F.endswith(base, F.lit(f".{js}")), F.struct(F.regexp_replace(base, rf"\.{js}$", f".{ts}").alias("path"), F.lit(1 + i).alias("step"))) for i, (js, ts) in enumerate(COMPILED)]
    ended = lambda endings, when: [F.when(when, F.struct(F.concat(base, F.lit(e)).alias("path"), F.lit(10 + i).alias("step"))) for i, e in enumerate(endings)]
    if barrel is None:
        tried += ended(ENDINGS, F.lit(True))
    else:
        tried += ended(ENDINGS, ~barrel) + ended(BARREL_ENDINGS, barrel)
    return F.array_compact(F.array(*tried))


def import_type(source: Column) -> Column:
    """How a specifier is resolved, as far as it tells by itself."""
    return F.when(source.rlike(r"^\.\.?/"), "Relative").when(source.startswith("/"), "Absolute").otherwise("Bare")


def claimed(specifiers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct ``specifiers`` (project, source) with the aliases that may mean them: (.., alias, target, ord, base_url, before, after).

    ``before`` and ``after`` are what stands around an alias' first star, ``after`` null without one. A specifier meets an
    alias by equality on (project, before): of its prefixes those are made that have a length that some alias of the
    project has, so the rows joined follow the lengths of specifiers, whatever the number of aliases.
    """
    keyed = aliases.withColumn("before", F.regexp_extract("alias", r"^([^*]*)", 1)).withColumn("after", F.when(F.col("alias").contains("*"), F.regexp_extract("alias", r"^[^*]*\*(.*)$", 1)))
    lengths = keyed.where("after is not null").groupBy("project").agg(F.collect_set(F.char_length("before")).alias("lengths"))
    asked = specifiers.select("project", "source").distinct()
    prefixes = asked.join(lengths, "project").select("project", "source", F.explode("lengths").alias("n")).where(F.col("n") <= F.char_length("source"))
    wild = prefixes.select("project", "source", F.substring(F.col("source"), F.lit(1), F.col("n")).alias("before")).join(keyed.where("after is not null"), ["project", "before"])
    exact = asked.withColumn("before", F.col("source")).join(keyed.where("after is null"), ["project", "before"])
    columns = ["project", "source", "alias", "target", "ord", "base_url", "before", "after"]
    return exact.select(*columns).unionByName(wild.select(*columns))


def _joined(*parts: Column) -> Column:
    return normalize_path(F.concat_ws("/", *[F.nullif(p, F.lit("")) for p in parts]))


def resolve(
    wanted: DataFrame, files: DataFrame, aliases: DataFrame, packages: DataFrame, installed: DataFrame | None = None, links: DataFrame | None = None, exists: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(path, source, barrel, resolved, import_type, scope) of distinct ``wanted`` (path, source, project).

    ``wanted`` may tell in ``barrel`` what a file exports from another. ``files`` is (path), ``aliases``
    (project, alias, target, ord, base_url), ``packages`` (package, dir, entry) of workspace packages by the name in their
    manifest, ``installed`` (folder, real, bases) package folders below some node_modules, where they really are and
    what their manifests name as entries. ``links`` (link, target) are followed by candidates, and ``exists`` tells of paths that ``files`` doesn't
    list (path) which are files and folders (path, kind).

    Candidates carry their rank: exact aliases first, then the longest wildcard, then the nearest node_modules, then
    packages by name; the first that exists counts. An installed package without an entry is its folder. What doesn't depend on the importing file is searched once for
    all. ``resolved`` is null where nothing exists; ``scope`` then says whether the workspace should have had it.
    """
    reexported = F.col("barrel") if "barrel" in wanted.columns else F.lit(False)
    asked = stored(wanted.select("path", "source", "project", reexported.alias("barrel")).distinct().withColumn("type", import_type(F.col("source"))).withColumn("dir", dirname(F.col("path"))), "specifiers")
    rank = lambda a, b=F.lit(0), c=F.lit(0): F.struct(F.lit(a).alias("a"), b.cast("int").alias("b"), c.cast("int").alias("c"))
    row = lambda df, key, kind, ranked, base, barrel=F.lit(False): df.select(key.alias("key"), F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), ranked.alias("rank"), base.alias("base"), barrel.alias("barrel"))
    # keys: what a search depends on besides the specifier
    own, by_project, by_dir = F.struct("source", "dir", "barrel"), F.struct("source", "project"), F.struct("source", "dir")
    key = lambda kind, s: F.to_json(F.struct(F.lit(kind).alias("by"), s.alias("of")))

    direct = asked.where("type <> 'Bare'").select("dir", "source", "barrel", "type").distinct()
    place = F.when(F.col("type") == "Relative", _joined(F.col("dir"), F.col("source"))).otherwise(normalize_path(F.regexp_replace("source", "^/+", "")))
    bases = row(direct, key("own", own), F.col("type"), rank(DIRECT), place, F.col("barrel") & (F.col("type") == "Relative"))

    bare = asked.where("type = 'Bare'")
    claims = stored(claimed(bare, aliases), "claims")
    exact = claims.where("after is null")
    bases = bases.unionByName(row(exact, key("project", by_project), "Package", rank(EXACT, F.lit(0), F.col("ord")), _joined(F.col("base_url"), F.col("target"))))
    trimmed = F.regexp_replace("alias", r"\*+$", "")
    wild = claims.where(F.col("after").isNotNull() & F.startswith(F.col("source"), trimmed))
    rest = F.substring("source", F.char_length(trimmed) + 1, F.char_length("source"))
    bases = bases.unionByName(row(wild, key("project", by_project), "Package", rank(WILDCARD, -F.length("alias"), F.col("ord")), _joined(F.col("base_url"), F.replace(F.col("target"), F.lit("*"), rest))))
    named = bare.select("project", "source").distinct().withColumn("package", package_of(F.col("source"))).join(packages, "package").withColumn("sub", subpath_of(F.col("source")))
    folder = F.col("dir") if "dir" in packages.columns else F.lit("")
    inner = F.when(F.col("sub").isNull(), F.col("entry")).otherwise(_joined(folder, F.col("sub")))
    bases = bases.unionByName(row(named, key("project", by_project), "NodeModule", rank(NAMED), inner)).where("base is not null")

    known = files.select("path")
    whole = None
    if installed is not None:
        steps = F.concat(F.filter(F.array("dir"), lambda d: d != ""), ancestors(F.col("dir")), F.array(F.lit("")))
        up = bare.select("source", "dir").distinct().select("source", "dir", package_of(F.col("source")).alias("package"), subpath_of(F.col("source")).alias("sub"), F.posexplode(steps).alias("up", "at"))
        found = stored(up.withColumn("folder", F.concat_ws("/", F.nullif("at", F.lit("")), F.lit("node_modules"), "package")).join(installed, "folder"), "installed-found")
        entries = found.where("sub is null").select("*", F.posexplode("bases").alias("n", "base"))
        bases = bases.unionByName(row(entries, key("dir", by_dir), "NodeModule", rank(INSTALLED, F.col("up"), F.col("n")), F.col("base")))
        bases = bases.unionByName(row(found.where("sub is not null"), key("dir", by_dir), "NodeModule", rank(INSTALLED, F.col("up")), _joined(F.col("real"), F.col("sub"))))
        last = F.when(F.col("sub").isNull(), F.col("real")).otherwise(_joined(F.col("folder"), F.col("sub")))
        whole = row(found, key("dir", by_dir), "NodeModule", rank(INSTALLED, F.col("up"), F.lit(1000)), last).drop("barrel")

    if links is not None:
        bases = stored(bases, "bases")
        bases = bases.join(rewritten(bases.select(F.col("base").alias("path")), links).toDF("base", "real"), "base").where("real is not null").withColumn("base", F.col("real")).drop("real")
    tried = bases.select("key", "type", "rank", F.inline(file_candidates(F.col("base"), F.col("barrel"))))
    ends = None
    if exists is not None:
        tried = stored(tried, "candidates")
        beyond = tried.where(in_ignored_dir(F.col("path")) | F.col("path").rlike(r"^(\.\./|/)")).select("path")
        more = stored(exists(beyond if whole is None else beyond.unionByName(whole.select(F.col("base").alias("path")))).select("path", "kind"), "candidates-probed")
        known = known.unionByName(more.where("kind = 'file'").select("path")).distinct()
        if whole is not None:
            ends = whole.join(more.withColumnRenamed("path", "base"), "base").select("key", "type", "rank", F.lit(0).alias("step"), F.col("base").alias("path"))
    found = tried.join(known, "path").select("key", "type", "rank", "step", "path")
    if ends is not None:
        found = found.unionByName(ends)
    best = found.groupBy("key").agg(F.min(F.struct("rank", "step", "path", "type")).alias("hit"))

    inside = claims.where(F.col("after").isNull() | (F.endswith(F.col("source"), F.col("after")) & (F.char_length("source") >= F.char_length("before") + F.char_length("after"))))
    inside = inside.select("project", "source").distinct().withColumn("inside", F.lit(True))
    keys = F.when(F.col("type") == "Bare", F.array(key("project", by_project), key("dir", by_dir))).otherwise(F.array(key("own", own)))
    hits = asked.select("path", "source", "barrel", F.explode(keys).alias("key")).join(best, "key").groupBy("path", "source", "barrel").agg(F.min("hit").alias("hit"))
    out = asked.join(hits, ["path", "source", "barrel"], "left").join(inside, ["project", "source"], "left")
    scope = F.when((F.col("type") != "Bare") | F.coalesce("inside", F.lit(False)), "Internal").otherwise("External")
    return out.select("path", "source", "barrel", F.col("hit.path").alias("resolved"), F.coalesce("hit.type", "type").alias("import_type"), scope.alias("scope"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def export_steps(wanted: DataFrame, declared: DataFrame, forwarded: DataFrame, stars: DataFrame) -> DataFrame:
    """(file, name, ord, to_file, to_name): where the search for an export goes on, from all that ``wanted`` (file, name) leads to.

    What exports a name by way of another file is asked once, whoever asks; a named re-export (ord 0) goes before stars, which follow in
    their order. Files that declare the name, and names that no file forwards, have no steps.
    """
    front = stored(wanted.select("file", "name").distinct(), "exports-asked")
    seen, steps = [front], []
    while not front.isEmpty():
        rest = front.join(declared, ["file", "name"], "left_anti")
        by_name = rest.join(forwarded, ["file", "name"]).select("file", "name", F.lit(0).alias("ord"), F.col("source").alias("to_file"), F.col("original").alias("to_name"))
        by_star = rest.join(stars, "file").select("file", "name", (F.col("ord") + 1).cast("int").alias("ord"), F.col("source").alias("to_file"), F.col("name").alias("to_name"))
        steps.append(stored(by_name.unionByName(by_star), "exports-steps"))
        fresh = steps[-1].select(F.col("to_file").alias("file"), F.col("to_name").alias("name")).distinct()
        for table in seen:
            fresh = fresh.join(table, ["file", "name"], "left_anti")
        front = stored(fresh, "exports-asked")
        seen.append(front)
    return _union(steps) if steps else front.select("file", "name", F.lit(0).alias("ord"), F.col("file").alias("to_file"), F.col("name").alias("to_name"))


def _ring_searches(asked: DataFrame, steps: DataFrame, known: DataFrame) -> DataFrame:
    """(file, name, target) of ``asked`` (file, name), which lie on rings of re-exports or lead into some: one search each.

    A search goes on at ``steps`` until it meets what is ``known`` (file, name, target). The order of a depth-first search is kept as an array
    of ordinals by which the first hit counts; a file is entered again only by an earlier path, so searches end.
    """
    front = stored(asked.select(F.struct("file", "name").alias("q"), "file", "name", F.array().cast("array<int>").alias("prio")), "ring-front")
    seen, hits = front.select("q", "file", F.col("prio").alias("best")), []
    while not front.isEmpty():
        met = stored(front.join(known.withColumn("met", F.lit(True)), ["file", "name"], "left"), "ring-met")
        hits.append(met.where("target is not null").select("q", "target", "prio"))
        ahead = met.where("met is null").join(steps, ["file", "name"]).select("q", F.col("to_file").alias("file"), F.struct(F.concat("prio", F.array("ord")).alias("prio"), F.col("to_name").alias("name")).alias("x"))
        first = ahead.groupBy("q", "file").agg(F.min("x").alias("x")).select("q", "file", "x.name", "x.prio")
        front = stored(first.join(seen, ["q", "file"], "left").where("best is null or prio < best").select("q", "file", "name", "prio"), "ring-front")
        seen = stored(seen.unionByName(front.select("q", "file", F.col("prio").alias("best"))).groupBy("q", "file").agg(F.min("best").alias("best")), "ring-seen")
    found = _union(hits).groupBy("q").agg(F.min_by("target", "prio").alias("target")) if hits else None
    return asked.select("file", "name", F.lit(None).cast("string").alias("target")) if found is None else found.select("q.file", "q.name", "target")


def follow_barrels(wanted: DataFrame, declared: DataFrame, forwarded: DataFrame, stars: DataFrame) -> DataFrame:
    """(file, name, target): the file that declares what ``file`` exports as ``name``, ``file`` itself where none is found.

    ``declared`` is (file, name), ``forwarded`` (file, name, original, source), ``stars`` (file, ord,
    source). All searches share one table of exports, filled from the declarations up: an export is known once its first step that leads to a
    declaration is, and all before are known to lead nowhere. Each round takes what the last one made known, so the cost follows the exports asked for and the
    rounds the depth of barrels. A file that lacks one name is asked for another all the same. What is never known that way hangs on a ring and is searched by itself, as far as the ring goes.
    """
    declared = stored(declared.select("file", "name").distinct(), "exports-declared")
    asked = stored(wanted.select("file", "name").distinct(), "exports-wanted")
    steps = stored(export_steps(asked, declared, forwarded, stars), "exports-steps")
    states = stored(asked.unionByName(steps.select(F.col("to_file").alias("file"), F.col("to_name").alias("name"))).distinct(), "exports-states")
    at_home = states.join(declared, ["file", "name"], "left_semi").select("file", "name", F.col("file").alias("target"))
    nowhere = states.join(steps, ["file", "name"], "left_anti").join(declared, ["file", "name"], "left_anti").select("file", "name", F.lit(None).cast("string").alias("target"))
    fresh = stored(at_home.unionByName(nowhere), "exports-known")
    known, open_steps = [fresh], steps.withColumn("done", F.lit(False)).withColumn("target", F.lit(None).cast("string"))
    while True:
        told = fresh.select(F.col("file").alias("to_file"), F.col("name").alias("to_name"), F.col("target").alias("new"), F.lit(True).alias("now"))
        open_steps = stored(open_steps.join(told, ["to_file", "to_name"], "left").select("file", "name", "ord", "to_file", "to_name", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"), F.coalesce("target", "new").alias("target")), "exports-open")
        by_state = open_steps.groupBy("file", "name").agg(F.min(F.when(~F.col("done"), F.col("ord"))).alias("waits"), F.min(F.when(F.col("target").isNotNull(), F.struct("ord", "target"))).alias("hit"))
        settled = by_state.where("waits is null or hit.ord < waits").select("file", "name", "hit.target")
        fresh = stored(settled, "exports-known")
        if fresh.isEmpty():
            break
        known.append(fresh)
        open_steps = open_steps.join(fresh.select("file", "name"), ["file", "name"], "left_anti")
    found = _union(known)
    rest = stored(asked.join(found, ["file", "name"], "left_anti"), "exports-rings")
    if not rest.isEmpty():
        found = found.unionByName(_ring_searches(rest, steps, found))
    return asked.join(found, ["file", "name"], "left").withColumn("target", F.coalesce("target", "file"))
