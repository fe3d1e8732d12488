"""A workspace folder as tables: files, projects, path aliases, packages, and the facts of its scripts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.functions.text import json_object, strip_jsonc, version_major
from loomgraph.operators.links import rewritten
from loomgraph.operators.prefix_join import project_of
from loomgraph.operators.resolve import file_candidates
from loomgraph.scratch import stored
from loomgraph.sources import scripts
from loomgraph.sources.store import FactStore
from loomgraph.sources.tree import FILE, FOLDER, Tree, known_links, open_tree

_PROJECT = "name string, sourceRoot string, prefix string, tags array<string>, projectType string"
_TSCONFIG = "extends string, compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>"
_RULES = "boundaries array<struct<sourceTag: string, allowedTags: array<string>>>"
TS_ONLY = ("ts", "tsx")
ALL_SCRIPTS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts")
#: Folders whose files a file router enters, the router's package and the framework's.
ENTRY_DIRS = ("src/app", "app")
ROUTER, FRAMEWORK = "expo-router", "@angular/core"
#: The rules file if none is named.
RULES_FILES = ("boundaries.json",)


@dataclass(frozen=True)
class Workspace:
    """Tables of one workspace; paths are relative to its root."""

    files: DataFrame  # path, content: scripts and templates, with their nearest project
    tree: Tree  # what the folder holds, and how to look at what isn't listed
    all_paths: DataFrame  # path of every file outside of ignored folders
    projects: DataFrame  # name, root, tags, project_type, entry_dirs
    aliases: DataFrame  # project, alias, target, ord, base_url
    packages: DataFrame  # package, dir, entry
    rules: DataFrame  # source_tag, allowed
    default_standalone: bool
    skipped: DataFrame  # path of configuration files that can't be parsed


def read_workspace(spark: SparkSession, root: str, only: list[str] | None = None, extensions: tuple[str, ...] = ALL_SCRIPTS, rules_file: str | None = None, exclude_node_modules: bool = True) -> Workspace:
    """Discover projects and read what their analyses need. ``only`` restricts projects, and what counts as in the workspace.

    Folders of installed and built files are not opened but for single paths that an import or a configuration names;
    with ``exclude_node_modules`` off, what lies in them below a project's root is the project's too.
    """
    tree = open_tree(spark, root, all_folders=not exclude_node_modules)
    everything = tree.entries.where(F.col("kind") == FILE).select("path")
    outside = ~paths.in_ignored_dir(F.col("path"))
    config = stored(tree.contents(everything.where(F.col("path").endswith(".json") & outside)), "configuration-texts")
    parsed = config.where(paths.basename(F.col("path")) == "project.json").select(paths.dirname(F.col("path")).alias("root"), json_object(F.col("content"), _PROJECT).alias("c")).where("c is not null")
    dir_name = F.nullif(paths.basename(F.col("root")), F.lit(""))
    routed = config.where((paths.basename(F.col("path")) == "package.json") & F.col("content").contains(f'"{ROUTER}"')).select(paths.dirname(F.col("path")).alias("root"), F.lit(True).alias("routed"))
    entry_dirs = F.when(F.col("routed"), F.transform(F.array(*map(F.lit, ENTRY_DIRS)), lambda d: F.concat_ws("/", F.nullif("root", F.lit("")), d))).otherwise(F.array().cast("array<string>"))
    projects = parsed.join(routed, "root", "left").select(
        F.coalesce("c.name", dir_name, F.lit("unknown")).alias("name"), "root", F.coalesce("c.tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("c.projectType", F.lit("")).alias("project_type"), entry_dirs.alias("entry_dirs"),
    )
    if only:
        projects = projects.where(F.col("name").isin(*only))
    projects = stored(projects, "projects")
    wanted = everything.where(F.lower(paths.extension(F.col("path"))).isin(*extensions, "html"))
    wanted = project_of(wanted if not exclude_node_modules else wanted.where(outside), projects).where("project is not null")
    files = stored(tree.contents(wanted).join(wanted, "path"), "files")
    named = F.col("path").rlike(r"(^|/)(project|package|tsconfig[^/]*)\.json$")
    rules, broken = _rules(config, rules_file)
    skipped = config.where(named & json_object(F.col("content"), "x string").isNull()).select("path").unionByName(broken)
    aliases = stored(_aliases(config, tree, projects), "aliases")
    return Workspace(files, tree, everything, projects, aliases, stored(_packages(config, everything), "packages"), rules, _standalone(config), skipped)


def _aliases(config: DataFrame, tree: Tree, projects: DataFrame) -> DataFrame:
    """Path aliases of each project: of the first configuration that it has and that can be parsed, merged with those that it extends, the child winning.

    A chain of ``extends`` ends where it has no more or comes back to itself; one that isn't relative
    is looked for in the packages installed above.
    """
    read = lambda df: df.select("path", json_object(F.col("content"), _TSCONFIG).alias("c")).where("c is not null")
    own = stored(read(config), "configurations")
    picks = projects.select("name", F.posexplode(F.array(*[F.concat_ws("/", F.nullif("root", F.lit("")), F.lit(f)) for f in ("tsconfig.json", "tsconfig.lib.json", "tsconfig.app.json")], F.lit("tsconfig.base.json"), F.lit("tsconfig.json"))).alias("rank", "path"))
    chain = picks.join(own, "path").groupBy("name").agg(F.min_by(F.struct("path", "c"), "rank").alias("x")).select("name", "x.path", "x.c", F.array("x.path").alias("seen"))
    chain = stored(chain.withColumn("level", F.lit(0)), "configuration-chain")
    levels = []
    while not chain.isEmpty():
        levels.append(chain)
        above = chain.where("c.extends is not null").select("name", "path", "seen", "level", "c.extends")
        relative = F.col("extends").rlike(r"^(\.|/)")
        beside = above.where(relative).select("name", "seen", "level", F.lit(0).alias("up"), paths.normalize_path(F.concat_ws("/", F.nullif(paths.dirname(F.col("path")), F.lit("")), "extends")).alias("base"))
        folders = F.concat(paths.ancestors(F.col("path")), F.array(F.lit("")))
        below = above.where(~relative).select("name", "seen", "level", "extends", F.posexplode(folders).alias("up", "dir"))
        below = below.select("name", "seen", "level", "up", F.concat_ws("/", F.nullif("dir", F.lit("")), F.lit("node_modules"), "extends").alias("base"))
        tried = lambda df: df.select("name", "seen", "level", "up", F.posexplode(F.array("base", F.concat("base", F.lit(".json")), F.concat("base", F.lit("/tsconfig.json")))).alias("end", "path"))
        every = tried(beside).unionByName(tried(below))
        hits = every.join(own, "path")
        wanted = stored(every.where(F.col("path").contains("node_modules/")), "configuration-wanted")
        if not wanted.isEmpty():
            known = tree.contents(tree.probe(wanted).where(F.col("kind") == FILE))
            hits = hits.unionByName(wanted.join(read(known), "path"))
        hits = hits.where(~F.array_contains("seen", F.col("path"))).groupBy("name").agg(F.min_by(F.struct("path", "c", "seen", "level"), F.struct("up", "end")).alias("x"))
        chain = stored(hits.select("name", "x.path", "x.c", F.concat("x.seen", F.array("x.path")).alias("seen"), (F.col("x.level") + 1).alias("level")), "configuration-chain")
    merged = chain
    for x in levels:
        merged = merged.unionByName(x)
    base = paths.normalize_path(F.concat_ws("/", F.nullif(paths.dirname(F.col("path")), F.lit("")), "c.compilerOptions.baseUrl"))
    bases = merged.where("c.compilerOptions.baseUrl is not null").groupBy("name").agg(F.min_by(base, "level").alias("base_url"))
    listed = merged.select("name", "level", F.explode("c.compilerOptions.paths").alias("alias", "targets"))
    nearest = listed.groupBy("name", "alias").agg(F.min_by("targets", "level").alias("targets"))
    return nearest.join(bases, "name", "left").select(F.col("name").alias("project"), "alias", F.posexplode("targets").alias("ord", "target"), F.coalesce("base_url", F.lit("")).alias("base_url"))


def entry_bases(folder: Column, manifest: Column) -> Column:
    """Array of the paths that a package's manifest names as its entry, in order, the folder itself last.

    These are ``types``, ``main`` and what ``exports`` has for "." or, without a ".", has itself: a path or the
    first path of types, import and default.
    """
    text = lambda key: F.filter(F.array(F.get_json_object(manifest, key)), lambda x: x.isNotNull() & ~F.startswith(x, F.lit("{")) & ~F.startswith(x, F.lit("[")))
    dotted = F.get_json_object(manifest, "$.exports['.']").isNotNull()
    of = lambda at: F.slice(F.concat(*[text(at + k) for k in ("", ".types", ".import", ".default")]), 1, 1)
    named = F.concat(text("$.types"), text("$.main"), F.when(dotted, of("$.exports['.']")).otherwise(of("$.exports")))
    return F.concat(F.transform(named, lambda e: paths.normalize_path(F.concat_ws("/", F.nullif(folder, F.lit("")), e))), F.array(folder))


def _packages(config: DataFrame, everything: DataFrame) -> DataFrame:
    """Workspace packages by name: their folder and the file that their manifest points to, null if there is none."""
    manifest = config.where(paths.basename(F.col("path")) == "package.json").where("path <> 'package.json'").withColumn("dir", paths.dirname(F.col("path")))
    named = manifest.select(F.get_json_object("content", "$.name").alias("package"), "dir", entry_bases(F.col("dir"), F.col("content")).alias("bases")).where("package is not null")
    tried = named.select("package", F.posexplode("bases").alias("rank", "base")).select("package", "rank", F.inline(file_candidates(F.col("base"))))
    entry = tried.join(everything, "path").groupBy("package").agg(F.min_by("path", F.struct("rank", "step", "path")).alias("entry"))
    return named.groupBy("package").agg(F.min("dir").alias("dir")).join(entry, "package", "left")


def installed_packages(tree: Tree, bare: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(folder, real, bases) of the packages that ``bare`` (path, source) may mean in a node_modules above, and all (link, target).

    ``real`` is the folder with links followed, as package managers link workspace packages; rings are no folders.
    Only package folders that some import names are looked at.
    """
    modules = tree.entries.where((paths.basename(F.col("path")) == "node_modules") & F.col("kind").isin(FOLDER, "closed")).select(F.col("path").alias("modules"), paths.dirname(F.col("path")).alias("at"))
    dirs = bare.select(paths.dirname(F.col("path")).alias("dir"), paths.package_of(F.col("source")).alias("package")).distinct()
    steps = F.concat(F.filter(F.array("dir"), lambda d: d != ""), paths.ancestors(F.col("dir")), F.array(F.lit("")))
    near = dirs.select("package", F.explode(steps).alias("at")).distinct().join(modules, "at")
    probed = stored(tree.probe(near.select(F.concat_ws("/", "modules", "package").alias("path"))), "packages-probed")
    links = stored(known_links(tree, probed), "links")
    folders = rewritten(probed.where(F.col("kind") == FOLDER), links).where("real is not null")
    folders = stored(folders.select(F.col("path").alias("folder"), "real"), "packages-real")
    manifests = tree.contents(folders.select(F.concat_ws("/", F.nullif("real", F.lit("")), F.lit("package.json")).alias("path"))).select(paths.dirname(F.col("path")).alias("real"), "content")
    known = folders.join(manifests, "real", "left")
    return stored(known.select("folder", "real", entry_bases(F.col("real"), F.coalesce("content", F.lit("{}"))).alias("bases")), "packages-installed"), links


def _rules(config: DataFrame, name: str | None) -> tuple[DataFrame, DataFrame]:
    """(source_tag, allowed) of the first rules file that exists of ``name``, names apart by commas, and (path) if it can't be parsed."""
    names = list(RULES_FILES) if not name else [n.strip() for n in name.split(",")]
    rank = F.array_position(F.lit(names), F.col("path"))
    first = config.where(F.col("path").isin(names)).select("path", "content", rank.alias("rank")).orderBy("rank").limit(1)
    parsed = first.select("path", json_object(F.col("content"), _RULES).alias("c"))
    rules = parsed.select(F.explode("c.boundaries").alias("b")).select(F.col("b.sourceTag").alias("source_tag"), F.col("b.allowedTags").alias("allowed"))
    return rules, parsed.where("c is null").select("path")


def _standalone(config: DataFrame) -> bool:
    """Whether the framework's major version makes components standalone by default."""
    root = config.where("path = 'package.json'")
    version = F.coalesce(*[F.get_json_object("content", f"$.{kind}['{FRAMEWORK}']") for kind in ("dependencies", "devDependencies")])
    row = root.select(version_major(version).alias("v")).first()
    return bool(row and row["v"] is not None and row["v"] >= 19)


def facts(ws: Workspace, store: FactStore | None = None) -> dict[str, DataFrame]:
    """All fact tables of the workspace's scripts; with a ``store`` only files that it doesn't know are lexed."""
    source = ws.files.where(~F.col("path").endswith(".html"))
    read = stored(scripts.lexed(source) if store is None else store.statements(source), "statements")
    u = stored(scripts.units_of(read), "units")
    out = {name: getattr(scripts, name)(u) for name in ("imports", "dynamic_imports", "exports", "used_names", "local_references", "jsx_usages", "react_components", "entities")}
    out = {name: stored(df, name.replace("_", "-")) for name, df in out.items()}
    parsed = u.select("path").distinct()
    empty = source.select("path").where(F.trim(F.coalesce("content", F.lit(""))) == "")
    out["source_files"] = source.join(parsed.unionByName(empty).distinct(), "path", "left_semi").select("path", "project")
    out["timings"] = read.select("path", "took_us")
    ordered = Window.partitionBy("path").orderBy("n", "k")
    out["imports"] = out["imports"].withColumn("ord", F.row_number().over(ordered))
    return out
