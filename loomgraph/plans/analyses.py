"""The workspace analyses as plans over fact tables: resolution, stats, unused code, moves, boundaries, usages."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import markup, paths
from loomgraph.operators import findings, graph, usage
from loomgraph.operators.prefix_join import project_of
from loomgraph.operators.resolve import follow_barrels, import_type, resolve
from loomgraph.operators.within import alive_within
from loomgraph.scratch import stored
from loomgraph.sources.store import FactStore
from loomgraph.sources.workspace import Workspace, facts, installed_packages


def _once(method):
    """A method whose plans, and the rounds behind them, are made once for each object."""

    @wraps(method)
    def known(self):
        made = self.__dict__.setdefault("_made", {})
        if method.__name__ not in made:
            made[method.__name__] = method(self)
        return made[method.__name__]

    return known


@dataclass
class Analysis:
    """All analyses of one workspace, each a DataFrame that runs when asked for."""

    ws: Workspace
    f: dict[str, DataFrame] = field(default_factory=dict)
    store: FactStore | None = None

    def __post_init__(self) -> None:
        self.f = self.f or facts(self.ws, self.store)
        self._resolve()
        self._templates()
        self._edges()

    # --- resolution

    def _resolve(self) -> None:
        f, projects = self.f, self.ws.files.select("path", "project").distinct()
        barrels = f["exports"].where("from_module is not null").select("path", F.col("from_module").alias("source"), F.lit(True).alias("barrel"))
        specifiers = f["imports"].select("path", "source").unionByName(f["dynamic_imports"].select("path", "source")).withColumn("barrel", F.lit(False)).unionByName(barrels)
        specifiers = stored(specifiers.distinct().join(projects, "path"), "wanted")
        installed, links = installed_packages(self.ws.tree, specifiers.where(import_type(F.col("source")) == "Bare"))
        r = stored(resolve(specifiers, self.ws.all_paths, self.ws.aliases, self.ws.packages, installed, links, self.ws.tree.probe), "resolved")
        self.resolution = r.drop("barrel").distinct()
        found = r.where("resolved is not null").select("path", "source", "barrel", F.col("resolved").alias("file"))
        target = found.where("not barrel").drop("barrel")
        reexports = f["exports"].where("from_module is not null").join(found.where("barrel").select("path", F.col("source").alias("from_module"), F.col("file").alias("src")), ["path", "from_module"])
        declared = f["exports"].where("from_module is null and kind <> 'Default'").select(F.col("path").alias("file"), "name")
        declared = declared.unionByName(f["exports"].where("kind = 'Default'").select(F.col("path").alias("file"), F.lit("default").alias("name")))
        forwarded = reexports.where("kind = 'ReExport' and original <> '*'").select(F.col("path").alias("file"), "name", "original", F.col("src").alias("source"))
        stars = reexports.where("kind = 'ReExportAll'").select(F.col("path").alias("file"), F.col("n").alias("ord"), F.col("src").alias("source"))
        wanted = f["imports"].join(target, ["path", "source"])
        lookup = F.when(F.col("kind") == "Default", "default").otherwise(F.coalesce("alias", "name"))
        wanted = wanted.withColumn("lookup", lookup)
        searched = wanted.where("kind in ('Named', 'Default')").select("file", F.col("lookup").alias("name")).unionByName(reexports.where("original <> '*'").select(F.col("src").alias("file"), F.col("original").alias("name")))
        found = stored(follow_barrels(searched, declared, forwarded, stars), "declarations")
        hit = found.withColumnRenamed("name", "lookup")
        self.imports = stored(
            wanted.join(hit, ["file", "lookup"], "left").withColumn("resolved_path", F.coalesce("target", "file"))
            .select("path", "n", "ord", "source", "name", "alias", "kind", "resolved_path"), "imports-resolved",
        )
        self.lazy = stored(f["dynamic_imports"].join(target, ["path", "source"]).select("path", "source", F.col("file").alias("resolved_path")), "lazy-resolved")
        original = reexports.join(found.select(F.col("file").alias("src"), F.col("name").alias("original"), "target"), ["src", "original"], "left")
        self.reexport_edges = original.select(F.col("path").alias("src"), F.coalesce("target", F.col("src")).alias("dst"))

    def timings(self) -> DataFrame:
        """(project, files, total_ms, mean_ms): how long tasks took to read the scripts of each project, the slowest first, and of all, project null."""
        known = self.f["timings"].join(self.ws.files.select("path", "project").distinct(), "path")
        by = known.rollup("project").agg(F.count("*").alias("files"), (F.sum("took_us") / 1000).alias("total_ms"), (F.avg("took_us") / 1000).alias("mean_ms"))
        return by.orderBy(F.col("project").isNull(), F.desc("total_ms"), "project")

    def source_files(self) -> DataFrame:
        """(path, project, imports, exports) of every script that could be read: resolved imports with their targets, and exports."""
        imports = self.imports.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("source"), "name", "kind", "resolved_path"))).alias("imports"))
        exports = self.f["exports"].groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", "name", "kind", "from_module"))).alias("exports"))
        return self.f["source_files"].join(imports, "path", "left").join(exports, "path", "left").orderBy("path")

    def entity_tables(self) -> dict[str, DataFrame]:
        """The decorated classes by kind, each with what its metadata says; standalone defaults to the framework's major version."""
        e = self.f["entities"].join(self.ws.files.select("path", F.col("project").alias("package_name")).distinct(), "path", "left")
        e = e.withColumn("standalone", F.coalesce("standalone", F.lit(self.ws.default_standalone)))
        head = [F.col("path").alias("source_path"), "package_name"]
        parts = {
            "components": ("Component", ["name", *head, "selector", "template_path", "template_inline", "style_paths", "standalone", F.col("imports").alias("standalone_imports"), "providers", "inputs", "outputs"]),
            "directives": ("Directive", ["name", *head, "selector", "standalone", "host_bindings", "inputs", "outputs"]),
            "pipes": ("Pipe", [F.col("name").alias("class_name"), "pipe_name", *head, "pure", "standalone"]),
            "services": ("Injectable", ["name", *head, "provided_in"]),
            "modules": ("NgModule", ["name", *head, "declarations", F.col("imports").alias("imports_idents"), "exports", "providers", "bootstrap"]),
        }
        return {key: e.where(F.col("kind") == kind).orderBy("path", "name").select(*columns) for key, (kind, columns) in parts.items()}

    def resolution_health(self) -> dict[str, DataFrame]:
        """unresolved_internal (file, specifier), unresolved_external (specifier, files), totals (resolved_imports)."""
        lost = self.resolution.where("resolved is null")
        internal = lost.where("scope = 'Internal'").select(F.col("path").alias("file"), F.col("source").alias("specifier")).orderBy("file", "specifier")
        external = lost.where("scope = 'External'").groupBy(F.col("source").alias("specifier")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "specifier")
        total = self.imports.select("path").unionByName(self.lazy.select("path")).agg(F.count("*").alias("resolved_imports"))
        return {"unresolved_internal": internal, "unresolved_external": external, "totals": total}

    # --- templates and edges

    def _templates(self) -> None:
        e, html = self.f["entities"], self.ws.files.where(F.col("path").endswith(".html")).select(F.col("path").alias("file"), "content")
        components = e.where("kind = 'Component'").withColumn("file", paths.normalize_path(F.concat_ws("/", F.nullif(paths.dirname(F.col("path")), F.lit("")), "template_path")))
        texts = components.join(html, "file", "left").select("path", "name", F.coalesce("template_inline", "content").alias("html")).where("html is not null")
        registry = e.where("kind in ('Component', 'Directive') and selector is not null").select(F.col("name").alias("target"), F.col("path").alias("target_path"), F.col("kind").alias("target_kind"), F.explode(markup.parse_selector(F.col("selector"))).alias("s"))
        anchor = F.coalesce(F.concat(F.lit("e:"), "s.element"), F.concat(F.lit("a:"), F.get("s.attributes", F.lit(0))), F.concat(F.lit("c:"), F.get("s.classes", F.lit(0))))
        used = texts.select("path", "name", F.explode(markup.elements(F.col("html"))).alias("e")).distinct()
        marks = F.concat(F.array(F.concat(F.lit("e:"), "e.tag")), F.transform("e.attributes", lambda a: F.concat(F.lit("a:"), a)), F.transform("e.classes", lambda c: F.concat(F.lit("c:"), c)))
        matched = used.withColumn("anchor", F.explode(marks)).join(registry.withColumn("anchor", anchor), "anchor").where(markup.matches(F.array("s"), F.col("e")))
        row = [F.col("name").alias("component"), F.col("path").alias("component_path"), "target", "target_path", "target_kind"]
        piped = texts.select("path", "name", F.explode(markup.template_pipes(F.col("html"))).alias("pipe_name")).join(
            e.where("kind = 'Pipe'").select("pipe_name", F.col("name").alias("target"), F.col("path").alias("target_path"), F.col("kind").alias("target_kind")), "pipe_name")
        both = matched.select(*row, F.lit("Selector").alias("via")).unionByName(piped.select(*row, F.lit("Pipe").alias("via"))).distinct()
        self.template_usages = stored(both, "template-usages")

    def _edges(self) -> None:
        arms = [
            self.imports.select(F.col("path").alias("src"), F.col("resolved_path").alias("dst")), self.reexport_edges,
            self.lazy.select(F.col("path").alias("src"), F.col("resolved_path").alias("dst")),
            self.template_usages.select(F.col("component_path").alias("src"), F.col("target_path").alias("dst")),
        ]
        out = arms[0]
        for a in arms[1:]:
            out = out.unionByName(a)
        self.edges = stored(graph.edge_set(out), "edges")

    @_once
    def file_cycles(self) -> DataFrame:
        """Groups of files that import each other in circles."""
        return graph.cycle_groups(graph.scc(self.edges)).orderBy("members")

    # --- projects

    def _placed(self, df: DataFrame, path: str, out: str) -> DataFrame:
        return project_of(df, self.ws.projects, path=path, out=out)

    def dependencies(self) -> DataFrame:
        """(from_project, to_project, symbol, lazy) of each reference across projects."""
        named = self.imports.select("path", F.col("resolved_path").alias("to"), F.when(F.col("kind") == "SideEffect", "*").otherwise(F.coalesce("alias", "name")).alias("symbol"), F.lit(False).alias("lazy"))
        lazy = self.lazy.select("path", F.col("resolved_path").alias("to"), F.lit("*").alias("symbol"), F.lit(True).alias("lazy"))
        shown = self.template_usages.select(F.col("component_path").alias("path"), F.col("target_path").alias("to"), F.col("target").alias("symbol"), F.lit(False).alias("lazy"))
        every = self._placed(self._placed(named.unionByName(lazy).unionByName(shown), "path", "from_project"), "to", "to_project")
        return every.where("from_project is not null and to_project is not null and from_project <> to_project").select("from_project", "to_project", "symbol", "lazy")

    @_once
    def stats(self) -> dict[str, DataFrame]:
        """projects with coupling, dependencies with symbols, project_cycles."""
        deps = stored(self.dependencies(), "dependencies")
        by_symbol = deps.groupBy("from_project", "to_project", "symbol").agg(F.count("*").alias("count"), F.bool_or("lazy").alias("lazy"))
        matrix = by_symbol.groupBy("from_project", "to_project").agg(F.sum("count").alias("count"), F.bool_or("lazy").alias("lazy"), F.array_sort(F.collect_list(F.struct(F.col("symbol").alias("name"), "count"))).alias("symbols"))
        files = self.f["source_files"].groupBy(F.col("project").alias("name")).agg(F.count("*").alias("files"))
        exported = self.f["exports"].join(self.f["source_files"], "path").groupBy(F.col("project").alias("name")).agg(F.count("*").alias("exports"))
        projects = usage.coupling(self.ws.projects, deps).join(files, "name", "left").join(exported, "name", "left").fillna(0, ["files", "exports"]).orderBy("name")
        cycles = graph.cycle_groups(graph.scc(matrix.select(F.col("from_project").alias("src"), F.col("to_project").alias("dst"))))
        return {"projects": projects, "dependencies": matrix.orderBy("from_project", "to_project"), "project_cycles": cycles.orderBy("members")}

    def boundaries(self) -> DataFrame:
        """Dependencies that the tag rules don't allow."""
        return usage.boundary_violations(self.dependencies(), self.ws.projects.select("name", "tags"), self.ws.rules).orderBy("from_project", "to_project", "source_tag")

    def move_candidates(self) -> DataFrame:
        """Exports that exactly one other project uses, and their own not at all; tests don't count."""
        uses = self.imports.where((F.col("kind") != "SideEffect") & ~paths.is_test_file(F.col("path"))).select("path", F.col("resolved_path").alias("file"), F.coalesce("alias", "name").alias("symbol"))
        shown = self.template_usages.where("component_path <> target_path").select(F.col("component_path").alias("path"), F.col("target_path").alias("file"), F.col("target").alias("symbol"))
        placed = self._placed(self._placed(uses.unionByName(shown), "path", "project"), "file", "home").where("project is not null and home is not null")
        own = self.f["exports"].where("kind not in ('ReExport', 'ReExportAll')").select(F.col("path").alias("file"), F.col("name").alias("symbol"), F.col("kind")).distinct()
        return usage.single_consumers(placed, ["file", "symbol"]).join(own, ["file", "symbol"]).orderBy("file", "symbol")

    # --- unused code

    def usages_index(self) -> DataFrame:
        """(path, name, from_path, test): each use of an export by another file."""
        used = self.f["used_names"].select("path", "name")
        real = self.imports.where("kind <> 'SideEffect'").join(used, ["path", "name"], "left_semi")
        named = real.where("kind <> 'Namespace'").select(F.col("resolved_path").alias("to"), F.coalesce("alias", "name").alias("symbol"), "path")
        every = real.where("kind = 'Namespace'").join(self.f["exports"].select(F.col("path").alias("to"), F.col("name").alias("symbol")), F.col("resolved_path") == F.col("to")).select("to", "symbol", "path")
        shown = self.template_usages.where("not (component_path = target_path and component = target)").select(F.col("target_path").alias("to"), F.col("target").alias("symbol"), F.col("component_path").alias("path"))
        return named.unionByName(every).unionByName(shown).select(F.col("to").alias("path"), F.col("symbol").alias("name"), F.col("path").alias("from_path"), paths.is_test_file(F.col("path")).alias("test"))

    @_once
    def unused(self) -> dict[str, DataFrame]:
        """unused_exports, test_only_exports, export_only, unused_imports, declared_not_rendered, orphan_files."""
        f, e = self.f, self.f["entities"]
        uses = stored(self.usages_index(), "uses")
        index = usage.usage_index(uses, ["path", "name"], F.col("test"))
        boots = e.where("kind = 'NgModule'").select(F.explode("bootstrap").alias("name")).distinct()
        seeds = self.lazy.where(~paths.is_test_file(F.col("path"))).select(F.col("resolved_path").alias("node"))
        lazy = stored(graph.reachable(self.edges, seeds, include_seeds=True), "lazy").select(F.col("node").alias("path")).distinct()
        framework = self.ws.projects.select(F.explode("entry_dirs").alias("root"), "name")
        files = project_of(f["source_files"], framework, out="entry_of")
        skipped = paths.is_test_file(F.col("path")) | paths.is_entry_file(F.col("path")) | F.col("entry_of").isNotNull() | paths.is_ambient(F.col("path"))
        open_files = stored(files.where(~skipped).select("path", "project"), "open-files")

        exports = f["exports"].select("path", "name", "kind").distinct().join(open_files, "path")
        entity = e.select("path", "name", "kind", F.when(F.col("kind") == "NgModule", 4).when(F.col("kind") == "Injectable", 3).when(F.col("kind") == "Pipe", 2).when(F.col("kind") == "Directive", 1).otherwise(0).alias("prio"))
        entity = entity.unionByName(f["react_components"].select("path", "name", F.lit("ReactComponent").alias("kind"), F.lit(5).alias("prio")))
        entity = usage.by_priority(entity.replace({"NgModule": "Module", "Injectable": "Service"}, subset=["kind"]), ["path", "name"], "kind", "prio").withColumnRenamed("kind", "entity")
        known = exports.join(index, ["path", "name"], "left").join(entity, ["path", "name"], "left").fillna(0, ["prod_uses", "test_uses"])
        known = known.join(boots.withColumn("boot", F.lit(True)), "name", "left").join(lazy.withColumn("is_lazy", F.lit(True)), "path", "left")
        known = stored(known, "known-exports")

        refs = f["local_references"].select("path", F.col("from_name").alias("src"), F.col("to_name").alias("dst"))
        loaded = self.edges.select(F.col("dst").alias("path")).unionByName(lazy).distinct().select("path", F.lit("").alias("node"))
        alive_seeds = known.where("prod_uses > 0 or boot").select("path", F.col("name").alias("node")).unionByName(loaded)
        tests = known.where("prod_uses = 0 and test_uses > 0").select("path", F.col("name").alias("node"))
        alive = alive_within(refs, alive_seeds).select("path", F.col("node").alias("name")).distinct().withColumn("alive", F.lit(True))
        tested = alive_within(refs, tests).select("path", F.col("node").alias("name")).distinct().withColumn("tested", F.lit(True))
        yes = lambda c: F.coalesce(F.col(c), F.lit(False))
        kind = (
            F.when(F.col("kind").isin("ReExport", "ReExportAll") | yes("boot") | yes("is_lazy") | (F.col("prod_uses") > 0), None)
            .when(yes("alive"), "export_only").when((F.col("test_uses") > 0) | yes("tested"), "test_only_exports").otherwise("unused_exports")
        )
        classed = known.join(alive, ["path", "name"], "left").join(tested, ["path", "name"], "left").withColumn("class", kind).where("class is not null")
        classed = stored(classed.select(F.col("path").alias("file"), "name", F.coalesce("entity", "kind").alias("kind"), "project", "class").distinct(), "classified")
        out = {c: classed.where(F.col("class") == c).drop("class").orderBy("file", "name") for c in ("unused_exports", "test_only_exports", "export_only")}

        idle = self.imports.where("kind <> 'SideEffect'").join(f["used_names"].select("path", "name"), ["path", "name"], "left_anti")
        out["unused_imports"] = self._placed(idle, "resolved_path", "target_project").where("target_project is not null").select(F.col("path").alias("file"), "name", F.col("source").alias("specifier")).distinct().orderBy("file", "name", "specifier")

        wired = e.where("kind = 'Component'").select("path", F.explode(F.concat("imports", "providers")).alias("name")).unionByName(e.where("kind = 'NgModule'").select("path", F.explode(F.concat("imports", "declarations", "exports", "providers")).alias("name"))).distinct()
        shown = self.template_usages.where("not (component_path = target_path and component = target)").select(F.col("target_path").alias("path"), F.col("target").alias("name"))
        renderable = e.where("kind in ('Component', 'Directive', 'Pipe')").select("path", "name", "kind").join(shown, ["path", "name"], "left_anti").join(boots, "name", "left_anti").join(lazy, "path", "left_anti")
        real = uses.where("not test").select(F.struct("path", "name").alias("entity"), "name", F.col("from_path").alias("place")).distinct()
        allowed = real.join(wired.select("name", F.col("path").alias("place")), ["name", "place"], "left_semi").select("entity", "place")
        only = usage.all_uses_within(real.select("entity", "place"), allowed, "entity", ["place"]).select("entity.path", "entity.name")
        out["declared_not_rendered"] = self._placed(renderable.join(only, ["path", "name"], "left_semi"), "path", "project").select(F.col("path").alias("file"), "name", "kind", "project").orderBy("file", "name")

        modules = f["exports"].groupBy("path").agg(F.count("*").alias("n"), F.count("from_module").alias("m"))
        own = open_files.join(modules, "path", "left").where(~((paths.stem(F.col("path")) == "index") | (F.coalesce("n", F.lit(0)) > 0) & (F.col("n") == F.col("m"))))
        out["orphan_files"] = graph.orphans(own.join(lazy, "path", "left_anti").select(F.col("path").alias("node")), self.edges).select(F.col("node").alias("file")).orderBy("file")
        return out

    # --- components and symbols

    def _rendered(self) -> DataFrame:
        """(path, component, props, target): JSX tags with the file of the component they show."""
        tags = self.f["jsx_usages"].withColumn("id", F.monotonically_increasing_id())
        local = self.imports.groupBy("path", F.col("name").alias("component")).agg(F.min_by("resolved_path", "ord").alias("imported"))
        here = self.f["react_components"].select("path", F.col("name").alias("component"), F.lit(True).alias("here")).distinct()
        return tags.join(local, ["path", "component"], "left").join(here, ["path", "component"], "left").select("path", "component", "props", F.coalesce("imported", F.when(F.col("here"), F.col("path"))).alias("target")).where("target is not null")

    def react_usage(self) -> DataFrame:
        """Components with the number of their uses and of each property passed."""
        shown = stored(self._rendered(), "rendered")
        counts = shown.groupBy(F.col("target").alias("path"), F.col("component").alias("name")).agg(F.count("*").alias("usages"))
        props = shown.select(F.col("target").alias("path"), F.col("component").alias("name"), F.explode("props").alias("prop")).groupBy("path", "name", "prop").agg(F.count("*").alias("count"))
        props = props.groupBy("path", "name").agg(F.array_sort(F.collect_list(F.struct("prop", "count"))).alias("props"))
        out = self.f["react_components"].join(counts, ["path", "name"], "left").join(props, ["path", "name"], "left").fillna(0, ["usages"])
        return self._placed(out, "path", "project").orderBy("path", "name")

    def symbol_usages(self, symbol: str, from_project: str | None = None) -> dict[str, DataFrame]:
        """declarations of a symbol, its usages by way of use, and their number by project."""
        f = self.f
        kinds = f["exports"].where((F.col("name") == symbol) & ~F.col("kind").isin("ReExport", "ReExportAll")).select("path", "kind", F.lit(0).alias("prio"))
        kinds = kinds.unionByName(f["entities"].where((F.col("name") == symbol) & (F.col("kind") != "NgModule")).select("path", "kind", F.lit(1).alias("prio"))).unionByName(f["react_components"].where(F.col("name") == symbol).select("path", F.lit("ReactComponent").alias("kind"), F.lit(2).alias("prio")))
        declared = stored(usage.by_priority(kinds, ["path"], "kind", "prio"), "symbol-declarations")
        target = declared.select(F.col("path").alias("declared_in"))
        arm = lambda df, via: df.select("file", "declared_in", F.lit(via).alias("via"))
        imported = self.imports.where((F.col("kind") != "SideEffect") & (F.coalesce("alias", "name") == symbol)).select(F.col("path").alias("file"), F.col("resolved_path").alias("declared_in"))
        shown = self.template_usages.where(F.col("target") == symbol).select(F.col("component_path").alias("file"), F.col("target_path").alias("declared_in"))
        jsx = self._rendered().where(F.col("component") == symbol).select(F.col("path").alias("file"), F.col("target").alias("declared_in")).distinct()
        lazy = self.lazy.select(F.col("path").alias("file"), F.col("resolved_path").alias("declared_in"))
        every = arm(imported, "Import").unionByName(arm(shown, "Template")).unionByName(arm(jsx, "Jsx")).unionByName(arm(lazy, "LazyLoad"))
        placed = self._placed(usage.uses_of(every, target, "declared_in", paths.is_test_file(F.col("file"))), "file", "project")
        if from_project is not None:
            placed = placed.where(F.col("project") == from_project)
        return {"declarations": declared.orderBy("path"), "usages": placed.orderBy("file", usage.rank_of_way(F.col("via"))), "by_project": placed.groupBy("project").agg(F.count("*").alias("usages")).orderBy("project")}

    # --- findings

    def text_mentions(self) -> dict[str, DataFrame]:
        """Findings of unused names that a plain search of texts contradicts: what to look at first if a finding seems wrong.

        exports (file, name, mentioned_in): unused exports whose name stands as a word in other files of
        the workspace; orphans (file, mentioned_in): orphan files whose name some text holds in quotes.
        """
        words = self.ws.files.select(F.col("path").alias("at"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0)))).alias("name"))
        u = self.unused()
        found = u["unused_exports"].select("file", "name").join(words, "name").where("at <> file")
        exports = found.groupBy("file", "name").agg(F.count("*").alias("mentioned_in")).orderBy("file", "name")
        quoted = self.ws.files.select(F.col("path").alias("at"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"""["'`][^"'`\n]*?([\w.-]+)["'`]"""), F.lit(1)))).alias("stem"))
        stem = F.regexp_replace(paths.basename(F.col("file")), r"\.[cm]?[jt]sx?$", "")
        lost = u["orphan_files"].select("file", stem.alias("stem")).join(quoted, "stem").where("at <> file")
        return {"exports": exports, "orphans": lost.groupBy("file").agg(F.count("*").alias("mentioned_in")).orderBy("file")}

    def found(self) -> dict[str, DataFrame]:
        """The tables of all analyses that report findings, by name."""
        return self.unused() | {"file_cycles": self.file_cycles(), "project_cycles": self.stats()["project_cycles"], "boundaries": self.boundaries()}

    def finding_keys(self) -> DataFrame:
        """The keys of all findings, each once."""
        return findings.finding_keys(self.found())
