"""A folder as tables: what it holds, listed by tasks that share the work, single paths probed, contents read.

Tasks list folders and hand back those that they didn't get to, which the next round deals out anew. So
neither the driver nor one task walks a large tree, and folders that no scan enters are named but never opened.
"""

from __future__ import annotations

import os
import posixpath
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.scratch import discard, stored

ENTRY = "path string, kind string, target string"
FILE, FOLDER, CLOSED, _LATER = "file", "folder", "closed", "later"
#: Entries that a task lists in a round before it hands folders back.
BUDGET = 20_000
_READ_ROWS = 64


def ignored(name: str) -> bool:
    """Whether scans stay out of a folder of this name: hidden ones and those that hold what was built or installed."""
    return name in paths.IGNORED_DIRS or (name.startswith(".") and name not in (".", ".."))


@dataclass(frozen=True)
class Store:
    """The files below ``root``, of this machine or of a store that pyarrow opens; paths are relative to it."""

    root: str

    @property
    def _local(self) -> str | None:
        return None if "://" in self.root else self.root.removeprefix("file:")

    def _remote(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def _at(self, path: str) -> str:
        return os.path.join(self._local, path)

    def target(self, path: str) -> str | None:
        """Where a link leads, relative to the root if it is below; None if it is no link."""
        try:
            to = os.readlink(self._at(path))
        except OSError:
            return None
        if os.path.isabs(to):
            below = os.path.relpath(to, os.path.abspath(self._local))
            return to if below.startswith("..") else below
        return posixpath.normpath(posixpath.join(posixpath.dirname(path), to))

    def list(self, folder: str) -> list[tuple[str, str | None, str | None]]:
        """(name, kind, target) of what a folder holds; a link has the kind of what it leads to, None if that doesn't exist."""
        if self._local is not None:
            try:
                with os.scandir(self._at(folder)) as found:
                    return [(e.name, *(self.stat(posixpath.join(folder, e.name)) if e.is_symlink() else (FOLDER if e.is_dir() else FILE if e.is_file() else None, None))) for e in found]
            except (PermissionError, FileNotFoundError):
                return []  # closed to us, or gone since its parent was listed
        from pyarrow import fs

        store, top = self._remote()
        found = store.get_file_info(fs.FileSelector(posixpath.join(top, folder), allow_not_found=True))
        return [(i.base_name, FOLDER if i.type == fs.FileType.Directory else FILE, None) for i in found]

    def stat(self, path: str) -> tuple[str | None, str | None]:
        """(kind, target) of a path; kind None where nothing is."""
        if self._local is not None:
            at = self._at(path)
            return FOLDER if os.path.isdir(at) else FILE if os.path.isfile(at) else None, self.target(path)
        from pyarrow import fs

        store, top = self._remote()
        kind = store.get_file_info(posixpath.join(top, path)).type
        return {fs.FileType.Directory: FOLDER, fs.FileType.File: FILE}.get(kind), None

    def read(self, path: str) -> bytes | None:
        """A file's bytes, None if it can't be read."""
        try:
            if self._local is not None:
                with open(self._at(path), "rb") as f:
                    return f.read()
            store, top = self._remote()
            with store.open_input_stream(posixpath.join(top, path)) as f:
                return f.read()
        except OSError:
            return None


def listed(store: Store, folders: list[str], budget: int, enter: Callable[[str], bool]) -> Iterator[tuple[str, str | None, str | None]]:
    """Entries below ``folders``, breadth first; once ``budget`` are listed, the folders left come as ``_LATER``."""
    todo, n = deque(folders), 0
    while todo:
        folder = todo.popleft()
        if n >= budget:
            yield folder, _LATER, None
            continue
        for name, kind, target in store.list(folder):
            n += 1
            path = f"{folder}/{name}" if folder else name
            if kind == FOLDER and target is None and enter(name):
                todo.append(path)
                yield path, FOLDER, None
            else:
                yield path, CLOSED if kind == FOLDER and target is None else kind, target


class Tree:
    """What is below a root. ``entries`` (path, kind, target) are files, folders and links; folders that ``ignored`` names are ``CLOSED``, unless ``all_folders``."""

    def __init__(self, spark: SparkSession, root: str, all_folders: bool = False, budget: int = BUDGET):
        self.spark, self.store = spark, Store(root)
        enter = (lambda name: True) if all_folders else (lambda name: not ignored(name))
        self.entries = stored(self._walked(enter, budget), "tree")

    def _walked(self, enter: Callable[[str], bool], budget: int) -> DataFrame:
        store, rounds = self.store, []

        def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame(listed(store, b["path"].tolist(), budget, enter), columns=["path", "kind", "target"], dtype=object)

        front = self.spark.createDataFrame([("",)], "path string")
        while True:
            rounds.append(stored(front.mapInPandas(some, ENTRY), "tree-round"))
            later = rounds[-1].where(F.col("kind") == _LATER).select("path")
            if later.isEmpty():
                break
            front = later.repartition(self.spark.sparkContext.defaultParallelism)
        out = rounds[0]
        for r in rounds[1:]:
            out = out.unionByName(r)
        return out.where(F.coalesce("kind", F.lit("")) != _LATER)

    def probe(self, wanted: DataFrame) -> DataFrame:
        """(path, kind, target) of those of ``wanted`` (path) that exist, links whose target doesn't included; also what is in closed folders or outside."""
        store = self.store

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(p, *store.stat(p)) for p in b["path"]]
                yield pd.DataFrame([r for r in rows if r[1] or r[2]], columns=["path", "kind", "target"], dtype=object)

        return wanted.select("path").where("path is not null").distinct().mapInPandas(look, ENTRY)

    def contents(self, wanted: DataFrame) -> DataFrame:
        """(path, content) of those of ``wanted`` (path) that can be read, malformed bytes replaced."""
        store = self.store

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for at in range(0, len(b), _READ_ROWS):
                    some = b["path"].iloc[at : at + _READ_ROWS].tolist()
                    found = [(p, data.decode("utf-8", "replace")) for p in some if (data := store.read(p)) is not None]
                    yield pd.DataFrame(found, columns=["path", "content"], dtype=object)

        return wanted.select("path").distinct().mapInPandas(read, "path string, content string")


class ReaderTree(Tree):
    """A tree in a store that only Spark's readers open: its file index lists everything once, and there are no links."""

    def __init__(self, spark: SparkSession, root: str, all_folders: bool = False):
        self.spark = spark
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        top = F.lit("/" + root.split("://", 1)[1].split("/", 1)[-1].strip("/"))
        below = paths.relative_path(F.regexp_replace("path", r"^[a-z]+:/*[^/]*/", "/"), top)
        self._all = read.select(below.alias("path"), F.decode("content", "UTF-8").alias("content"))
        self._everything = stored(self._all.select("path", F.lit(FILE).alias("kind"), F.lit(None).cast("string").alias("target")), "tree")
        folders = self._everything.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
        self._folders = stored(folders.select("path", F.lit(FOLDER).alias("kind"), F.lit(None).cast("string").alias("target")), "tree-folders")
        named = self._folders.withColumn("kind", F.when(paths.in_ignored_dir(F.concat("path", F.lit("/x"))), CLOSED).otherwise(FOLDER))
        every = self._everything.unionByName(named)
        self.entries = every if all_folders else every.where(~paths.in_ignored_dir(F.col("path")))

    def probe(self, wanted: DataFrame) -> DataFrame:
        return self._everything.unionByName(self._folders).join(wanted.select("path").distinct(), "path", "left_semi")

    def contents(self, wanted: DataFrame) -> DataFrame:
        return self._all.join(wanted.select("path").distinct(), "path", "left_semi")


def open_tree(spark: SparkSession, root: str, all_folders: bool = False) -> Tree:
    """The tree of ``root`` by what can open it."""
    if "://" in root and not root.startswith("file:"):
        try:
            Store(root)._remote()
        except (OSError, ValueError, ImportError):
            return ReaderTree(spark, root, all_folders)
    return Tree(spark, root.replace("file://", "file:"), all_folders)


def known_links(tree: Tree, probed: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(link, target) of the tree and of ``probed`` entries, and of the links that their targets pass through in closed folders."""
    links = [stored(tree.entries.unionByName(probed).where("target is not null").select(F.col("path").alias("link"), "target").distinct(), "links")]
    seen = probed.select("path")
    for _ in range(max_rounds):
        steps = links[-1].select(F.explode(F.concat(F.array("target"), paths.ancestors(F.col("target")))).alias("path")).distinct()
        unknown = steps.where(paths.in_ignored_dir(F.concat("path", F.lit("/x")))).join(seen, "path", "left_anti")
        fresh = stored(tree.probe(unknown), "links-probed")
        more = fresh.where("target is not null")
        if more.isEmpty():
            discard(fresh)
            break
        seen = seen.unionByName(fresh.select("path"))
        links.append(more.select(F.col("path").alias("link"), "target"))
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out.distinct()
