"""Path functions as column expressions; paths are strings with ``/``, normalised lexically."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stems of files that a router framework reads by convention.
CONVENTION_STEMS = (
    "page", "layout", "route", "template", "loading", "error", "global-error", "not-found", "default", "middleware",
    "proxy", "instrumentation", "opengraph-image", "twitter-image", "icon", "apple-icon", "sitemap", "robots", "manifest",
)
#: Names, and what names contain, of files that tools start from.
ENTRY_NAMES, ENTRY_PATTERN = ("main.ts", "main.tsx", "polyfills.ts"), r"\.(config|setup|stories)\.|^global-(setup|teardown)\."
#: Directories that no scan enters, besides hidden ones.
IGNORED_DIRS = ("node_modules", "dist", "coverage", "storybook-static", "tmp")


def normalize_path(path: Column) -> Column:
    """Drops ``.`` and empty steps; ``..`` takes back a step, or stays where there is none to take."""

    def walk(done: Column, step: Column) -> Column:
        back = (step == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("")) != "..")
        return F.when(step.isin("", "."), done).when(back, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(step)))

    steps = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), walk)
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(steps, "/"))


def relative_path(path: Column, root: Column) -> Column:
    """The path below ``root``; a path elsewhere unchanged."""
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substring(path, F.char_length(root) + 2, F.char_length(path))).otherwise(path)


def basename(path: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """What precedes the last slash, empty if there is none."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def stem(path: Column) -> Column:
    """The base name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """The last extension without its dot, empty if there is none."""
    return F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)


def ancestors(path: Column) -> Column:
    """All enclosing directories, nearest first; a relative path ends with its first step."""
    steps = F.split(path, "/")
    return F.filter(
        F.transform(F.reverse(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(steps) - 1))), lambda n: F.array_join(F.slice(steps, 1, n), "/")),
        lambda p: (p != "") & (F.size(steps) > 1),
    )


def is_test_file(path: Column) -> Column:
    """Tests by name: ``.spec.``, ``.test.`` or a ``_test.ts`` ending."""
    return basename(path).rlike(r"\.(spec|test)\.|_test\.ts$")


def is_entry_file(path: Column) -> Column:
    """Files that tools or frameworks load by their name."""
    by_name = basename(path).isin(*ENTRY_NAMES) | basename(path).rlike(ENTRY_PATTERN)
    return by_name | (extension(path).isin("ts", "tsx", "js", "jsx") & stem(path).isin(*CONVENTION_STEMS))


def is_ambient(path: Column) -> Column:
    """Declaration files."""
    return F.endswith(path, F.lit(".d.ts"))


def is_barrel(path: Column, from_modules: Column) -> Column:
    """Index files, and files all of whose exports come from other modules (an array, one entry an export)."""
    return (stem(path) == "index") | ((F.size(from_modules) > 0) & F.forall(from_modules, lambda m: m.isNotNull()))


def in_ignored_dir(path: Column) -> Column:
    """Whether a directory above is hidden or one that scans skip."""
    above = F.slice(F.split(path, "/"), 1, F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1))
    return F.exists(above, lambda d: d.isin(*IGNORED_DIRS) | (F.startswith(d, F.lit(".")) & (F.length(d) > 1) & (d != "..")))


def package_of(specifier: Column) -> Column:
    """The package of a bare specifier: one step, or two if scoped."""
    return F.regexp_extract(specifier, r"^(@[^/]+/[^/]+|[^/]+)", 1)


def subpath_of(specifier: Column) -> Column:
    """What follows the package in a specifier, null if nothing does."""
    return F.nullif(F.regexp_extract(specifier, r"^(?:@[^/]+/[^/]+|[^@/][^/]*)/(.+)$", 1), F.lit(""))
