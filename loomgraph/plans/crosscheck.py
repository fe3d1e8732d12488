"""Unused findings held against a plain search of the texts: what it contradicts is wrong with the analysis, and should be nothing.

The search knows no scopes and no resolution beyond where a specifier points by itself. It asks one inverted index, words by file,
bucketed by word, and one table of the specifiers that texts hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.operators.resolve import BARREL_ENDINGS, COMPILED
from loomgraph.plans.analyses import Analysis
from loomgraph.scratch import bucketed, discard, stored

#: An import statement, over lines too: what it binds and its specifier.
_IMPORT = r"""(?m)^[ \t]*import\b([^;'"]*?)\bfrom\s*['"]([^'"\n]+)['"]|^[ \t]*import\s*['"]([^'"\n]+)['"]"""
_SPECIFIER = r"""\b(?:from|import|require)\b\s*\(?\s*['"`]([^'"`\n]+)['"`]"""
_WORD = r"[A-Za-z_$][\w$]*"
_COMMENT = r"^\s*(?://|/?\*)"
#: Names that a search can't tell apart from others.
LEAST_LETTERS = 3


def postings(files: DataFrame) -> DataFrame:
    """(word, file, lines) of ``files`` (path, content): in how many lines that are neither comments nor imports each word stands."""
    bare = F.regexp_replace("content", _IMPORT, "")
    lines = files.select(F.col("path").alias("file"), F.explode(F.split(bare, "\n")).alias("line")).where(~F.col("line").rlike(_COMMENT))
    words = lines.select("file", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(_WORD), F.lit(0)))).alias("word"))
    return words.groupBy("word", "file").agg(F.count("*").alias("lines"))


def targets(file: Column, specifier: Column) -> Column:
    """Array of the paths that a relative specifier of ``file`` may mean."""
    base = paths.normalize_path(F.concat_ws("/", F.nullif(paths.dirname(file), F.lit("")), specifier))
    plain = F.regexp_replace(base, r"\.[cm]?jsx?$", "")
    ends = [*BARREL_ENDINGS, *dict.fromkeys(f".{ts}" for _, ts in COMPILED)]
    return F.when(F.startswith(specifier, F.lit(".")), F.array_distinct(F.array(base, *[F.concat(p, F.lit(e)) for p in (base, plain) for e in ends]))).otherwise(F.array().cast("array<string>"))


def pointed(specifiers: DataFrame, files: DataFrame) -> DataFrame:
    """``specifiers`` (file, specifier, ..) with each of ``files`` (target) that they point at by themselves, by equality on whole paths or on their last step.

    A relative one names a path; a scoped one with something behind its package may mean any file that ends so.
    """
    named = specifiers.withColumn("target", F.explode(targets(F.col("file"), F.col("specifier")))).join(files, "target")
    tail = F.when(F.startswith("specifier", F.lit("@")), F.regexp_extract("specifier", r"^@[^/]+/[^/]+/(.+)$", 1))
    ended = specifiers.withColumn("tail", tail).where("tail <> ''").withColumn("last", paths.basename(F.col("tail")))
    stems = files.withColumn("last", F.regexp_replace(paths.basename(F.col("target")), r"\.tsx?$", ""))
    far = ended.join(stems, "last").where(F.col("target").rlike(r"\.tsx?$") & F.endswith(F.regexp_replace("target", r"\.tsx?$", ""), F.concat(F.lit("/"), "tail"))).drop("tail", "last")
    return named.unionByName(far.select(*named.columns))


def crosscheck(a: Analysis) -> dict[str, DataFrame]:
    """Findings that texts contradict; all three are empty if the analysis is right.

    exports (file, name, importers): unused exports that other files import from the very file that declares them; orphans (file,
    importers): orphan files that some specifier points at; imports (file, name, specifier, lines): unused imports whose name stands in other lines of
    their file. Names below ``LEAST_LETTERS`` letters and ``default`` are not searched.
    """
    u, texts = a.unused(), a.ws.files.where(~F.col("path").endswith(".html")).select("path", "content")
    index = bucketed(postings(texts), "postings", "word")
    imports = texts.select(F.col("path").alias("file"), F.explode(F.regexp_extract_all("content", F.lit(_IMPORT), F.lit(0))).alias("stmt"))
    bound = imports.select("file", F.regexp_extract("stmt", _IMPORT, 2).alias("specifier"), F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_extract("stmt", _IMPORT, 1), F.lit(_WORD), F.lit(0)))).alias("name"))
    dead = u["unused_exports"].where((F.length("name") >= LEAST_LETTERS) & (F.col("name") != "default")).select(F.col("file").alias("target"), "name")
    candidates = bound.join(dead.select("name").distinct(), "name", "left_semi")
    seen = pointed(candidates, dead.select("target").distinct()).join(dead, ["target", "name"]).where("file <> target")
    exports = seen.groupBy(F.col("target").alias("file"), "name").agg(F.countDistinct("file").alias("importers"))
    lines = texts.select(F.col("path").alias("file"), F.explode(F.split("content", "\n")).alias("line")).where(~F.col("line").rlike(_COMMENT))
    specifiers = lines.select("file", F.explode(F.regexp_extract_all("line", F.lit(_SPECIFIER), F.lit(1))).alias("specifier")).distinct()
    lost = pointed(specifiers, u["orphan_files"].select(F.col("file").alias("target"))).where("file <> target")
    orphans = lost.groupBy(F.col("target").alias("file")).agg(F.countDistinct("file").alias("importers"))
    again = u["unused_imports"].where(F.length("name") >= LEAST_LETTERS).withColumnRenamed("name", "word").join(index, ["word", "file"]).where("lines > 0").select("file", F.col("word").alias("name"), "specifier", "lines")
    out = {"exports": stored(exports.orderBy("file", "name"), "crosscheck"), "orphans": stored(orphans.orderBy("file"), "crosscheck"), "imports": stored(again.orderBy("file", "name"), "crosscheck")}
    discard(index)
    return out
