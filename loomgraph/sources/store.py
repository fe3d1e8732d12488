"""What was read off files, kept between runs by their content: only files that changed are lexed again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomgraph.scratch import stored
from loomgraph.sources import scripts

#: Raise it when ``scripts.split_statements`` changes what it returns.
VERSION = 2
_SCHEMA = "path string, hash string, all array<string>, took_us long"


class FactStore:
    """Statements of files by (path, hash of the content) in a folder that all can read.

    A run appends a generation with the files that no generation has as they are now; a generation counts once Spark
    has committed it, so a run that ends early leaves nothing behind that is read. Rows of changed or deleted files are passed
    over, and once they are more than the others all that counts is written as one generation and the rest goes.
    ``lexed`` tells how many files the last run had to lex.
    """

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location, self.lexed = spark, f"{location.rstrip('/')}/v{VERSION}", None

    def _folder(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.location)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def generations(self) -> list[str]:
        """Folders that are written to the end."""
        fs, top = self._folder()
        if not fs.exists(top):
            return []
        found = [s.getPath() for s in fs.listStatus(top) if s.isDirectory()]
        return sorted(str(p) for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _write(self, df: DataFrame) -> str:
        path = f"{self.location}/generation-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def statements(self, files: DataFrame) -> DataFrame:
        """(path, all, took_us) of ``files`` (path, content), as ``scripts.lexed`` gives them; times are those of when a file was lexed."""
        hashed = files.select("path", "content", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("hash"))
        now = stored(hashed.select("path", "hash").distinct(), "store-now")
        old = self.generations()
        known = self.spark.read.schema(_SCHEMA).parquet(*old) if old else self.spark.createDataFrame([], _SCHEMA)
        missing = hashed.join(known.select("path", "hash"), ["path", "hash"], "left_anti")
        seen = Observation()
        fresh = stored(scripts.lexed(missing.select("path", "content", "hash"), "hash").observe(seen, F.count("*").alias("n")), "store-fresh")
        self.lexed = seen.get["n"]
        kept = known.join(now, ["path", "hash"], "left_semi").dropDuplicates(["path", "hash"])
        if self.lexed:
            self._write(fresh)
        held, wanted = known.count() + self.lexed, now.count()
        if held > 2 * wanted:
            whole = self._write(kept.unionByName(fresh))
            fs, _ = self._folder()
            for path in self.generations():
                if not path.endswith(whole.rsplit("/", 1)[-1]):
                    fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
            return self.spark.read.schema(_SCHEMA).parquet(whole).select("path", "all", "took_us")
        return kept.unionByName(fresh).select("path", "all", "took_us")
