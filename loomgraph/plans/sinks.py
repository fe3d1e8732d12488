"""Results as documents without gathering them: rows are made into text by tasks and pass the driver one partition at a time, or not at all."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(df: DataFrame) -> Iterator[str]:
    """The rows of a DataFrame of one text column, in order; a partition is held at a time."""
    return (r[0] for r in df.toLocalIterator(prefetchPartitions=True))


def json_rows(df: DataFrame) -> Iterator[str]:
    """Rows as JSON, written by tasks; fields that are null are left out."""
    return lines(df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))) if df.columns else iter(())


def write_json(out: IO[str], part: DataFrame | dict | list | str | int | float | bool | Iterable | None) -> None:
    """A nest of dicts with DataFrames, iterators of JSON texts or plain values as one JSON document."""
    if isinstance(part, dict):
        out.write("{")
        for i, (name, value) in enumerate(part.items()):
            out.write(("," if i else "") + "\n" + json.dumps(name) + ": ")
            write_json(out, value)
        out.write("}")
    elif isinstance(part, DataFrame | Iterator):
        out.write("[")
        for i, row in enumerate(json_rows(part) if isinstance(part, DataFrame) else part):
            out.write(("," if i else "") + "\n" + row)
        out.write("]")
    else:
        out.write(json.dumps(part))


def write_parts(df: DataFrame, path: str, *order: str) -> None:
    """``df`` in ``order`` as JSON lines in a folder, one part a range, and a manifest of the parts with their rows and bounds.

    Parts read one after the other are the whole in order; nothing but the manifest's rows passes the driver, one for each part.
    """
    spark = df.sparkSession
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.json(path)
    bounds = [f(F.struct(*order)).alias(n) for f, n in ((F.min, "first"), (F.max, "last"))]
    parts = spark.read.schema(df.schema).json(path).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("part")).agg(F.count("*").alias("rows"), *bounds)
    parts.orderBy("part").coalesce(1).write.json(f"{path}/_manifest")


def read_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_parts`` wrote."""
    return spark.read.schema(schema).json(path)


def write_keys(keys: DataFrame, path: str) -> None:
    """Sorted ``keys`` (key): one document {"findings": [..]} at a path that ends in .json, else a folder of parts."""
    if path.endswith(".json"):
        with Path(path).open("w") as out:
            write_json(out, {"findings": lines(keys.orderBy("key").select(F.to_json(F.array("key")).substr(F.lit(2), F.length(F.to_json(F.array("key"))) - 2)))})
    else:
        write_parts(keys.select("key"), path, "key")


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """(key) of what ``write_keys`` wrote, read by tasks."""
    if path.endswith(".json"):
        document = spark.read.schema("findings array<string>, broken string").option("multiLine", "true").option("columnNameOfCorruptRecord", "broken").json(path)
        if not document.where("broken is not null or findings is null").isEmpty():
            raise ValueError(f"{path} holds no findings")
        return document.select(F.explode("findings").alias("key"))
    return read_parts(spark, path, "key string")
