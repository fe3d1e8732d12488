"""License scans by diagonal voting.

Every rolling word k-gram of every whole text is joined, by hash, to its positions in a small set of
license templates. Hits of a document and template vote for an offset diagonal (position in the text
less position in the template), which is a place: all its hits lie within the template's length. A
diagonal merges with its neighbours, apart by a few inserted or lost words, whatever votes lie elsewhere, and
the span is verified by aligning: as many of the template's k-grams as are in it in the template's order
count. Of neighbouring diagonals the one that explains most gives the span. Hits are compared word by
word, so a hash collision gives none.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases whose words must stand consecutively, and the label each gives.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices and the label each gives. Those of ``SHORT`` k-grams or more may be found with a few words
#: inserted, changed or lost; in shorter ones, such as those with a version, every word counts.
SHORT = 8
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("gnu general public license version 2", "gpl-2.0"),
    ("gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("cc by nc 4 0", "cc-by-nc-4.0"),
    ("cc by sa 4 0", "cc-by-sa-4.0"),
    ("cc by 4 0", "cc-by-4.0"),
    ("this work is licensed under a creative commons attribution", "cc"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished"
        " to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "mit",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org"
        " licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions"
        " of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache-2.0",
    ),
    (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright"
        " notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd",
    ),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights", "cc0"),
)


def words_of(text: Column) -> Column:
    """The text's words, with A-Z lower-cased and nothing else; no words for a null."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(F.coalesce(lowered, F.lit("")), F.lit(WORD), F.lit(0))


def templates(spark: SparkSession, base=BASE, notices=NOTICES, k: int = 2) -> DataFrame:
    """The templates' k-grams: one row each, as many as the templates have words, whatever the corpus."""
    rows = []
    for number, (phrase, label) in enumerate([*base, *notices]):
        words = re.findall(WORD, phrase)
        grams = len(words) - k + 1
        rows += [(number, label, number < len(base), grams, at, words[at : at + k]) for at in range(grams)]
    t = spark.createDataFrame(rows, "template int, label string, is_base boolean, grams int, at int, gram array<string>")
    return t.withColumn("hash", F.xxhash64(*[F.col("gram")[i] for i in range(k)]))


def _in_order(hits: str, grams: Column) -> Column:
    """How many of ``hits`` (pos, less), sorted, can stand in order: positions and template positions (-less) both ascending.

    The state holds, for each template position, the longest chain that ends there or before.
    """

    def step(longest: Column, hit: Column) -> Column:
        chain = F.when(hit["less"] == 0, F.lit(1)).otherwise(F.get(longest, -hit["less"] - 1) + 1)
        return F.transform(longest, lambda n, at: F.when(at >= -hit["less"], F.greatest(n, chain)).otherwise(n))

    return F.aggregate(hits, F.array_repeat(F.lit(0), grams), step, lambda longest: F.element_at(longest, -1))


def spans(docs: DataFrame, k: int = 2, drift: int = 3, covered: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified license spans, one array per document.

    Returns id, copies (rows that share this id and text), n_words, and spans: an array of (label,
    is_base, first, last, coverage), ``first`` and ``last`` being the span's word positions.
    ``drift`` is how far from a span's diagonal others may lie that merge with it, ``covered`` the share of
    a long template's k-grams that a span needs in order; base phrases need all of them on one diagonal.
    Null and empty texts have no words; rows with the same id and text are one document with copies,
    rows with the same id and other texts are documents of their own; other columns are ignored.
    """
    small = F.broadcast(templates(docs.sparkSession, k=k).repartition(1))
    text = F.coalesce(F.col(text_col), F.lit(""))
    tokens = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), words_of(text).alias("words"))
    places = tokens.select("id", "text_hash", "words", F.explode(F.sequence(F.lit(-1), F.greatest(F.lit(-1), F.size("words") - k))).alias("pos"))
    gram = [F.get("words", F.col("pos") + i) for i in range(k)]
    places = places.select(
        "id", "text_hash", F.size("words").cast("long").alias("n_words"), "pos",
        F.when(F.col("pos") >= 0, F.xxhash64(*gram)).alias("hash"), F.when(F.col("pos") >= 0, F.array(*gram)).alias("found"),
    )
    hits = places.join(small, "hash", "left").where("pos < 0 or found = gram")
    hits = hits.select("id", "text_hash", "n_words", "template", "label", "is_base", "grams", "at", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))
    hits = hits.repartition("id", "text_hash")  # all that follows is grouped by document first: one exchange
    doc = ["id", "text_hash"]
    votes = hits.groupBy(*doc, "template", "diagonal").agg(
        F.first("n_words").alias("n_words"), F.first("label").alias("label"), F.first("is_base").alias("is_base"), F.first("grams").alias("grams"),
        F.collect_set("at").alias("at"), F.sum((F.col("pos") < 0).cast("long")).alias("copies"),
    )
    exact = F.col("is_base") | (F.col("grams") < SHORT)
    needed = F.when(exact, F.col("grams")).otherwise(F.ceil(F.lit(covered) * F.col("grams")))
    around = lambda far: Window.partitionBy(*doc, "template").orderBy("diagonal").rangeBetween(-far, far)
    n_around = F.when(F.col("is_base"), F.size("at")).otherwise(F.sum(F.size("at")).over(around(2 * drift)))
    votes = votes.withColumn("hopeful", F.coalesce(n_around >= needed, F.lit(False)))  # all that a span with enough votes may merge
    near = F.when(F.col("hopeful") & ~F.col("is_base"), F.flatten(F.collect_list(F.when(F.col("hopeful"), F.transform("at", lambda at: F.struct((F.col("diagonal") + at).alias("pos"), (-at).alias("less"))))).over(around(drift))))
    own = F.transform("at", lambda at: F.struct((F.col("diagonal") + at).alias("pos"), (-at).alias("less")))
    merged = votes.withColumn("hits", F.when(F.col("hopeful"), F.array_sort(F.coalesce(near, own)))).withColumn("in_order", F.when(F.col("hopeful"), _in_order("hits", F.col("grams"))))
    rank = F.struct("in_order", (-F.col("diagonal")).alias("less"))
    best = F.col("is_base") | F.max(rank).over(around(drift)).eqNullSafe(rank)
    merged = merged.withColumn("best", F.coalesce(best, F.lit(False)))
    coverage = F.col("in_order") / F.col("grams")
    verified = F.col("hopeful") & F.col("best") & (F.col("in_order") >= needed)
    span = F.struct(
        "label", "is_base", F.element_at("hits", 1)["pos"].cast("long").alias("first"),
        (F.element_at("hits", -1)["pos"] + k - 1).cast("long").alias("last"), coverage.alias("coverage"),
    )
    found = merged.groupBy(*doc).agg(
        F.max("n_words").alias("n_words"), F.max("copies").alias("copies"),
        F.array_sort(F.collect_list(F.when(verified, span))).alias("spans"),
    )
    return found.drop("text_hash")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document: base phrases and their places, and labels of all templates.

    Null and empty texts have no words, no places and score 0; repeated rows repeat their result, null ids stay; of
    places that tie all count. Texts are read whole; empty in, empty out; other columns are ignored.
    """
    found = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s.is_base)
    starts = F.transform(base, lambda s: s.first)
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda s: s.label))), ",")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        F.col("id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s.coverage)), F.lit(0.0)).alias("score"),
    )


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLES: dict[str, str] = {}
