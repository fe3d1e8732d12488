"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate, its target share of the corpus over its actual share. Each
document draws how often it is repeated from the Poisson distribution of that mean, by inverting the
distribution at a uniform number that a hash of its id gives: the draw needs no state, any lost task
repeats it, and a source meets its target on average however its documents are spread. Copies are
then put into one global order by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import own_columns, row_of, stored

TEMPERATURE = 0.5
SEED = 17
#: Rates beyond this are drawn as a sum of parts of at most this mean, so that exp(-mean) never underflows.
_PART = 16.0
_TERMS = 80  # P(more than 80 at mean 16) is below 1e-30


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def _poisson(u: Column, mean: Column) -> Column:
    """The smallest n whose cumulated Poisson probability exceeds ``u``; ``mean`` is at most ``_PART``."""
    start = F.struct(F.lit(0).alias("n"), F.exp(-mean).alias("term"), F.exp(-mean).alias("sum"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * mean / k
        return F.when(s["sum"] > u, s).otherwise(F.struct((s["n"] + 1).alias("n"), term.alias("term"), (s["sum"] + term).alias("sum")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), start, step, lambda s: s["n"])


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(source_key, rate) by source: target share over actual share of the corpus.

    A document's size is its code points plus one. ``weights`` gives target shares, scaled to sum to
    one over the sources present (a source that it lacks gets rate 0); by default a source's share is
    its size to the power ``temperature``, so that a hot source weighs less than its size.
    """
    size = F.char_length(F.coalesce("text", F.lit(""))).cast("long") + 1
    by_source = docs.groupBy(source_key("source").alias("source_key")).agg(F.sum(size).alias("size"))
    if weights is None:
        wanted = F.pow(F.col("size").cast("double"), F.lit(temperature))
    else:
        known = docs.sparkSession.createDataFrame([("null" if s is None else f"s{s}", float(w)) for s, w in weights.items()], "source_key string, weight double")
        by_source = by_source.join(known, "source_key", "left")
        wanted = F.coalesce("weight", F.lit(0.0))
    by_source = stored(by_source.withColumn("wanted", wanted), "sources")
    total = by_source.agg(F.sum(F.col("size").cast("double")).alias("all_size"), F.sum("wanted").alias("all_wanted"))
    share = F.col("wanted") / F.nullif("all_wanted", F.lit(0.0))
    return by_source.crossJoin(F.broadcast(total)).select("source_key", F.coalesce(share * F.col("all_size") / F.col("size"), F.lit(0.0)).alias("rate"))


def source_key(source: str) -> Column:
    """A source as a join key that a null has too."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("null"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED, broadcast_sources: int = 50_000) -> DataFrame:
    """Documents replicated towards the target weights, in one global random order.

    Returns the documents' columns, each document as many times as drawn, none included, with
    mix_copy (0 and up), mix_rate and mix_order, which replace columns of these names. A null source is a source of its own. Rows that share
    an id share a draw; null ids draw as one id. The rates are broadcast where there are at most
    ``broadcast_sources`` sources and joined by a shuffle where there are more. Empty in, empty out.
    """
    by_source = stored(rates(docs, weights, temperature), "rates")
    by_source = by_source.select(F.col("source_key"), F.col("rate"))
    if by_source.count() <= broadcast_sources:
        by_source = F.broadcast(by_source)
    rated = docs.select(row_of(docs).alias("row"), source_key("source").alias("source_key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc")).join(by_source, "source_key")
    doc, rate = F.col("doc"), F.col("rate")
    parts = F.greatest(F.lit(1), F.ceil(rate / _PART).cast("int"))
    drawn = F.aggregate(
        F.sequence(F.lit(1), parts), F.lit(0),
        lambda n, i: n + _poisson(_uniform(doc, i, F.lit(seed)), rate / parts),
    )
    copies = rated.withColumn("n", drawn).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    order = F.md5(F.concat_ws(":", doc, F.col("copy").cast("string"), F.lit(f"order{seed}")))
    return copies.select(*own_columns(docs, mix_copy=F.col("copy"), mix_rate=rate, mix_order=order)).orderBy("mix_order")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document that the mix draws, in the mix's order.

    Null texts count as empty, a null source is a source, null ids draw as one id and rows of one id share a draw; copies that tie
    in the order's hash may come either way. Empty in, empty out.
    """
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", F.col("mix_copy").alias("copy"), F.round("mix_rate", 6).alias("rate"), "mix_order")


def mix_sql(documents: str, extra: str = "") -> str:
    """DuckDB SQL for ``mix`` with default weights over a table; ``extra`` names more columns to keep."""
    return f"""
    docs AS (SELECT *, row_number() OVER () AS row_id, coalesce('s' || source, 'null') AS source_key, coalesce(doc_id::VARCHAR, 'null') AS id_text FROM {documents}),
    by_source AS (SELECT source_key, sum(length(coalesce(text, '')) + 1)::DOUBLE AS size, pow(sum(length(coalesce(text, '')) + 1)::DOUBLE, {TEMPERATURE}) AS wanted FROM docs GROUP BY 1),
    rates AS (SELECT source_key, wanted / sum(wanted) OVER () * sum(size) OVER () / size AS rate FROM by_source),
    parts AS (
      SELECT docs.*, rate, i, rate / greatest(1, ceil(rate / {_PART})) AS mean,
             ('0x' || substr(md5(id_text || ':' || i || ':{SEED}'), 1, 13))::BIGINT::DOUBLE / {2.0**52!r} AS u
      FROM docs JOIN rates USING (source_key), range(1, 1 + greatest(1, ceil(rate / {_PART}))::BIGINT) r(i)),
    draws AS (
      SELECT * EXCLUDE (i, mean, u),
             list_reduce(list_prepend({{n: 0::BIGINT, k: 0::BIGINT, term: exp(-mean), total: exp(-mean), u: u, mean: mean}},
               list_transform(range(1, {_TERMS} + 1), lambda k: {{n: 0::BIGINT, k: k, term: 0::DOUBLE, total: 0::DOUBLE, u: 0::DOUBLE, mean: 0::DOUBLE}})),
               lambda s, x: CASE WHEN s.total > s.u THEN s
                 ELSE {{n: s.n + 1, k: x.k, term: s.term * s.mean / x.k, total: s.total + s.term * s.mean / x.k, u: s.u, mean: s.mean}} END).n AS n
      FROM parts),
    counted AS (SELECT row_id, doc_id, source, {extra} id_text, rate, sum(n)::BIGINT AS n FROM draws GROUP BY ALL),
    mixed AS (SELECT doc_id, source, {extra} copy::INTEGER AS mix_copy, rate AS mix_rate, md5(id_text || ':' || copy || ':order{SEED}') AS mix_order
              FROM counted, range(0, n) c(copy))
    """


QUERIES = {"op10_mixing": op10_mixing}
ORACLES = {"op10_mixing": "WITH " + mix_sql("documents") + " SELECT doc_id, source, mix_copy AS copy, round(mix_rate, 6) AS rate, mix_order FROM mixed"}
