"""Links within groups of candidates: none is lost, and few pairs are written."""

from pyspark.sql import functions as F

from loomgraph.llm import families


def test_linked_groups_lose_no_link_and_write_few_pairs(spark, monkeypatch):
    """A dense group in which all are alike, a chain, and strangers, nothing linked yet; members are dealt out to several tasks."""
    monkeypatch.setattr(families, "DEALT", 64)
    dense = [(1, i, 0) for i in range(600)]
    chain = [(2, 1000 + i, 10 * i) for i in range(40)]
    strangers = [(1, 2000 + i, 100_000 * (i + 1)) for i in range(20)]
    rows = dense + chain + strangers
    groups = spark.createDataFrame([(g, i) for g, i, _ in rows], "g long, id long")
    sketch = spark.createDataFrame([(i, x) for _, i, x in rows], "id long, p0 long")
    written = []

    def verified(pairs):
        written.append(pairs.count())
        return pairs

    may = lambda other: F.abs(F.col("p0") - F.col(f"{other}p0")) <= 10
    found = families.linked(groups, spark.createDataFrame([], "id long, root long"), sketch, may, verified, "toy")
    found = {r["id"]: r["root"] for r in found.collect()}
    assert {found.get(i, i) for _, i, _ in dense} == {0}
    assert {found.get(i, i) for _, i, _ in chain} == {1000}
    assert all(found.get(i, i) == i for _, i, _ in strangers)
    assert sum(written) < 10 * len(rows)


def test_packed_fingerprints_are_alike_as_digits_are(spark):
    import numpy as np

    from loomgraph.llm import fingerprints

    rng = np.random.default_rng(5)
    base = rng.integers(0, 16, (1, fingerprints.SLOTS), np.uint8)
    digits = np.repeat(base, 64, 0)
    for i in range(64):
        at = rng.permutation(fingerprints.SLOTS)[:i]
        digits[i, at] = (digits[i, at] + rng.integers(1, 16, len(at))) % 16
    prints = spark.createDataFrame(list(enumerate(fingerprints.as_hex(digits))), "id long, fingerprint string")
    sketch = fingerprints.packed(prints)
    other = sketch.select(*[F.col(c).alias(f"b_{c}") for c in sketch.columns])
    for least in (0.8, 0.5, 0.0):
        kept = {(r["id"], r["b_id"]) for r in sketch.join(other, F.col("id") < F.col("b_id")).where(fingerprints.at_least(least, "b_")).collect()}
        want = {(i, j) for i in range(64) for j in range(i + 1, 64) if fingerprints.alike(digits[i][None], digits[j][None])[0] >= least}
        assert kept == want, least
