"""Product codes of vectors, their codebooks fitted over anchors-hierarchy metric trees.

A vector is cut into consecutive parts and each part named by an entry of that part position's codebook. The parts
of some thousand vectors at a time are put into a tree of balls, made middle-out: about root n
anchors each own the points nearest to them (a new anchor is the point farthest from its own and takes only from
anchors less than twice as near), balls of anchors are paired upwards by the size of what holds both, and
large anchors are cut in the same way below. A ball caches its count and sum. Assigning entries walks
the balls from the root: of the entries that a ball inherits from its parent, those that lose to the one nearest to its pivot
wherever the ball reaches are struck out, and once one is left it owns the whole ball, whose sum counts
for it at once. All coordinates are integers and distances exact, so it is the plain assignment that results.

Trees are made once, stored, and walked in each round by the tasks that read them; the only things that reach the
driver are the codebooks and, per entry, one sum and count.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import row_of, stored
from loomgraph.scratch import discard

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors whose parts share a tree, and distinct points that a ball is not cut below.
CHUNK, LEAF = 4096, 48
#: Up to this magnitude squared distances fit 64 bits; beyond it numbers are Python's.
_NARROW = 2**24
#: Magnitudes that take part; no 4-byte float comes near.
_WIDEST = 2.0**160


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(-1)


def _root(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(np.asarray(squared, float))


@dataclass
class Balls:
    """A tree of balls over the distinct points of ``points``; node 0 is the root, a leaf's children are -1.

    ``order`` lists distinct points so that each node has those from ``first`` to ``last``. ``of`` tells which of them a row is.
    """

    points: np.ndarray
    of: np.ndarray
    order: np.ndarray
    first: np.ndarray
    last: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray
    children: np.ndarray
    count: np.ndarray
    total: np.ndarray


def anchored(x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``k`` anchors among points ``ids`` and which of them owns each: the nearest, the older one in a tie."""
    anchors, owner = [ids[0]], np.zeros(len(ids), np.int64)
    near = _squares(x[ids], x[ids[0]])
    while len(anchors) < k and near.max() > 0:
        new = ids[near.argmax()]
        between = _squares(x[anchors], x[new])
        at = np.flatnonzero(4 * near > between[owner])  # no other point can be nearer to the new anchor
        far = _squares(x[ids[at]], x[new])
        won = far < near[at]
        near[at[won]], owner[at[won]] = far[won], len(anchors)
        anchors.append(new)
    return np.array(anchors), owner


def balls(rows: np.ndarray) -> Balls:
    """The tree over the distinct rows of an integer matrix."""
    if rows.dtype == object:
        named: dict[tuple, int] = {}
        of = np.array([named.setdefault(tuple(r), len(named)) for r in rows], np.int64)
        x, counts = np.array(list(named), object).reshape(len(named), rows.shape[1]), np.bincount(of)
    else:
        x, of, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        of = of.ravel()
    weighted, floats = x * counts[:, None], x.astype(float)
    made: list[tuple] = []  # (ids, pivot, radius, left, right)

    def ball(ids: np.ndarray, left: int = -1, right: int = -1) -> int:
        pivot = ids[((floats[ids] - floats[ids].mean(0)) ** 2).sum(1).argmin()]
        made.append((ids, pivot, float(_root(_squares(x[ids], x[pivot]).max())), left, right))
        return len(made) - 1

    def grown(ids: np.ndarray) -> int:
        if len(ids) <= LEAF:
            return ball(ids)
        anchors, owner = anchored(x, ids, int(np.ceil(len(ids) ** 0.5)))
        tops = [grown(ids[owner == a]) for a in range(len(anchors))]
        centre = np.array([floats[made[t][1]] for t in tops])
        radius = np.array([made[t][2] for t in tops])
        width = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(2)) + radius[:, None] + radius[None]
        np.fill_diagonal(width, np.inf)
        for _ in range(len(tops) - 1):
            a, b = divmod(int(width.argmin()), len(tops))
            both = ball(np.concatenate([made[tops[a]][0], made[tops[b]][0]]), tops[a], tops[b])
            tops[a], centre[a], radius[a] = both, floats[made[both][1]], made[both][2]
            width[b], width[:, b] = np.inf, np.inf
            alive = np.isfinite(width[a])
            reach = np.sqrt(((centre - centre[a]) ** 2).sum(1)) + radius + radius[a]
            width[a, alive], width[alive, a] = reach[alive], reach[alive]
        return both

    top = grown(np.arange(len(x)))
    node_of, order = {}, []  # children after parents, points of a node next to each other
    todo, ranges = [top], []
    while todo:
        node = todo.pop()
        node_of[node] = len(node_of)
        ranges.append((len(order), len(made[node][0])))
        if made[node][3] < 0:
            order.extend(made[node][0].tolist())
        else:
            todo += [made[node][4], made[node][3]]
    nodes = list(node_of)
    of_node = lambda n: node_of[n] if n >= 0 else -1
    first = np.array([a for a, _ in ranges])
    last = first + np.array([n for _, n in ranges])
    sums = np.concatenate([np.zeros((1, x.shape[1]), x.dtype), np.cumsum(weighted[order], 0)])
    counts = np.concatenate([[0], np.cumsum(counts[order])])
    return Balls(
        x, of, np.array(order), first, last, np.array([made[n][1] for n in nodes]), np.array([made[n][2] for n in nodes]),
        np.array([(of_node(made[n][3]), of_node(made[n][4])) for n in nodes]), counts[last] - counts[first], sums[last] - sums[first],
    )


def walked(tree: Balls, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest entry of each distinct point, the lower one in a tie; sums and counts by entry; how many balls were owned whole."""
    k = len(entries)
    apart = _root(_squares(entries[:, None], entries[None]))
    equal = np.array([[bool((a == b).all()) for b in entries] for a in entries])
    owner, sums, counts, whole = np.zeros(len(tree.points), np.int64), np.zeros_like(entries), np.zeros(k, np.int64), 0
    out = 2**62 if entries.dtype != object else 2**400
    nodes, lists = np.array([0]), (equal.argmax(1) == np.arange(k))[None]  # of equal entries only the lowest ever owns
    weights = np.bincount(tree.of, minlength=len(tree.points))
    while len(nodes):
        far = np.where(lists, _squares(tree.points[tree.pivot[nodes]][:, None], entries[None]), out)
        best = far.argmin(1)
        behind = np.asarray(far - far[np.arange(len(nodes)), best][:, None], float)
        lists = lists & ~(behind > 2 * (1 + 1e-9) * tree.radius[nodes][:, None] * apart[best])
        owned = lists.sum(1) == 1
        for node, entry in zip(nodes[owned], best[owned]):
            owner[tree.order[tree.first[node] : tree.last[node]]] = entry
            sums[entry] += tree.total[node]
            counts[entry] += tree.count[node]
            whole += 1
        leaf = ~owned & (tree.children[nodes, 0] < 0)
        if leaf.any():
            sizes = (tree.last - tree.first)[nodes[leaf]]
            points = np.concatenate([tree.order[tree.first[n] : tree.last[n]] for n in nodes[leaf]])
            among = np.repeat(lists[leaf], sizes, 0)
            owner[points] = np.where(among, _squares(tree.points[points][:, None], entries[None]), out).argmin(1)
            np.add.at(sums, owner[points], tree.points[points] * weights[points][:, None])
            np.add.at(counts, owner[points], weights[points])
        below = ~owned & ~leaf
        nodes, lists = tree.children[nodes[below]].ravel(), np.repeat(lists[below], 2, 0)
    return owner, sums, counts, whole


def _cut(numbers: list[list[float]], width: int) -> list[np.ndarray]:
    """Vectors, padded to ``width`` by zeros, as integer matrices by part."""
    x = np.zeros((len(numbers), width))
    for row, v in zip(x, numbers):
        row[: len(v)] = v
    x = np.floor(x * SCALE)
    wide = np.abs(x).max(initial=0) > _NARROW
    x = np.array([[int(c) for c in row] for row in x], object).reshape(x.shape) if wide else x.astype(np.int64)
    return np.split(x, PARTS, axis=1)


def _alike(codebook: list[np.ndarray], parts: list[Balls]) -> list[np.ndarray]:
    """Codebooks in the numbers that go with the trees': Python's if either has them."""
    wide = any(a.dtype == object for a in codebook) or any(t.points.dtype == object for t in parts)
    return [a.astype(object) if wide else a for a in codebook]


@dataclass
class Codes:
    """What ``compressed`` returns: entries by part, and the table (row, code, error)."""

    codebooks: list[np.ndarray]
    coded: DataFrame


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Fit codebooks to ``vectors`` and code them: all that take part, in 16 parts.

    Vectors that are null or hold null or non-finite components are dropped. Codebooks start as the parts of the
    ``entries`` smallest ids (nulls last, ties by the vector), or as many as there are; an entry that nothing is nearest to stays. ``coded``
    has row (all other columns of the input row), code (two hex digits a part) and error, the squared distances to
    the entries, null beyond a long. Repeated rows are coded each. Vectors count as padded by zeros to the greatest
    length and a multiple of 16; an empty table gives empty codebooks and no rows.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _WIDEST / SCALE))
    kept = vectors.where(F.col(vector_col).isNotNull()).where(F.coalesce(fine, F.lit(False))).select(row_of(vectors.drop(vector_col)).alias("row"), F.col(id_col).alias("id"), v.alias("v"))
    width = -(-(kept.agg(F.max(F.size("v"))).first()[0] or 0) // PARTS) * PARTS
    start = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    codebooks = _cut([r["v"] for r in start], width)
    row_type = kept.schema["row"].dataType.simpleString()
    if not start:
        return Codes(codebooks, kept.select("row", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")))

    def planted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), CHUNK):
                part = b.iloc[at : at + CHUNK]
                trees = [balls(x) for x in _cut(part["v"].tolist(), width)]
                yield pd.DataFrame({"rows": [part["key"].tolist()], "trees": [pickle.dumps(trees, 5)]})

    keyed = stored(kept.withColumn("key", F.monotonically_increasing_id()), "vectors")
    trees = stored(keyed.select("key", "v").mapInPandas(planted, "rows array<long>, trees binary"), "ball-trees")

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for blob in b["trees"]:
                parts = pickle.loads(blob)
                found = []
                for p, (tree, book) in enumerate(zip(parts, _alike(codebooks, parts))):
                    _, sums, counts, _ = walked(tree, book)
                    found += [(p, e, i, int(s) >> 64, int(s) & (2**64 - 1), int(counts[e])) for e in np.flatnonzero(counts) for i, s in enumerate(sums[e].tolist() or [0])]
                yield pd.DataFrame(found, columns=["part", "entry", "at", "high", "low", "n"]).astype({"high": object, "low": object}).assign(
                    high=lambda d: d["high"].map(str), low=lambda d: d["low"].map(str)
                )

    for _ in range(rounds):
        sums = trees.select("trees").mapInPandas(gathered, "part int, entry int, at int, high string, low string, n long")
        number = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        moved = [b.copy() if b.dtype == object else b.astype(object) for b in codebooks]
        for s in sums.groupBy("part", "entry", "at").agg(number("high"), number("low"), F.sum("n").alias("n")).collect():  # one row for each component of the codebooks
            if moved[s["part"]].shape[1]:
                moved[s["part"]][s["entry"], s["at"]] = ((int(s["high"]) << 64) + int(s["low"])) // s["n"]
        codebooks = [b if max((abs(c) for c in b.ravel()), default=0) > _NARROW else b.astype(np.int64) for b in moved]

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for keys, blob in zip(b["rows"], b["trees"]):
                parts = pickle.loads(blob)
                codes, errors = np.full(len(keys), "", object), np.zeros(len(keys), object)
                for tree, book in zip(parts, _alike(codebooks, parts)):
                    owner = walked(tree, book)[0]
                    away = _squares(tree.points.astype(book.dtype), book[owner]).astype(object)
                    codes, errors = codes + np.array([f"{e:02x}" for e in owner], object)[tree.of], errors + away[tree.of]
                yield pd.DataFrame({"key": keys, "code": codes, "error": pd.array([int(e) if e < 2**63 else None for e in errors], "Int64")})

    codes = trees.mapInPandas(coded, "key long, code string, error long")
    out = stored(keyed.select("key", "row").join(codes, "key").select("row", "code", "error"), "vector-codes")
    discard(trees)
    discard(keyed)
    return Codes(codebooks, out)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every vector that takes part; odd rows as in ``compressed``. Null where a sum of errors is beyond a long."""
    made = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    digest = hashlib.sha256(",".join(str(int(c)) for book in made.codebooks for c in book.ravel()).encode()).hexdigest()
    rows = made.coded.select("row.vec_id", "row.label", "code", "error")
    by_label = rows.groupBy("label").agg(F.expr("if(count(error) = count(*), try_cast(sum(cast(error as decimal(38,0))) as bigint), null)").alias("label_error"))
    rows = rows.join(by_label.withColumnRenamed("label", "same"), F.col("label").eqNullSafe(F.col("same")))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _assigned(name: str, books: str) -> str:
    """CTEs for the nearest entry of every part among ``books`` (p, e, v), and its distance."""
    return f"""{name} AS MATERIALIZED (
  SELECT id, p, v, label, min_by(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT parts.id, parts.p, parts.v, parts.label, b.e, list_sum(list_transform(list_zip(parts.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM parts JOIN {books} b USING (p)) GROUP BY ALL)"""


def _moved(name: str, old: str, owners: str) -> str:
    """CTE for the entries after a round."""
    return f"""{name} AS MATERIALIZED (
  SELECT p, e, CASE WHEN m.v IS NULL THEN old.v ELSE m.v END AS v FROM {old} old LEFT JOIN (
    SELECT p, e, list(c ORDER BY i) AS v FROM (
      SELECT p, e, i, floor(sum(v[i]) / count(*))::BIGINT AS c FROM {owners}, range(1, len(v) + 1) r(i) GROUP BY p, e, i) GROUP BY p, e) m USING (p, e))"""


#: For tables whose vectors have one length, a multiple of 16, as the driver's have.
SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT id, label, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v FROM kept, range({PARTS}) r(p)),
books0 AS MATERIALIZED (SELECT p, id - 1 AS e, v FROM parts WHERE id <= {ENTRIES}),
{_assigned("owners0", "books0")}, {_moved("books1", "books0", "owners0")},
{_assigned("owners1", "books1")}, {_moved("books2", "books1", "owners1")},
{_assigned("owners2", "books2")},
coded AS (SELECT id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM owners2 GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY coded.label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM books2) AS codebooks_sha256
FROM coded JOIN kept USING (id)
"""

QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLES = {"op13_vector_codes": SQL}
