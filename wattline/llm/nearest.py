"""Nearest vectors by inner product through low-dimensional stable projections and a kd-tree.

Inner products become distances: with M the largest norm, a vector x gets the extra coordinate sqrt(M^2 - |x|^2) and a
query the extra coordinate 0, so that the nearest point has the largest product. Gaussian projections to a few
dimensions are 2-stable: the squared projected distance over the squared true distance is chi-square distributed. Points
are therefore visited in order of their projected distance and verified exactly, until the chi-square probability that a
point nearer than the worst one kept lies beyond the reached projected distance falls below 1 - `sure`.

On Spark: the upper levels of the kd-tree are cut on a bounded sample and deal all points to cells of bounded size; a
cell has a kd-tree of its own for each task that searches it. Every query first searches its nearest cells, which gives a
bound; then it goes to all other cells whose projected box does not pass the stopping test, and each of them is searched
with the same test and returns what reaches the bound. Equal vectors are one point, of which only the `k` + 1 smallest ids can matter.

Defined results: vectors that are null, zero, or hold null or non-finite components, and those whose length is not the
most frequent one (the larger of equals), take no part, as queries or as candidates; so do null ids. Repeated rows are
one vector; of different vectors under one id the smallest, compared component by component, takes part. Components so large
that a squared length overflows are scaled by a power of two for the search, and the scores scaled back; a score beyond the
range of doubles is infinite. A query gets fewer than `k` rows if there are fewer candidates; ties go to the smaller id. Other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.session import materialize

K = 20
PROJECTIONS = 8
SURE = 0.98
SAMPLE = 20_000
CELL_ROWS = 1024
MOST_CELLS = 2048
LEAF = 32
FIRST_CELLS = 4
SLOT_QUERIES = 20_000
_LONGEST = 2.0 ** 510  # a longer vector's squared distances may leave the range of doubles
_SAFE_EXPONENT = 480
_FOUND = "query long, point long, score double"


def chi_square_cdf(x: np.ndarray, degrees: int) -> np.ndarray:
    """P(chi-square <= x) for an even number of degrees of freedom."""
    half = np.minimum(x / 2, 700.0)
    term, total = np.ones_like(half), np.ones_like(half)
    for j in range(1, degrees // 2):
        term = term * half / j
        total = total + term
    return 1 - np.exp(-half) * total


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part, as doubles and once each."""
    value = F.transform("embedding", lambda x: x.cast("double"))
    whole = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0").select("vec_id", value.alias("embedding"))
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), F.lit(False)))
    kept = whole.where(fine & F.exists("embedding", lambda x: x != 0))
    sizes = kept.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    size = sizes[0]["n"] if sizes else 0
    # of several vectors under one id the smallest by its components, whatever the partitioning
    return kept.where(F.size("embedding") == size).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


class Tree:
    """A complete kd-tree: each level cuts every node at the median of its widest coordinate."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.cut = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        groups = [np.arange(len(points))]
        for level in range(depth):
            below = []
            for i, rows in enumerate(groups):
                node = (1 << level) - 1 + i
                if len(rows):
                    spread = np.ptp(points[rows], axis=0)
                    self.axis[node] = int(spread.argmax())
                    self.cut[node] = np.median(points[rows, self.axis[node]])
                right = points[rows, self.axis[node]] > self.cut[node]
                below += [rows[~right], rows[right]]
            groups = below

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - ((1 << self.depth) - 1)


def box_distances(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of every query to every box."""
    out = np.zeros((len(queries), len(low)))
    for d in range(queries.shape[1]):
        q = queries[:, d:d + 1]
        out += np.maximum(np.maximum(low[:, d] - q, q - high[:, d]), 0) ** 2
    return out


class Space:
    """The seeded projection and the extra coordinate."""

    def __init__(self, size: int, longest: float, projections: int = PROJECTIONS, seed: int = 11):
        self.size, self.longest, self.projections = size, longest, projections
        self.matrix = np.random.default_rng(seed).standard_normal((size + 1, projections))

    def points(self, rows: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.longest ** 2 - (rows * rows).sum(1), 0))
        return rows @ self.matrix[:-1] + extra[:, None] * self.matrix[-1]

    def queries(self, rows: np.ndarray) -> np.ndarray:
        return rows @ self.matrix[:-1]

    def squared(self, rows: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Squared distances that belong to inner products of these queries."""
        norm = (rows * rows).sum(1)
        return np.maximum(norm.reshape(-1, *[1] * (scores.ndim - 1)) + self.longest ** 2 - 2 * scores, 0)


def _rows(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def search_cell(space: Space, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, bound: np.ndarray, keep: int,
                sure: float = SURE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, id, score) of the best `keep` of the cell for each query, as far as they reach its given bound.

    Leaves are visited in order of their projected distance; a query stops once the test holds for its next leaf.
    """
    projected = space.points(rows)
    tree = Tree(projected, max(0, math.ceil(math.log2(max(1, len(rows) / LEAF)))))
    cell = tree.cells(projected)
    order = np.argsort(cell, kind="stable")
    leaves = np.split(order, np.flatnonzero(np.diff(cell[order])) + 1)
    low = np.array([projected[x].min(0) for x in leaves])
    high = np.array([projected[x].max(0) for x in leaves])
    far = box_distances(space.queries(queries), low, high)
    turn = np.argsort(far, axis=1, kind="stable")
    best_id = np.full((len(queries), keep), -1, np.int64)
    best = np.full((len(queries), keep), -np.inf)
    active = np.arange(len(queries))
    for step in range(len(leaves)):
        leaf = turn[active, step]
        worst = np.maximum(best[active, -1], bound[active])
        reach = space.squared(queries[active], worst)
        ratio = np.divide(far[active, leaf], reach, out=np.full(len(active), np.inf), where=reach > 0)
        ratio[np.isneginf(worst)] = 0
        go = chi_square_cdf(ratio, space.projections) < sure
        go |= far[active, leaf] <= 0
        active, leaf = active[go], leaf[go]
        if not len(active):
            break
        by = np.argsort(leaf, kind="stable")
        for group in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
            who, members = active[group], leaves[leaf[group[0]]]
            scores = queries[who] @ rows[members].T
            all_scores = np.concatenate([best[who], scores], 1)
            all_ids = np.concatenate([best_id[who], np.broadcast_to(ids[members], scores.shape)], 1)
            top = np.lexsort((all_ids, -all_scores), axis=1)[:, :keep]  # ties go to the smaller id
            best[who] = np.take_along_axis(all_scores, top, 1)
            best_id[who] = np.take_along_axis(all_ids, top, 1)
    # what is below the bound cannot be among the best; the slack covers other orders of summation
    place, at = np.nonzero(np.isfinite(best) & (best >= (bound - 1e-9 * (1 + np.abs(bound)))[:, None]))
    found = best_id[place, at]
    by_id = np.argsort(ids)
    chosen = rows[by_id[np.searchsorted(ids[by_id], found)]]
    return place, found, (queries[place] * chosen).sum(1)  # one order of summation for every pair


def search(vectors: DataFrame, is_query: Column, k: int = K, sure: float = SURE, projections: int = PROJECTIONS,
           cell_rows: int = CELL_ROWS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score of the `k` best found for every vector that `is_query` (over vec_id) selects."""
    spark = vectors.sparkSession
    clean = materialize(usable(vectors), "vectors")
    same = Window.partitionBy("embedding").orderBy("vec_id")
    members = clean.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    members = materialize(members.withColumn("point", F.min("vec_id").over(
        same.rowsBetween(Window.unboundedPreceding, Window.currentRow))), "vector-members")
    points = members.where("place = 1").select("point", "embedding")
    asked = clean.where(is_query).groupBy("embedding").agg(F.min("vec_id").alias("query")).select("query", "embedding")
    asked = materialize(asked, "vector-queries")

    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    facts = points.agg(F.count("*").alias("n"), F.max(norm).alias("longest"), F.max(F.size("embedding")).alias("size")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if facts["longest"] > _LONGEST:
        largest = points.agg(F.max(F.array_max(F.transform("embedding", F.abs)))).first()[0]
        factor = 2.0 ** (_SAFE_EXPONENT - math.frexp(largest)[1] - facts["size"].bit_length())
        scaled = clean.withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(factor)))
        found = search(scaled, is_query, k, sure, projections, cell_rows, sample)
        return found.withColumn("score", F.col("score") / F.lit(factor) / F.lit(factor))
    space = Space(facts["size"], facts["longest"], projections)
    drawn = points.orderBy(F.xxhash64("point"), "point").limit(sample).select("embedding").toArrow()
    depth = min(math.ceil(math.log2(max(1, facts["n"] / cell_rows))), int(math.log2(MOST_CELLS)))
    tree = Tree(space.points(_rows(drawn.column("embedding"), space.size)), depth)

    names = [f"p{i}" for i in range(projections)]

    def place(batches):
        for batch in batches:
            rows = _rows(batch.column("embedding"), space.size)
            at = space.points(rows)
            yield pa.RecordBatch.from_arrays([batch.column("point"), batch.column("embedding"), pa.array(tree.cells(at)),
                                              *[pa.array(np.ascontiguousarray(at[:, i])) for i in range(projections)]],
                                             names=["point", "embedding", "cell", *names])

    placed = materialize(points.mapInArrow(place, "point long, embedding array<double>, cell long, " + ", ".join(
        f"{n} double" for n in names)), "vector-cells")
    boxes = placed.groupBy("cell").agg(*[F.min(n).alias(f"low_{n}") for n in names], *[F.max(n).alias(f"high_{n}") for n in names])
    boxes = boxes.orderBy("cell").toArrow()  # at most MOST_CELLS rows
    cell_ids = boxes.column("cell").to_numpy()
    low = np.stack([boxes.column(f"low_{n}").to_numpy() for n in names], 1)
    high = np.stack([boxes.column(f"high_{n}").to_numpy() for n in names], 1)
    slots = max(1, math.ceil(asked.count() / SLOT_QUERIES))

    def visit(first: bool):
        def work(batches):
            for batch in batches:
                rows = _rows(batch.column("embedding"), space.size)
                ids = batch.column("query").to_numpy()
                far = box_distances(space.queries(rows), low, high)
                near = np.argsort(far, axis=1, kind="stable")[:, :FIRST_CELLS]
                if first:
                    go = np.zeros(far.shape, bool)
                    np.put_along_axis(go, near, True, axis=1)
                    worst = np.full(len(rows), -np.inf)
                else:
                    worst = batch.column("worst").to_numpy()
                    reach = space.squared(rows, worst)[:, None]
                    ratio = np.where(reach > 0, far / np.maximum(reach, 1e-300), np.inf)
                    go = (chi_square_cdf(ratio, projections) < sure) | (far <= 0) | np.isneginf(worst)[:, None]
                    np.put_along_axis(go, near, False, axis=1)
                q, c = np.nonzero(go)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[q]), batch.column("embedding").take(pa.array(q)), pa.array(worst[q]), pa.array(cell_ids[c]),
                    pa.array(ids[q] % slots)], names=["query", "embedding", "worst", "cell", "slot"])
        return work

    spread = placed.select("point", "embedding", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot"))

    def found(visits: DataFrame) -> DataFrame:
        def work(key, left, right):
            if not len(left) or not len(right):
                return pa.table({"query": pa.array([], pa.int64()), "point": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            asked_ids = right.column("query").to_numpy()
            at, ids, scores = search_cell(space, left.column("point").to_numpy(), _rows(left.column("embedding"), space.size),
                                          _rows(right.column("embedding"), space.size), right.column("worst").to_numpy(), k + 1, sure)
            return pa.table({"query": asked_ids[at], "point": ids, "score": scores})

        return spread.groupBy("cell", "slot").cogroup(visits.groupBy("cell", "slot")).applyInArrow(work, _FOUND)

    visits_schema = "query long, embedding array<double>, worst double, cell long, slot long"
    home = materialize(found(asked.mapInArrow(visit(True), visits_schema)), "vector-home")
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    leading = home.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k + 1)
    bound = leading.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    known = asked.join(bound, "query", "left").select("query", "embedding", F.when(
        F.col("n") > k, F.col("low")).otherwise(F.lit(-math.inf)).alias("worst"))
    rest = found(known.mapInArrow(visit(False), visits_schema))
    best = home.unionByName(rest).withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k + 1)

    listed = best.select("query", "point", "score").join(members.select("point", "vec_id"), "point")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    short = materialize(listed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1), "vector-best")
    classes = clean.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding").join(asked, "embedding").select("query_id", "query")
    own = classes.join(short.select("query", "vec_id", "score"), "query").where("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return own.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
