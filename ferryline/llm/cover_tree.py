"""Exact top-k inner products by dual-tree search over cover trees.

Rows are dealt into blocks of bounded size around pivots; each block gets a cover
tree, queries and data alike.  No product of a query below one node and a row
below another can exceed <p, q> + |p| s + |q| r + r s (centres p and q, covering
radii r and s).  A pair of nodes whose bound is below the worst k-th score of the
node's queries is left out, for pairs of blocks before their trees are moved, then
inside the trees.  Queries start from their k-th score in a bounded sample, which
is a lower bound of the true one.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferryline.session import materialize

K = 20
SCALE = 64
MOST = 1 << 24  # components from here on would not multiply exactly
BLOCK = 4_096
QUERY_BLOCK = 512
SAMPLE = 1_024  # rows that pivots and first scores come from
LEAF = 48
BASE = 1.4  # radii shrink at least by this from a node to its children


class CoverTree:
    """Nodes as (centre, radius, children, rows): inner nodes have children, leaves have rows."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.ids, self.points = ids, points.astype(np.float64)
        self.nodes: list[tuple[int, float, list[int], np.ndarray]] = []
        rows = np.arange(len(ids))
        self.root = self._grow(rows, 0, self._far(rows, 0)) if len(ids) else -1
        self.norms = np.sqrt((self.points**2).sum(axis=1))

    def _far(self, rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[centre]) ** 2).sum(axis=1))

    def _add(self, centre, radius, children, rows) -> int:
        self.nodes.append((centre, radius, children, rows))
        return len(self.nodes) - 1

    def _grow(self, rows: np.ndarray, centre: int, far: np.ndarray) -> int:
        """A node over `rows`, at distances `far` from the centre; its children cover them within radius / BASE."""
        radius = float(far.max())
        if len(rows) <= LEAF or radius == 0:
            return self._add(centre, radius, [], rows)
        children, single, reach = [], [], radius / BASE
        left, near = rows, far <= reach
        at, dist = centre, far
        while True:
            own = left[near]
            if len(own) > LEAF // 2:
                children.append(self._grow(own, at, dist[near]))
            else:  # small children share leaves
                single.append(own)
            left = left[~near]
            if not len(left):
                break
            at = int(left[0])
            dist = self._far(left, at)
            near = dist <= reach
        rest = np.concatenate(single) if single else rows[:0]
        for a in range(0, len(rest), LEAF):
            part = rest[a : a + LEAF]
            dist = self._far(part, int(part[0]))
            children.append(self._add(int(part[0]), float(dist.max()), [], part))
        return self._add(centre, radius, children, rows[:0])

    def rows_below(self, node: int) -> np.ndarray:
        _, _, children, rows = self.nodes[node]
        return np.concatenate([self.rows_below(c) for c in children]) if children else rows


class Best:
    """The k best (score, id) of each query so far; `floor` is a known lower bound of the k-th score."""

    def __init__(self, query_ids: np.ndarray, floor: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.scores, self.ids = np.full((len(query_ids), k), -np.inf), np.full((len(query_ids), k), np.iinfo(np.int64).max)
        self.worst = floor.astype(np.float64).copy()

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.where(ids[None, :] == self.query_ids[queries][:, None], -np.inf, scores)
        some = (scores >= self.worst[queries][:, None]).any(axis=1)
        queries, scores = queries[some], scores[some]
        if not len(queries):
            return
        all_scores = np.concatenate([self.scores[queries], scores], axis=1)
        all_ids = np.concatenate([self.ids[queries], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.scores[queries], self.ids[queries] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)
        self.worst[queries] = np.maximum(self.worst[queries], self.scores[queries, -1])


def search(queries: CoverTree, data: CoverTree, floor: np.ndarray, k: int) -> Best:
    """The k best rows of `data` for each query, but for those below `floor`; equal scores by smaller id."""
    best = Best(queries.ids, floor, k)
    if queries.root < 0 or data.root < 0:
        return best
    below = {n: queries.rows_below(n) for n in range(len(queries.nodes))}

    def bound(q: int, r: int) -> float:
        (p, s, _, _), (c, t, _, _) = queries.nodes[q], data.nodes[r]
        return (queries.points[p] @ data.points[c] + s * data.norms[c] + t * queries.norms[p] + s * t) * (1 + 1e-12) + 1e-6

    stack = [(np.inf, queries.root, data.root)]
    while stack:
        most, q, r = stack.pop()
        if most < best.worst[below[q]].min():
            continue
        (_, q_radius, q_children, q_rows), (_, r_radius, r_children, r_rows) = queries.nodes[q], data.nodes[r]
        if not q_children and not r_children:
            best.offer(q_rows, queries.points[q_rows] @ data.points[r_rows].T, data.ids[r_rows])
            continue
        if r_children and (not q_children or r_radius >= q_radius):
            pairs = [(bound(q, c), q, c) for c in r_children]
        else:
            pairs = [(bound(c, r), c, r) for c in q_children]
        stack += sorted(pairs)  # the most promising is looked at first
    return best


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): floor(64 x) of each component, in double, as little-endian 32-bit integers.

    Rows without id, null vectors and vectors with a null or non-finite
    component take no part.  A finite component of 2^24 or more after scaling, whose
    products would not be exact, raises an error: no row is left out for it.  Zeros at the end are
    cut off, so that vectors of different lengths are compared as if filled with
    zeros.  Repeated rows count once.
    """
    def exact(x: Column) -> Column:
        scaled = x.cast("double") * SCALE
        return F.when(F.abs(scaled) < MOST, F.floor(scaled)).otherwise(F.raise_error(F.lit(
            f"a component of {MOST // SCALE} or more in size can't be scored exactly")))

    parts = F.transform("embedding", exact)
    usable = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"), parts.cast("array<int>").alias("v"))

    def run(batches):
        for batch in batches:
            vectors = [np.trim_zeros(np.array(x, "<i4"), "b").tobytes() for x in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(vectors, pa.binary())], names=["vec_id", "v"])

    return rows.mapInArrow(run, "vec_id long, v binary").distinct()


def _matrix(vectors: list[bytes], width: int) -> np.ndarray:
    if all(len(v) == 4 * width for v in vectors):
        return np.frombuffer(b"".join(vectors), "<i4").reshape(len(vectors), width).astype(np.float64)
    return np.array([np.pad(np.frombuffer(v, "<i4"), (0, width - len(v) // 4)) for v in vectors], np.float64).reshape(len(vectors), width)


def top_k(embeddings: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that satisfies `is_query`, the k rows of greatest inner product.

    Scores are exact integers over quantised vectors; the query's own vec_id is
    left out and ties go to the smaller vec_id.  Queries with fewer candidates
    get them all.  See `quantised` for rows that take no part; other columns are
    ignored; an empty table gives an empty one.  Of equal vectors only the k + 1
    smallest ids can be among a query's k best: no more are kept as data.
    """
    spark = embeddings.sparkSession
    rows = materialize(quantised(embeddings), "vectors")
    width, n = rows.agg(F.max(F.octet_length("v")), F.count("*")).first()
    width = max(1, (width or 0) // 4)
    by_id = Window.partitionBy("v").orderBy("vec_id")
    data = rows.withColumn("copy", F.row_number().over(by_id)).where(F.col("copy") <= k + 1).drop("copy")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # bounded
    sample_ids, sample_points = np.array([r["vec_id"] for r in sample], np.int64), _matrix([bytes(r["v"]) for r in sample], width)
    pivots = sample_points[: max(1, min(SAMPLE, -(-n // BLOCK)))]

    def near(batches):
        for batch in batches:
            points = _matrix(batch.column("v").to_pylist(), width)
            home = ((pivots**2).sum(axis=1)[None, :] - 2 * points @ pivots.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32))], names=["vec_id", "v", "pivot"])

    def blocks(part: DataFrame, size: int, first: bool) -> DataFrame:
        """(block, tree, centre, radius, worst) for each block: at most about `size` rows around a pivot."""
        homed = materialize(part.mapInArrow(near, "vec_id long, v binary, pivot int"), "homed")
        counts = homed.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("cuts"))  # a row per pivot
        block = F.concat_ws("/", "pivot", F.pmod(F.xxhash64("vec_id", F.lit("cut")), F.col("cuts")))

        def plant(table: pa.Table) -> pa.Table:
            ids = table.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            tree = CoverTree(ids[order], _matrix(table.column("v").to_pylist(), width)[order])
            floor = np.full(len(ids), -np.inf)
            if first and len(sample_ids) > k:
                scores = np.where(sample_ids[None, :] == tree.ids[:, None], -np.inf, tree.points @ sample_points.T)
                floor = np.partition(scores, -k, axis=1)[:, -k]
            centre, radius, _, _ = tree.nodes[tree.root]
            return pa.table({"block": [table.column("block")[0].as_py()], "tree": [pickle.dumps((tree, floor))],
                             "centre": [tree.points[centre].tobytes()], "radius": [radius], "worst": [float(floor.min())]})

        named = homed.join(F.broadcast(counts), "pivot").select(block.alias("block"), "vec_id", "v")
        return materialize(named.groupBy("block").applyInArrow(
            plant, "block string, tree binary, centre binary, radius double, worst double"), "trees")

    trees = blocks(data, BLOCK, False)
    asked = blocks(rows.where(is_query), QUERY_BLOCK, True)
    numbers = trees.select("block", (F.row_number().over(Window.orderBy("block")) - 1).alias("number"))  # a name per block, no tree
    trees = materialize(trees.join(numbers, "block"), "numbered-trees")
    blocks_n = trees.count()
    if not blocks_n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # every query block against every data block, but for the pairs whose bound rules them out
    pairs = asked.select(F.col("block").alias("asked"), F.col("centre").alias("p"), F.col("radius").alias("s"), "worst",
                         F.explode(F.sequence(F.lit(0), F.lit(blocks_n - 1))).alias("number")).join(
        trees.select("number", F.col("centre").alias("c"), F.col("radius").alias("t")), "number")

    def possible(batches):
        for batch in batches:
            p, c = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.float64).reshape(-1, width) for x in ("p", "c"))
            s, t, worst = (batch.column(x).to_numpy() for x in ("s", "t", "worst"))
            norm = lambda x: np.sqrt((x**2).sum(axis=1))
            most = ((p * c).sum(axis=1) + s * norm(c) + t * norm(p) + s * t) * (1 + 1e-12) + 1e-6
            yield batch.select(["asked", "number"]).filter(pa.array(most >= worst))

    left = pairs.mapInArrow(possible, "asked string, number int")
    met = left.join(trees.select("number", F.col("tree").alias("data")), "number").join(
        asked.select(F.col("block").alias("asked"), F.col("tree").alias("queries")), "asked").select("queries", "data")

    def run(batches):
        for batch in batches:
            for a, b in zip(batch.column("queries"), batch.column("data")):
                (queries, floor), (data, _) = pickle.loads(a.as_py()), pickle.loads(b.as_py())
                best = search(queries, data, floor, k)
                found = (best.scores > -np.inf) & (best.scores >= floor[:, None])
                who = np.broadcast_to(best.query_ids[:, None], found.shape)[found]
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(best.ids[found]), pa.array(best.scores[found].astype(np.int64))],
                                                 names=["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.mapInArrow(run, "query_id long, vec_id long, score long").withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
