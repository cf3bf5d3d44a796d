"""Nearest neighbours by a forest of random-projection trees (operator 8).

The measure is the inner product. Trees are fitted on a bounded sample (``sample`` vectors): a node's direction is the
difference of two random members, its threshold the members' median projection. To make large inner products near, vectors
get one more component, sqrt(M^2 - |x|^2); a query's is 0. Every vector goes down every tree to one leaf. A query walks all
trees with one priority queue ordered by the largest margin crossed on the way, and takes leaves until they hold
``search_k`` entries: where there are no more than that, it sees every vector. In each leaf all its queries meet all its
vectors as two matrices; finalists are scored again on the original vectors in double precision, and each query's best
lists (one for some neighbouring leaves) are merged.

How many entries are enough depends on the data (the less it clusters, the more), so it is measured: ``probes`` queries
are answered by a scan of all vectors in blocks, and ``search_k`` is the least number at which the walk finds ``recall`` of their
true neighbours. ``search_k`` may also be given.

Equal vectors: a result never needs more than the k + 1 least ids of one vector, so the others are left out of the leaves
(no result can change); equal queries are searched once. Groups of full leaves are cut into parts by hash.

Defined cases: a vector that is null, zero, of other than the most frequent length, or holds a null or non-finite component
takes no part; so does a null id; repeated ids are candidates of their own, but a query never finds its own id; an empty
table gives no rows; other columns are ignored. Components that are no floats are taken as doubles, unrounded.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, tidy

TREES = 10
LEAF = 256
LEAST_K = 10_000
RECALL = 0.96
PROBES = 128
SAMPLE = 20_000
PART = 16_384


class Forest:
    """Complete binary trees of one depth: ``normals[t, node]``, ``offsets[t, node]``; leaf = t * 2^depth + place."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, bound: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth, self.trees, self.bound = depth, trees, bound
        x = self.lift(sample, bound)
        inner = (1 << depth) - 1
        self.normals = np.zeros((trees, inner, x.shape[1]), np.float32)
        self.offsets = np.zeros((trees, inner), np.float32)
        for t in range(trees):
            members = {0: np.arange(len(x))}
            for node in range(inner):
                own = members.pop(node)
                a, b = (x[rng.choice(own, 2, replace=False)] if len(own) > 1 else (x[rng.integers(len(x))], rng.normal(size=x.shape[1])))
                normal = a - b
                length = np.linalg.norm(normal)
                normal = normal / length if length > 0 else rng.normal(size=x.shape[1]) / math.sqrt(x.shape[1])
                side = x[own] @ normal
                cut = float(np.median(side)) if len(own) else 0.0
                self.normals[t, node], self.offsets[t, node] = normal, cut
                if 2 * node + 2 < (1 << (depth + 1)) - 1:
                    members[2 * node + 1], members[2 * node + 2] = own[side < cut], own[side >= cut]

    @staticmethod
    def lift(x: np.ndarray, bound: float) -> np.ndarray:
        """Vectors in units of the longest one, with the component that makes all equally long."""
        x = x.astype(np.float64) / bound
        rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))
        return np.column_stack((x, rest)).astype(np.float32)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector (already lifted) in each tree."""
        out = np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, self.normals[t, node]) - self.offsets[t, node]
                node = 2 * node + 1 + (side >= 0)
            out[:, t] = (t << self.depth) + node - ((1 << self.depth) - 1)
        return out

    def search(self, query: np.ndarray, sizes: np.ndarray, search_k: int) -> list[int]:
        """Leaves of one query (unlifted), nearest margin first, until they hold search_k entries."""
        lifted = np.append(query.astype(np.float64) / self.bound, 0.0)
        lifted /= np.linalg.norm(lifted) or 1.0
        margins = (self.normals @ lifted.astype(np.float32) - self.offsets).tolist()
        inner = (1 << self.depth) - 1
        queue = [(0.0, t, 0) for t in range(self.trees)]
        found, entries = [], 0
        while queue and entries < search_k:
            far, t, node = heapq.heappop(queue)
            while node < inner:
                m = margins[t][node]
                near = 2 * node + 1 + (m >= 0)
                heapq.heappush(queue, (max(far, abs(m)), t, 4 * node + 3 - near))
                node = near
            leaf = (t << self.depth) + node - inner
            if sizes[leaf]:
                found.append(leaf)
                entries += int(sizes[leaf])
        return found


def _scan(queries: np.ndarray, k: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"), length).astype(np.float64)
                ids = batch.column("id").to_numpy()
                at = {int(i): r for r, i in enumerate(ids)}
                for q, (best, scores) in enumerate(rerank(queries, ids, x, k)):
                    rows = pa.array([at[int(i)] for i in best])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(best), q)), batch.column("id").take(rows), batch.column("v").take(rows), pa.array(scores)],
                        names=["probe", "id", "v", "score"])

    return tidy(run)


def calibrate(indexed: DataFrame, probes: DataFrame, forest: Forest, sizes: np.ndarray, length: int, k: int, recall: float, kind: str = "float") -> int:
    """Least number of entries at which the probes (``id``, ``v``) find ``recall`` of their ``k`` true neighbours on the mean."""
    asked = probes.toArrow()
    if not asked.num_rows:
        return LEAST_K
    queries = _matrix(asked.column("v").combine_chunks(), length)
    found = indexed.mapInArrow(_scan(queries.astype(np.float64), k + 1, length), f"probe long, id long, v array<{kind}>, score double")
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "id")
    true = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("probe", "id", "v").toArrow()
    probe, near = true.column("probe").to_numpy(), _matrix(true.column("v").combine_chunks(), length)
    other = true.column("id").to_numpy() != asked.column("id").to_numpy()[probe]
    homes = forest.leaves(forest.lift(near, forest.bound))
    needed = []
    for q in range(len(queries)):
        walk = forest.search(queries[q], sizes, int(sizes.sum()) + 1)
        entries = np.cumsum(sizes[walk])
        first = np.full(len(sizes), int(sizes.sum()))
        first[walk] = entries
        needed += first[homes[(probe == q) & other][:k]].min(1).tolist()
    needed.sort()
    return max(LEAST_K, needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) if needed else LEAST_K


def usable(vector: Column, length: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == length) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _count_leaves(forest: Forest, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(forest.trees << forest.depth, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(forest.leaves(forest.lift(_matrix(batch.column("v"), length), forest.bound)).ravel(), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["leaf", "n"])

    return tidy(run)


def _groups(sizes: np.ndarray, depth: int, leaf: int) -> tuple[int, np.ndarray]:
    """Neighbouring leaves of a tree meet their queries together: bits of a leaf's number that its group drops, and how many
    parts by hash a group has, so that a part holds about ``PART`` vectors however full its leaves are."""
    shift = min(depth, max(0, int(math.log2(PART / leaf))))
    total = np.add.reduceat(sizes, np.arange(0, len(sizes), 1 << shift))
    return shift, np.maximum(1, -(-total // PART))


def _place(forest: Forest, sizes: np.ndarray, leaf_size: int, length: int):
    shift, parts = _groups(sizes, forest.depth, leaf_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = forest.leaves(forest.lift(_matrix(batch.column("v"), length), forest.bound))
            ids = batch.column("id").to_numpy()
            group = leaf >> shift
            part = (ids[:, None] * 2654435761 % (1 << 31)) % parts[group]
            for t in range(forest.trees):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[:, t]), pa.array(part[:, t]), pa.array(leaf[:, t]), batch.column("id"), batch.column("v")], names=["group", "part", "leaf", "id", "v"])

    return tidy(run)


def _route(forest: Forest, sizes: np.ndarray, leaf_size: int, length: int, search_k: int):
    shift, parts = _groups(sizes, forest.depth, leaf_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, query in enumerate(_matrix(batch.column("v"), length)) if batch.num_rows else ():
                by_group: dict[int, list[int]] = {}
                for leaf in forest.search(query, sizes, search_k):
                    by_group.setdefault(leaf >> shift, []).append(leaf)
                found = [(g, p, leaves) for g, leaves in by_group.items() for p in range(parts[g])]
                one, again = batch.slice(i, 1), pa.array(np.zeros(len(found), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.list_(pa.int64())),
                     one.column("id").take(again), one.column("v").take(again)], names=["group", "part", "leaves", "id", "v"])

    return tidy(run)


def rerank(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and scores of the k best vectors of each query, ties to the smaller id."""
    rough = queries @ vectors.T
    for q, row in zip(queries, rough):
        if len(ids) > k:
            edge = np.partition(row, len(ids) - k)[len(ids) - k]
            some = np.flatnonzero(row >= edge - 1e-9 * max(1.0, abs(edge)))
        else:
            some = np.arange(len(ids))
        exact = (vectors[some] * q).sum(1)
        best = np.lexsort((ids[some], -exact))[:k]
        yield ids[some][best], exact[best]


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, id, score) of each query, without repeats, ties to the smaller id."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    fresh = np.ones(len(query), bool)
    fresh[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])  # repeats have equal scores, so they are neighbours
    query, ids, scores = query[fresh], ids[fresh], scores[fresh]
    first = np.searchsorted(query, query)
    top = np.arange(len(query)) - first < k
    return query[top], ids[top], scores[top]


def _meet(k: int):
    """Best lists of a group's queries over its vectors: one row a query."""
    def run(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(members):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "ids": [], "scores": []})
        members = members.sort_values("leaf", kind="stable")
        x, ids, leaf = np.stack(members["v"].to_numpy()).astype(np.float64), members["id"].to_numpy(), members["leaf"].to_numpy()
        q = np.stack(queries["v"].to_numpy()).astype(np.float64)
        visits: dict[int, list[int]] = {}
        for i, leaves in enumerate(queries["leaves"]):
            for one in leaves:
                visits.setdefault(one, []).append(i)
        who, which = [], []
        for one, mine in visits.items():
            lo, hi = np.searchsorted(leaf, [one, one + 1])
            if lo == hi:
                continue
            mine = np.array(mine)
            rough = q[mine] @ x[lo:hi].T
            # Equal vectors (k at most) may differ in the last bit here: twice k keeps all that could be among the best.
            most = min(2 * k, hi - lo)
            near = np.argpartition(-rough, most - 1, axis=1)[:, :most]
            who.append(np.repeat(mine, most))
            which.append(lo + near.ravel())
        if not who:
            return pd.DataFrame({"query": np.zeros(0, np.int64), "ids": [], "scores": []})
        who, which = np.concatenate(who), np.concatenate(which)
        exact = np.concatenate([(q[who[i : i + 65536]] * x[which[i : i + 65536]]).sum(1) for i in range(0, len(who), 65536)])
        who, found, exact = _best(who, ids[which], exact, k)
        cuts = np.flatnonzero(np.diff(who)) + 1
        return pd.DataFrame({
            "query": queries["id"].to_numpy()[who[np.concatenate(([0], cuts))]], "ids": [a.tolist() for a in np.split(found, cuts)], "scores": [a.tolist() for a in np.split(exact, cuts)],
        })

    return run


def _merge(k: int):
    def run(lists: pd.DataFrame) -> pd.DataFrame:
        ids, scores = np.concatenate(lists["ids"].to_numpy()), np.concatenate(lists["scores"].to_numpy())
        _, ids, scores = _best(np.zeros(len(ids), np.int64), ids.astype(np.int64), scores.astype(np.float64), k)
        return pd.DataFrame({"query": lists["query"].iloc[0], "vec_id": ids, "score": scores})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, trees: int = TREES, leaf: int = LEAF, search_k: int | None = None,
            recall: float = RECALL, probes: int = PROBES, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best found for every row that ``is_query`` (of ``id`` and ``v``)."""
    spark = vectors.sparkSession
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    read = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).where("id IS NOT NULL")
    lengths = read.where("v IS NOT NULL AND size(v) > 0").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length = lengths["n"]
    read = read.where(usable(F.col("v"), length))
    key = F.md5(F.to_json(F.struct("v")).cast("binary"))
    same = Window.partitionBy("key").orderBy("id")
    keyed = read.withColumn("key", key)
    indexed = materialize(keyed.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).select("id", "v"), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows, bound = indexed.agg(F.count("*"), F.sqrt(F.max(square))).first()
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    few = indexed.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column("v").combine_chunks()
    depth = max(0, min(math.ceil(math.log2(rows / leaf)) if rows > leaf else 0, int(math.log2(max(1, len(few) / 8)))))
    forest = Forest(_matrix(few, length), trees, depth, float(bound) or 1.0)
    counted = indexed.select("v").mapInArrow(_count_leaves(forest, length), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
    sizes = np.zeros(trees << depth, np.int64)
    for r in counted.collect():  # as many rows as the forest has leaves
        sizes[r["leaf"]] = r["n"]
    asked = keyed.where(is_query)
    distinct = asked.groupBy("key").agg(F.min("id").alias("id"), F.first("v").alias("v"))
    if search_k is None:
        tried = distinct.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(probes).select("id", "v")
        search_k = calibrate(indexed, tried, forest, sizes, length, k, recall, kind)
    routed = distinct.select("id", "v").mapInArrow(_route(forest, sizes, leaf, length, search_k), f"group long, part long, leaves array<long>, id long, v array<{kind}>")
    placed = indexed.mapInArrow(_place(forest, sizes, leaf, length), f"group long, part long, leaf long, id long, v array<{kind}>")
    met = routed.groupBy("group", "part").cogroup(placed.groupBy("group", "part")).applyInPandas(_meet(k + 1), "query long, ids array<long>, scores array<double>")
    best = met.groupBy("query").applyInPandas(_merge(k + 1), "query long, vec_id long, score double")
    leaders = distinct.select("key", F.col("id").alias("query"))
    asked = asked.select("key", F.col("id").alias("query_id")).distinct()
    out = asked.join(leaders, "key").join(best, "query").where("vec_id <> query_id")
    mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
