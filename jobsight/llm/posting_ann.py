"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted on a sample of at most ``SAMPLE`` distinct vectors by
k-means with a penalty on crowded clusters, so lists come out balanced. Every
vector joins the list of its nearest centroid and, near a boundary, also the
lists of further centroids almost as near (unless one already chosen is nearer
to that centroid than the vector is, which would add nothing). A query walks a
neighbour graph over the centroids, held in memory, best first; of the
centroids found, those within a ratio of the nearest distance select its
lists. Lists and queries meet in a shuffle by list; long lists are dealt to
blocks and long query sets to chunks, so a hot list is never one task's work.
Distances are exact, in double precision, on the original vectors.

Edge cases: vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part; a vec_id that occurs twice is one
candidate, at its nearest row; with fewer candidates than ``k`` all are
returned; an empty table gives no rows. Copies of one vector count as one
while lists are searched, then all their ids (smallest first) are considered.
"""

from __future__ import annotations

import heapq
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobsight.llm.common import materialise, slices

SAMPLE = 20_000
#: Wanted vectors a list, and most lists.
LIST_SIZE, MAX_LISTS = 200, 4096
#: A vector joins lists within this ratio of its nearest distance, at most COPIES.
BOUNDARY, COPIES = 1.12, 6
#: A query reads lists within this ratio of its nearest centroid's distance.
PRUNE = 1.2
#: Neighbours of a centroid in the graph, and width of the walk as a share of all lists.
DEGREE, WIDTH = 24, 0.5
#: Vectors (queries) of one list that are compared in one task.
BLOCK, CHUNK = 5000, 2000


# -------------------------------------------------------------------- centroids

def _d2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """k-means whose assignment cost grows with a cluster's size."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    c = x[rng.permutation(len(x))[:k]].astype(np.float64)
    size = np.full(k, len(x) / k)
    for turn in range(rounds):
        d = _d2(x, c)
        spread = np.median(d.min(axis=1)) + 1e-12
        own = (d + 0.3 * spread * (size / (len(x) / k) - 1)[None]).argmin(axis=1)
        size = 0.5 * size + 0.5 * np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=k)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
        small = np.flatnonzero(n < len(x) / k / 3)
        if turn < rounds - 4 and len(small):              # a starved cluster takes half of a crowded one
            crowded = np.argsort(-n, kind="stable")[:len(small)]
            for j, big in zip(small, crowded):
                members = np.flatnonzero(own == big)
                half = rng.permutation(members)[:max(1, len(members) // 2)]
                c[j] = x[half].mean(axis=0)
                size[j] = len(x) / k
    return c


def neighbour_graph(c: np.ndarray, degree: int = DEGREE) -> list[list[int]]:
    """Nearest neighbours of each centroid, both ways, and a ring that keeps it connected."""
    k = len(c)
    links = [set() for _ in range(k)]
    for start in range(0, k, 512):
        near = np.argsort(_d2(c[start:start + 512], c), axis=1)[:, 1:degree + 1]
        for i, row in enumerate(near.tolist(), start):
            links[i].update(row)
            for j in row:
                links[j].add(i)
    for i in range(k):
        links[i].add((i + 1) % k)
    return [sorted(s - {i}) for i, s in enumerate(links)]


def walk(q: np.ndarray, c: np.ndarray, graph: list[list[int]], width: int) -> list[tuple[float, int]]:
    """Best-first walk: up to ``width`` nearest centroids found, (distance, centroid) ascending."""
    first = float(((c[0] - q) ** 2).sum())
    seen, todo, best = {0}, [(first, 0)], [(-first, 0)]
    while todo:
        d, at = heapq.heappop(todo)
        if len(best) >= width and d > -best[0][0]:
            break
        new = [j for j in graph[at] if j not in seen]
        if not new:
            continue
        seen.update(new)
        for dj, j in zip(((c[new] - q) ** 2).sum(axis=1).tolist(), new):
            if len(best) < width:
                heapq.heappush(best, (-dj, j))
            elif dj < -best[0][0]:
                heapq.heapreplace(best, (-dj, j))
            else:
                continue
            heapq.heappush(todo, (dj, j))
    return sorted((max(-d, 0.0) ** 0.5, j) for d, j in best)


def lists_of_vectors(x: np.ndarray, c: np.ndarray, between: np.ndarray) -> list[list[int]]:
    """Lists each vector joins, nearest first. ``between``: distances of the centroids."""
    d = np.sqrt(_d2(x, c))
    take = min(2 * COPIES, len(c))
    near = np.argpartition(d, take - 1, axis=1)[:, :take]
    out = []
    for i in range(len(x)):
        order = near[i][np.argsort(d[i, near[i]], kind="stable")]
        chosen = [int(order[0])]
        for j in order[1:].tolist():
            if d[i, j] > BOUNDARY * d[i, order[0]] or len(chosen) == COPIES:
                break
            if all(between[j, o] > d[i, j] * 0.6 for o in chosen):
                chosen.append(j)
        out.append(chosen)
    return out


def lists_of_query(q: np.ndarray, c: np.ndarray, graph: list[list[int]], size: np.ndarray, enough: int) -> list[int]:
    """Lists a query reads: those within PRUNE of the nearest centroid, and as many more
    as it takes to hold ``enough`` vectors."""
    found = walk(q, c, graph, max(8, int(WIDTH * len(c))))
    out, held = [], 0
    nearest = next((d for d, _ in found if d > 0), 0.0)    # a query may be a centroid itself
    for d, j in found:
        if d > PRUNE * nearest and held >= enough:
            break
        out.append(j)
        held += int(size[j])
    if held < enough:                                     # tiny index: read on in any order
        rest = [j for j in range(len(c)) if j not in set(out)]
        for j in rest:
            if held >= enough:
                break
            out.append(j)
            held += int(size[j])
    return out


# --------------------------------------------------------------------- operator

def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec): the vectors that take part, as arrays of doubles."""
    v = (vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
         .select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
         .where("size(vec) > 0 AND NOT exists(vec, e -> e IS NULL OR isnan(e) OR abs(e) = double('infinity')) AND exists(vec, e -> e <> 0)"))
    lengths = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return v.where(F.size("vec") == (lengths[0]["n"] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _nearest(k: int):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Up to k nearest of one block for each of its queries."""
        out = []
        if len(left) and len(right):
            left = left.sort_values("vec_id", kind="stable")
            x, first, inverse = np.unique(np.stack(left["vec"].to_numpy()), axis=0, return_index=True, return_inverse=True)
            ids = left["vec_id"].to_numpy()
            copies = pd.Series(ids).groupby(inverse.ravel()).apply(lambda s: s.unique()[:k + 1].tolist())
            q = np.stack(right["qvec"].to_numpy())
            for start in range(0, len(q), 128):
                part = q[start:start + 128]
                d = _d2(part, x)
                last = min(k, len(x) - 1)                 # the query itself may be among them
                # rounding of the expanded form: whatever may be as near as the last one is looked at exactly
                far = np.partition(d, last, axis=1)[:, last] + 1e-15 * (x.shape[1] + 8) * ((part**2).sum(axis=1) + (x**2).sum(axis=1).max())
                for i, own in enumerate(right["query_id"].to_numpy()[start:start + 128]):
                    row = np.flatnonzero(d[i] <= far[i])
                    exact = np.sqrt(((x[row] - part[i]) ** 2).sum(axis=1))
                    tied = exact <= np.partition(exact, last)[last]
                    best = sorted((float(s), int(v)) for s, u in zip(exact[tied], row[tied].tolist()) for v in copies[u] if v != own)
                    out += [(int(own), v, s) for s, v in best[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})
    return run


def search(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found for each id divisible by ``every``."""
    spark = vectors.sparkSession
    v = materialise(usable(vectors, id_col, vec_col), "vectors")
    n = v.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = np.array([r[0] for r in v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").collect()])
    c = balanced_centroids(sample, min(MAX_LISTS, max(1, n // LIST_SIZE)))
    graph, between = neighbour_graph(c), np.sqrt(_d2(c, c))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            got = lists_of_vectors(_matrix(batch.column(1)), c, between)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.int32()))], ["vec_id", "vec", "lists"])

    placed = materialise(v.mapInArrow(assign, "vec_id bigint, vec array<double>, lists array<int>")
                         .select("vec_id", "vec", F.posexplode("lists").alias("at", "list")), "placed")
    sizes = placed.groupBy("list").agg(F.sum((F.col("at") == 0).cast("long")).alias("own"), F.count("*").alias("members"))
    own = np.zeros(len(c), dtype=np.int64)
    for row in sizes.collect():                           # at most MAX_LISTS rows
        own[row["list"]] = row["own"]
    enough = min(n, 20 * k)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            got = [lists_of_query(q, c, graph, own, enough) for q in _matrix(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.int32()))], ["query_id", "qvec", "lists"])

    queries = (v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"))
               .groupBy("query_id").agg(F.min("qvec").alias("qvec"))         # a repeated id asks with its smallest vector
               .mapInArrow(route, "query_id bigint, qvec array<double>, lists array<int>")
               .select("query_id", "qvec", F.explode("lists").alias("list")))
    queries = materialise(queries, "routed")
    asked = queries.groupBy("list").agg(F.count("*").alias("asked"))
    plan = (sizes.join(asked, "list").select(
        "list", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("asked") / CHUNK).cast("int").alias("chunks")))

    left = (placed.join(plan, "list")
            .withColumn("block", F.expr("cast(pmod(xxhash64(vec_id), blocks) AS INT)"))
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("list", "block", "chunk", "vec_id", "vec"))
    right = (queries.join(plan, "list")
             .withColumn("chunk", F.expr("cast(pmod(xxhash64(query_id), chunks) AS INT)"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", "block", "chunk", "query_id", "qvec"))
    keys = ["list", "block", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_nearest(k), "query_id bigint, vec_id bigint, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
