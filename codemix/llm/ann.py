"""Nearest neighbours by cosine with robust-pruned directed graphs, one per shard.

Equal vectors are one point of a graph that stands for the few smallest ids among
them, as no others can be among the nearest. Points are dealt to shards of bounded
size by a hash. A shard's graph is built in batches: a greedy search from the
shard's centre proposes each new point's neighbours, pruning keeps those that no kept
neighbour is closer to by the factor ``ALPHA``, and edges back are added and pruned the
same way. Queries, each distinct vector once, are beam-searched in blocks in every shard;
the shards' results are scored in double precision on the original vectors and merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from codemix.llm.common import bounded_batches, written

SHARD = 8192
DEGREE = 28
ALPHA = 1.2
BUILD_BEAM = 64
SEARCH_BEAM = 96
#: Points that a search expands at once.
WIDTH = 4
_BATCH = 256
QUERY_BLOCK = 2048


@dataclass
class Graph:
    """Unit vectors, each point's neighbours (-1: none), and where searches begin."""

    points: np.ndarray
    edges: np.ndarray
    start: int

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The numbers and squared distances of the ``beam`` nearest points found for each
        query, nearest first; -1 and infinity where there are fewer."""
        n = len(queries)
        ids = np.full((n, beam), -1, np.int32)
        far = np.full((n, beam), np.inf, np.float32)
        expanded = np.ones((n, beam), bool)
        ids[:, 0], expanded[:, 0] = self.start, False
        far[:, 0] = 2 - 2 * queries @ self.points[self.start]
        active = np.arange(n)
        while len(active):
            mine, todo = ids[active], np.where(expanded[active], np.inf, far[active])
            chosen = np.argsort(todo, axis=1, kind="stable")[:, :WIDTH]
            rows = np.arange(len(active))[:, None]
            open_ = np.isfinite(todo[rows, chosen])
            from_ = np.where(open_, mine[rows, chosen], -1)
            mark = expanded[active]
            mark[rows, chosen] = True
            new = np.where((from_ >= 0)[:, :, None], self.edges[from_], -1).reshape(len(active), -1)
            # a point counts once, and not again if the beam has it
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            in_beam = np.sort(mine, axis=1)
            offset = (np.arange(len(active)) * (len(self.points) + 1))[:, None]
            place = np.searchsorted((in_beam + offset).ravel(), (new + offset).ravel())
            place = np.minimum(place, in_beam.size - 1)
            new[((in_beam + offset).ravel()[place] == (new + offset).ravel()).reshape(new.shape)] = -1
            distance = 2 - 2 * np.einsum("qnd,qd->qn", self.points[new], queries[active], optimize=True)
            distance[new < 0] = np.inf
            all_ids, all_far = np.hstack([mine, new]), np.hstack([far[active], distance])
            all_marks = np.hstack([mark, new < 0])
            best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            ids[active], far[active], expanded[active] = all_ids[rows, best], all_far[rows, best], all_marks[rows, best]
            ids[active] = np.where(np.isinf(far[active]), -1, ids[active])
            active = active[(~expanded[active] & np.isfinite(far[active])).any(axis=1)]
        return ids, far


def pruned(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point the nearest candidate, then the nearest of those left when all have
    gone that a kept one is closer to than the point, by the factor, and so on."""
    vectors = points[candidates]
    distance = 2 - 2 * np.einsum("pcd,pd->pc", vectors, points[own], optimize=True)
    gone = (candidates < 0) | (candidates == own[:, None])
    distance = np.where(gone, np.inf, distance)
    order = np.argsort(distance, axis=1, kind="stable")
    rows = np.arange(len(own))[:, None]
    candidates, distance, vectors = candidates[rows, order], distance[rows, order], vectors[rows, order]
    between = 2 - 2 * np.einsum("pcd,ped->pce", vectors, vectors, optimize=True)
    alive = np.isfinite(distance)
    alive[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    kept = np.full((len(own), degree), -1, np.int32)
    every = np.arange(len(own))
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[every, first]
        if not some.any():
            break
        kept[some, k] = candidates[every, first][some]
        covered = alpha * alpha * between[every, first] <= distance
        alive &= ~(covered & some[:, None])
        alive[every, first] = False
    return kept


def build(vectors: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM) -> Graph:
    """The graph of a shard's vectors, the same for the same vectors in the same order."""
    points = (vectors / np.linalg.norm(vectors.astype(np.float64), axis=1)[:, None]).astype(np.float32)
    n = len(points)
    start = int((points @ points.mean(axis=0)).argmax())
    graph = Graph(points, np.full((n, degree), -1, np.int32), start)
    order = np.random.default_rng(0).permutation(n).astype(np.int32)
    order = np.r_[start, order[order != start]].astype(np.int32)
    at = 1
    while at < n:
        # batches grow with the graph, so that early points find neighbours too
        batch = order[at:at + min(_BATCH, max(1, at))]
        at += len(batch)
        found, _ = graph.search(points[batch], beam)
        graph.edges[batch] = pruned(points, batch, found, degree, alpha)
        _link_back(graph, batch, degree, alpha)
    return graph


def _link_back(graph: Graph, batch: np.ndarray, degree: int, alpha: float) -> None:
    source = np.repeat(batch, degree)
    target = graph.edges[batch].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    owners, first, counts = np.unique(target, return_index=True, return_counts=True)
    for lo in range(0, len(owners), 64):
        own, n = owners[lo:lo + 64], counts[lo:lo + 64]
        more = np.full((len(own), n.max()), -1, np.int32)
        for i, (f, c) in enumerate(zip(first[lo:lo + 64], n)):
            more[i, :c] = source[f:f + c]
        both = np.hstack([graph.edges[own], more])
        room = (both >= 0).sum(axis=1) <= degree
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)[:, :degree]
        graph.edges[own[room]] = packed[room]
        if not room.all():
            graph.edges[own[~room]] = pruned(graph.points, own[~room], both[~room], degree, alpha)


# ---- DataFrame operators --------------------------------------------------

def _usable(vector: Column) -> Column:
    """Vectors that have a direction: no null, infinite or undefined parts, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def _index(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("vid", kind="stable")
    vectors = np.array(frame["embedding"].tolist(), np.float32)
    graph = build(vectors)
    return pd.DataFrame({
        "dim": [vectors.shape[1]], "shard": [int(frame["shard"].iloc[0])], "n": [len(vectors)], "start": [graph.start],
        "vids": [frame["vid"].to_numpy(np.int64).tobytes()], "vectors": [vectors.tobytes()],
        "edges": [graph.edges.tobytes()],
    })


def _search(batches):
    keep = 0
    for frame in batches:
        out = []
        for row in frame.itertuples(index=False):
            vectors = np.frombuffer(row.vectors, np.float32).reshape(row.n, row.dim)
            norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
            points = (vectors / norms[:, None]).astype(np.float32)
            graph = Graph(points, np.frombuffer(row.edges, np.int32).reshape(row.n, -1), row.start)
            vids = np.frombuffer(row.vids, np.int64)
            keep, queries = int(row.keep), np.array(list(row.queries), np.float64)
            own_norms = np.sqrt((queries ** 2).sum(axis=1))
            units = (queries / own_norms[:, None]).astype(np.float32)
            for lo in range(0, len(queries), _BATCH):
                found, _ = graph.search(units[lo:lo + _BATCH], max(SEARCH_BEAM, 2 * keep))
                q, place = np.nonzero(found >= 0)
                hits = found[q, place]
                score = (queries[lo + q] * vectors[hits]).sum(axis=1) / (own_norms[lo + q] * norms[hits])
                best = pd.DataFrame({"qrep": np.asarray(row.qreps)[lo + q], "vid": vids[hits], "score": score})
                best = best.sort_values(["qrep", "score", "vid"], ascending=[True, False, True])
                out.append(best.groupby("qrep", sort=False).head(keep))
        if out:
            yield pd.concat(out)


def nearest(
    df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_size: int = SHARD,
) -> DataFrame:
    """The k nearest found of every row for which the condition ``queries`` on ``vec_id`` holds,
    among all rows but itself: query_id, rank from 1, vec_id, score. Every block of queries is
    searched in every shard, so the work is queries times shards.

    Vectors that are null, zero, or hold null or non-finite parts, and rows with null
    ids, take no part; vectors of another length than the query's are no candidates. Ties
    go to smaller ids; rows that repeat id and vector count once; with fewer candidates
    all are returned; other columns are ignored; empty tables give none.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    keep = k + 1  # one may be the query itself
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    smallest = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    ids = rows.select("*", smallest.alias("nth")).where(F.col("nth") <= keep)
    distinct = written(
        ids.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
        .select("embedding", "ids", F.col("ids")[0].alias("vid"), F.size("embedding").alias("dim")), "ann-points",
    )
    shards = max(1, -(-distinct.count() // shard_size))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("embedding", F.lit(1)), F.lit(shards)))
    index = written(
        # an index takes seconds for a few MB: adaptive execution must not merge them into few tasks
        dealt.select("embedding", "vid", "dim", "shard").repartition(4 * shards, "dim", "shard").groupBy("dim", "shard").applyInPandas(
            _index, "dim long, shard long, n long, start long, vids binary, vectors binary, edges binary"
        ), "ann-index",
    )
    asked = written(rows.where(queries).distinct(), "ann-queries")
    # each distinct query vector once, in blocks for every shard
    vectors = asked.groupBy("embedding").agg(F.min("vec_id").alias("qrep")).withColumn("dim", F.size("embedding").cast("long"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("embedding", F.lit(2)), F.lit(blocks))
    grouped = vectors.groupBy("dim", block.alias("block")).agg(F.collect_list(F.struct("qrep", "embedding")).alias("q"))
    grouped = grouped.select("dim", "block", F.col("q.qrep").alias("qreps"), F.col("q.embedding").alias("queries"), F.lit(keep).alias("keep"))
    found = grouped.join(index.select("dim", "shard"), "dim").join(index, ["dim", "shard"]).mapInPandas(
        _search, "qrep long, vid long, score double"
    )
    by_score = [F.desc("score"), F.col("vec_id")]
    scored = found.join(distinct.select("vid", "ids"), "vid").select("qrep", "score", F.explode("ids").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("qrep").orderBy(*by_score))
    scored = written(scored.select("*", place.alias("place")).where(F.col("place") <= keep), "ann-found")
    named = asked.select(F.col("vec_id").alias("query_id"), "embedding").join(vectors.select("embedding", "qrep"), "embedding")
    others = named.select("query_id", "qrep").join(scored, "qrep").where("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*by_score))
    return others.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
