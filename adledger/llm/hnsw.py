"""Approximate nearest neighbours: one HNSW graph per shard, shard results merged.

Equal vectors are one node, which keeps the smallest ids it stands for: as many as a query
can return, and one more for the query's own. So a vector that a third of all rows share
costs one node. Nodes are dealt by hash to shards of about `shard_rows`; a shard's graph is
built in one task and stored as one row of flat arrays: neighbour numbers by layer, vectors
and ids. Queries meet every shard in blocks; each shard gives its nearest per query, and the
nearest of all shards are kept. Distances of the result are computed in double precision on
the original vectors; ties go to the smaller id.

Vectors that are null, zero, or hold a null or non-finite component take no part. Vectors of
another number of components are a space of their own, with its own shards and neighbours.
Equal rows are one candidate; a query id with several vectors asks with the least of them. With fewer candidates than k a query returns them all; an empty table gives none.
"""

from __future__ import annotations

from heapq import heappop, heappush, heappushpop

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adledger.llm.common import arrow_map, staged


class Graph:
    """A navigable small-world graph over the rows of `vectors`, in layers.

    links[0] has 2m columns and links[i] m; -1 fills up. at[i] gives a node's row in links[i].
    """

    def __init__(self, vectors: np.ndarray, m: int, links=None, members=None):
        self.v, self.m = np.ascontiguousarray(vectors, np.float32), m
        self.norm = np.einsum("ij,ij->i", self.v, self.v)
        self.links: list[np.ndarray] = links or []
        self.members: list[np.ndarray] = members or []
        self.stamp, self.now = np.zeros(len(vectors), np.int32), 0
        self._rows()

    def _rows(self):
        self.at = []
        for nodes in self.members:
            row = np.full(len(self.v), -1, np.int32)
            row[nodes] = np.arange(len(nodes), dtype=np.int32)
            self.at.append(row)

    def search(self, q: np.ndarray, near: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ef nearest found from the entries `near`, nearest first; distances less |q|^2."""
        self.now += 1
        stamp, now, links, at = self.stamp, self.now, self.links[layer], self.at[layer]
        todo, best = [], []
        for d, i in near:
            stamp[i] = now
            heappush(todo, (d, i))
            heappush(best, (-d, i))
        while todo:
            d, i = heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            around = links[at[i]]
            around = around[around >= 0]
            around = around[stamp[around] != now]
            if not len(around):
                continue
            stamp[around] = now
            dist = self.norm[around] - 2 * (self.v[around] @ q)
            if len(best) >= ef:
                close = dist < -best[0][0]
                around, dist = around[close], dist[close]
            for x, j in zip(dist.tolist(), around.tolist()):
                if len(best) < ef:
                    heappush(best, (-x, j))
                elif x < -best[0][0]:
                    heappushpop(best, (-x, j))
                else:
                    continue
                heappush(todo, (x, j))
        return sorted((-d, i) for d, i in best)

    def _choose(self, dist: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
        """Of the nodes, nearest first, those nearer to the centre than to any chosen one."""
        if len(nodes) <= 1:
            return nodes
        v = self.v[nodes]
        apart = self.norm[nodes][:, None] + self.norm[nodes][None, :] - 2 * v @ v.T
        chosen: list[int] = []
        nearest = np.full(len(nodes), np.inf)
        for i in range(len(nodes)):
            if dist[i] < nearest[i]:
                chosen.append(i)
                if len(chosen) == most:
                    break
                np.minimum(nearest, apart[i], out=nearest)
        if len(chosen) < most:  # fill up with the nearest left out
            taken = set(chosen)
            chosen += [i for i in range(len(nodes)) if i not in taken][:most - len(chosen)]
        return nodes[chosen]

    def build(self, ef: int, seed: int) -> "Graph":
        n = len(self.v)
        r = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - r.random(n)) / np.log(self.m)).astype(int), 12)
        if n:
            level[0] = level.max()  # the first node is the entry to all layers
        self.members = [np.flatnonzero(level >= k) for k in range(int(level.max()) + 1 if n else 1)]
        self.links = [np.full((len(x), 2 * self.m if k == 0 else self.m), -1, np.int32) for k, x in enumerate(self.members)]
        self._rows()
        top = len(self.members) - 1
        for i in range(1, n):
            q = self.v[i]
            near = [(float(self.norm[0] - 2 * (self.v[0] @ q)), 0)]
            for k in range(top, -1, -1):
                if k > level[i]:
                    near = self.search(q, near, 1, k)
                    continue
                near = self.search(q, near, ef, k)
                nodes = np.array([j for _, j in near], np.int32)
                dist = np.array([d for d, _ in near]) + self.norm[i]
                most = self.links[k].shape[1]
                picked = self._choose(dist, nodes, self.m)
                self.links[k][self.at[k][i], :len(picked)] = picked
                for j in picked.tolist():
                    row = self.links[k][self.at[k][j]]
                    free = np.flatnonzero(row < 0)
                    if len(free):
                        row[free[0]] = i
                        continue
                    both = np.append(row, np.int32(i))
                    d = self.norm[both] + self.norm[j] - 2 * (self.v[both] @ self.v[j])
                    order = np.argsort(d, kind="stable")
                    kept = self._choose(d[order], both[order], most)
                    row[:] = -1
                    row[:len(kept)] = kept
        return self

    def nearest(self, q: np.ndarray, count: int, ef: int) -> list[int]:
        if not len(self.v):
            return []
        near = [(float(self.norm[0] - 2 * (self.v[0] @ q)), 0)]
        for k in range(len(self.links) - 1, 0, -1):
            near = self.search(q, near, 1, k)
        return [i for _, i in self.search(q, near, max(ef, count), 0)[:count]]


def usable(vector: Column) -> Column:
    """Whether a vector takes part: all components finite numbers, one of them not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        usable(F.col("v")) & F.col("id").isNotNull())


def _nodes(rows: DataFrame, ids: int) -> DataFrame:
    """v and the smallest `ids` ids of each distinct vector, sorted; salted, so no vector is hot."""
    first = Window.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    second = Window.partitionBy("v").orderBy("id")
    return (rows.withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= ids)
            .withColumn("r", F.dense_rank().over(second)).where(F.col("r") <= ids)
            .groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")))


INDEX = ("shard int, d int, n int, ids array<array<long>>, vectors binary, sizes array<int>, members binary, links binary")


def build_index(rows: DataFrame, ids: int, shard_rows: int = 4096, m: int = 12, ef: int = 64, seed: int = 1) -> DataFrame:
    """One row per shard: its graph as flat arrays. rows: id, v."""
    nodes = staged(_nodes(rows, ids), "nodes")
    shards = max(1, -(-nodes.count() // shard_rows))

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.assign(first=[x[0] for x in shard["ids"]]).sort_values("first")
        v = np.stack(shard["v"].to_numpy())
        g = Graph(v, m).build(ef, seed)
        return pd.DataFrame({"shard": [int(shard["shard"].iloc[0])], "d": [v.shape[1]], "n": [len(v)], "ids": [[list(x) for x in shard["ids"]]],
                             "vectors": [v.tobytes()], "sizes": [[len(x) for x in g.members]],
                             "members": [np.concatenate(g.members).astype(np.int32).tobytes()],
                             "links": [b"".join(x.tobytes() for x in g.links)]})

    # vectors of another number of components are another space, with shards of its own
    own = F.pmod(F.xxhash64(F.col("ids")[0], F.lit(seed)), F.lit(shards))
    dealt = nodes.withColumn("shard", (F.size("v") * shards + own).cast("int"))
    return dealt.repartitionByRange(shards, "shard").groupBy("shard").applyInPandas(run, INDEX)


def _loaded(row: dict, m: int) -> tuple[Graph, np.ndarray]:
    v = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], -1)
    nodes, links = np.frombuffer(row["members"], np.int32), np.frombuffer(row["links"], np.int32)
    members, layers, a, b = [], [], 0, 0
    for k, size in enumerate(row["sizes"]):
        wide = 2 * m if k == 0 else m
        members.append(nodes[a:a + size])
        layers.append(links[b:b + size * wide].reshape(size, wide))
        a, b = a + size, b + size * wide
    return Graph(v, m, layers, members), v


def search_index(index: DataFrame, queries: DataFrame, k: int = 10, m: int = 12, ef: int = 120, block: int = 256) -> DataFrame:
    """query_id, rank, id, score: the k nearest of each query (id, v) but itself."""
    blocks = max(1, -(-queries.count() // block))
    dealt = (queries.groupBy(F.size("v").alias("d"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
             .agg(F.collect_list(F.struct("id", "v")).alias("asked")))
    # the shards that exist, by number of components
    there = index.groupBy("d").agg(F.collect_set("shard").alias("shards"))
    pairs = dealt.join(there, "d").withColumn("shard", F.explode("shards"))
    met = pairs.join(index.withColumnRenamed("shard", "own"), F.col("shard") == F.col("own")).select(
        "asked", "n", "ids", "vectors", "sizes", "members", "links")

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                graph, v = _loaded(row, m)
                out = []
                for q in row["asked"]:
                    x = np.array(q["v"])
                    found = graph.nearest(x.astype(np.float32), k + 1, ef)
                    d = np.sqrt(((v[found] - x) ** 2).sum(axis=1))
                    out += sorted((s, i, q["id"]) for s, node in zip(d.tolist(), found) for i in row["ids"][node]
                                  if i != q["id"])[:k]
                yield pa.RecordBatch.from_arrays([pa.array([o[2] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                                                  pa.array([o[0] for o in out], pa.float64())], ["query_id", "id", "score"])

    best = Window.partitionBy("query_id").orderBy("score", "id")
    return (arrow_map(met, run, "query_id long, id long, score double").withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= k).select("query_id", "rank", "id", "score"))


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, m: int = 12,
            ef_build: int = 64, ef: int = 120, shard_rows: int = 4096) -> DataFrame:
    """query_id, rank, id, score for the rows of df that is_query selects, against all rows."""
    rows = _vectors(df, id_col, vec_col)
    asked = _vectors(df.where(is_query), id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
    index = staged(build_index(rows, k + 1, shard_rows, m, ef_build), "index")
    return search_index(index, asked, k, m, ef).withColumnRenamed("id", id_col)
