"""Approximate nearest neighbours in robust-pruned directed graphs (largest inner product).

Equal vectors are one node with the smallest ids that hold it: no more than the neighbours asked for
and one, as larger ids lose every tie. Nodes are dealt to shards by a hash; each task builds one
shard's graph and stores it. Every query searches every shard by a beam, and the best of all shards
are its neighbours.

The largest inner product is the least Euclidean distance after one more coordinate is added that
gives all nodes of a shard the same length (queries have zero there). Graphs are built by that distance;
the coordinate is kept less that length, so it is small for short vectors however long the longest is.
Queries rank nodes by the inner product itself, and double their beam until their best nodes stay. A graph starts with random
edges. Nodes are then taken in random order, in batches: a greedy beam search from the node nearest
to the mean and a few random ones proposes neighbours; pruning keeps the closest and drops those that are, ``ALPHA`` times
over, closer to a kept one; edges are added backwards and pruned likewise. All searches of a batch
advance together, as array operations.

A vector that is null, zero or empty, or holds null or non-finite components, or whose length is not
the most frequent one (the smaller if tied), takes no part. Rows that repeat an id count as one node
each but as one candidate. Null ids take no part. No queries or no candidates give no rows.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

DEGREE = 32
#: Neighbours that backward edges may add up to before a list is pruned, and random ones at the start.
MOST = 48
RANDOM = 24
#: Nodes from which a search starts: the one nearest to the mean, random ones, and the longest ones, which have
#: large products with many queries.
ENTRIES = 16
LONGEST = 48
BEAM = 64
SEARCH_BEAM = 128
#: Nodes of a beam that a query expands at once.
EXPANDED = 4
ALPHA = 1.2
BATCH = 512
#: Nodes of a shard, and queries that one task puts to a shard.
SHARD_ROWS = 16_384
BLOCK_QUERIES = 50_000
SALTS = 64


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vec): rows that take part, vectors as doubles."""
    vec = F.col(vector_column).cast("array<double>")
    rows = rows.select(F.col(id_column).cast("long").alias("id"), vec.alias("vec")).where("id is not null and vec is not null")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists("vec", lambda x: x != 0))
    width = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("vec") == (width["d"] if width else 0))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(vec, members): each vector once, with its ``keep`` smallest ids in order.

    A vector held by a large share of the rows is thinned in salted parts first.
    """
    code = F.sha2(F.to_json(F.struct("vec")), 256)
    rows = rows.select("id", "vec", code.alias("code"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).dropDuplicates(["code", "id"])
    part = Window.partitionBy("code", "salt").orderBy("id")
    few = rows.withColumn("place", F.row_number().over(part)).where(F.col("place") <= keep)
    whole = Window.partitionBy("code").orderBy("id")
    few = few.withColumn("place", F.row_number().over(whole)).where(F.col("place") <= keep)
    return few.groupBy("code").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("members")).drop("code")


class Graph:
    """One shard: ``points`` (with the added, shifted coordinate), ``edges`` padded with -1, nodes to start from."""

    def __init__(self, points: np.ndarray, edges: np.ndarray, entries: np.ndarray):
        self.points, self.edges, self.entries = points, edges, entries
        self.squares = np.einsum("ij,ij->i", points, points)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, squared distances), nearest first, -1 and inf where fewer were met."""
        n, m = len(queries), len(self.points)
        beam = min(max(beam, len(self.entries)), m)
        rows = np.arange(n)
        nodes = np.full((n, beam), -1, np.int64)
        dist = np.full((n, beam), np.inf, np.float32)
        done = np.ones((n, beam), bool)
        own = np.einsum("ij,ij->i", queries, queries)
        first = own[:, None] + self.squares[self.entries] - 2 * (queries @ self.points[self.entries].T)
        order = np.argsort(first, axis=1, kind="stable")
        ahead = len(self.entries)
        nodes[:, :ahead] = self.entries[order]
        dist[:, :ahead] = np.take_along_axis(first, order, axis=1)
        done[:, :ahead] = False
        met = np.zeros((n, m + 1), bool)  # the last column stands for no node
        met[:, self.entries] = True
        active = rows
        while len(active):
            at = np.argmin(done[active], axis=1)  # the nearest not yet expanded
            open_ = ~done[active, at]
            active, at = active[open_], at[open_]
            if not len(active):
                break
            done[active, at] = True
            near = self.edges[nodes[active, at]]
            fresh = (near >= 0) & ~met[active[:, None], near]
            met[active[:, None], near] = True
            dots = (self.points[near] @ queries[active][:, :, None])[:, :, 0]
            gap = own[active][:, None] + self.squares[near] - 2 * dots
            gap[~fresh] = np.inf
            all_dist = np.concatenate([dist[active], gap], axis=1)
            order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
            pick = lambda a, b: np.take_along_axis(np.concatenate([a, b], axis=1), order, axis=1)
            dist[active] = np.take_along_axis(all_dist, order, axis=1)
            nodes[active] = pick(nodes[active], np.where(fresh, near, -1))
            done[active] = pick(done[active], ~fresh)
        return nodes, dist

    def best(self, queries: np.ndarray, k: int, beam: int) -> np.ndarray:
        """Nodes by falling inner product, at least the ``k`` first ones settled; -1 where fewer were met.

        The beam of a query is doubled until its ``k`` best stay the same, or it holds all nodes. A doubled beam
        goes on from the nodes met so far.
        """
        n, m = len(queries), len(self.points)
        out = np.full((n, beam), -1, np.int64)
        products = np.full((n, m + 1), -np.inf, np.float32)  # of the nodes met; the last column stands for no node
        products[:, self.entries] = queries @ self.points[self.entries].T
        done = np.zeros((n, m + 1), bool)
        todo, last = np.arange(n), None
        while len(todo):
            nodes = self._settled(queries, products, done, todo, min(max(beam, len(self.entries)), m))
            keep = min(out.shape[1], nodes.shape[1])
            out[todo, :keep] = nodes[:, :keep]
            if beam >= m:
                break
            moved = np.ones(len(todo), bool) if last is None else (nodes[:, :k] != last).any(axis=1)
            todo, last = todo[moved], nodes[moved, :k]
            beam *= 2
        return out

    def _settled(self, queries: np.ndarray, products: np.ndarray, done: np.ndarray, rows: np.ndarray, beam: int) -> np.ndarray:
        """The beams of some queries, best first, when all their nodes are expanded; notes what was met and expanded."""
        met = -products[rows, :-1]
        nodes = np.argpartition(met, beam - 1, axis=1)[:, :beam]
        gap = np.take_along_axis(met, nodes, axis=1)
        closed = done[rows[:, None], nodes] | np.isinf(gap)
        some = min(EXPANDED, beam)
        stamp = np.empty(products.shape, np.int32)
        active = np.arange(len(rows))
        while True:
            active = active[~closed[active].all(axis=1)]
            if not len(active):
                break
            who, line = rows[active], np.arange(len(active))[:, None]
            first = np.argpartition(np.where(closed[active], np.inf, gap[active]), some - 1, axis=1)[:, :some]
            open_ = ~closed[active[:, None], first]
            at = np.where(open_, nodes[active[:, None], first], -1)
            closed[active[:, None], first] = True
            done[who[:, None], at] = True
            near = np.where(open_[:, :, None], self.edges[at], -1).reshape(len(active), -1)
            # Met by two of the expanded nodes, a node counts at one of its places.
            places = np.arange(near.shape[1])
            stamp[line, near] = places
            fresh = (near >= 0) & np.isinf(products[who[:, None], near]) & (stamp[line, near] == places)
            r, c = np.nonzero(fresh)
            new = near[r, c]
            dots = np.einsum("ij,ij->i", self.points[new], queries[who[r]])
            products[who[r], new] = dots
            more = np.full(near.shape, np.inf, np.float32)
            more[r, c] = -dots
            all_gaps = np.concatenate([gap[active], more], axis=1)
            kept = np.argpartition(all_gaps, beam - 1, axis=1)[:, :beam]
            pick = lambda a, b: np.take_along_axis(np.concatenate([a, b], axis=1), kept, axis=1)  # noqa: B023, E731
            gap[active] = np.take_along_axis(all_gaps, kept, axis=1)
            nodes[active] = pick(nodes[active], near)
            closed[active] = pick(closed[active], ~fresh)
        order = np.lexsort((nodes, gap), axis=1)
        return np.take_along_axis(np.where(np.isinf(gap), -1, nodes), order, axis=1)


def prune(points: np.ndarray, centre: np.ndarray, nodes: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Rows of at most ``degree`` diverse neighbours of ``centre`` out of ``nodes`` (-1: none)."""
    order = np.argsort(nodes, axis=1, kind="stable")
    nodes = np.take_along_axis(nodes, order, axis=1)
    alive = (nodes >= 0) & (nodes != centre[:, None])
    alive[:, 1:] &= nodes[:, 1:] != nodes[:, :-1]
    cand = points[np.maximum(nodes, 0)]
    own = ((cand - points[centre][:, None, :]) ** 2).sum(axis=2, dtype=np.float32)
    square = np.einsum("ijk,ijk->ij", cand, cand)
    dots = cand @ cand.transpose(0, 2, 1)
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for k in range(degree):
        left = np.where(alive, own, np.inf)
        best = left.argmin(axis=1)
        ok = alive[rows, best]
        if not ok.any():
            break
        out[ok, k] = nodes[rows, best][ok]
        between = square + square[rows, best][:, None] - 2 * dots[rows, best]
        alive &= alpha**2 * between > own
        alive[rows, best] = False
    return out


def _padded(nodes: np.ndarray) -> np.ndarray:
    return np.pad(nodes, ((0, 0), (0, MOST - nodes.shape[1])), constant_values=-1)


def _once(nodes: np.ndarray) -> np.ndarray:
    """Each row's nodes without repetition, before the places that are left."""
    nodes = np.sort(nodes, axis=1)
    nodes[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = -1
    return np.take_along_axis(nodes, np.argsort(nodes < 0, axis=1, kind="stable"), axis=1)


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 3) -> Graph:
    """Graph over the rows of ``vectors``."""
    lengths = (vectors**2).sum(axis=1)
    longest = lengths.max(initial=0)
    # The root of what is missing to the longest, less the longest's length.
    extra = -lengths / np.maximum(np.sqrt(longest) + np.sqrt(np.maximum(longest - lengths, 0)), 1e-300)
    points = np.hstack([vectors, extra[:, None]]).astype(np.float32)
    n = len(points)
    rng = np.random.default_rng(seed)
    width = min(RANDOM, max(n - 1, 1))
    edges = np.full((n, MOST), -1, np.int64)
    if n > 1:
        edges[:, :width] = _once((np.arange(n)[:, None] + rng.integers(1, n, (n, width))) % n)
    order = rng.permutation(n)
    middle = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    longest_nodes = np.argsort(-lengths, kind="stable")[:LONGEST]
    graph = Graph(points, edges, np.unique(np.concatenate([order[: ENTRIES - 1], [middle], longest_nodes])))
    for i in range(0, n, BATCH):
        batch = order[i : i + BATCH]
        found, _ = graph.search(points[batch], beam)
        edges[batch] = _padded(prune(points, batch, np.hstack([found, edges[batch]]), degree, alpha))
        # Backward edges: grouped by their new start, at most ``beam`` of the batch at once for each.
        start, end = edges[batch].ravel(), np.repeat(batch, MOST)
        start, end = start[start >= 0], end[edges[batch].ravel() >= 0]
        by = np.lexsort((end, start))
        start, end = start[by], end[by]
        firsts = np.flatnonzero(np.r_[True, start[1:] != start[:-1]]) if len(start) else np.zeros(0, int)
        place = np.arange(len(start)) - np.repeat(firsts, np.diff(np.r_[firsts, len(start)]))
        for low in range(0, int(place.max(initial=-1)) + 1, beam):
            part = (place >= low) & (place < low + beam)
            heads, row = np.unique(start[part], return_inverse=True)
            more = np.full((len(heads), min(beam, int(place[part].max()) - low + 1)), -1, np.int64)
            more[row, place[part] - low] = end[part]
            both = np.hstack([edges[heads], more])
            both = _once(both)
            full = (both >= 0).sum(axis=1) > MOST
            edges[heads[~full]] = both[~full, :MOST]
            for j in range(0, int(full.sum()), BATCH):
                own = heads[full][j : j + BATCH]
                edges[own] = _padded(prune(points, own, both[full][j : j + BATCH], degree, alpha))
    return graph


def _stack(column: pd.Series, kind=np.float64) -> np.ndarray:
    return np.array(column.tolist(), kind)


def index(rows: DataFrame, members: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, node, vec, members, extra, edges, entry): the stored graphs over rows (id, vec)."""
    nodes = written(distinct_vectors(rows, members), "vectors")
    shards = max(1, -(-nodes.count() // shard_rows))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64(F.col("members")[0]), F.lit(shards)).cast("int"))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("members", key=lambda c: c.str[0], ignore_index=True)
        graph = build(_stack(own["vec"]))
        own["node"] = np.arange(len(own), dtype=np.int32)
        own["extra"] = graph.points[:, -1].astype(float)
        own["edges"] = list(graph.edges.astype(np.int32))
        own["entry"] = np.isin(own["node"], graph.entries)
        return own[["shard", "node", "vec", "members", "extra", "edges", "entry"]]

    schema = "shard int, node int, vec array<double>, members array<long>, extra double, edges array<int>, entry boolean"
    return written(dealt.groupBy("shard").applyInPandas(run, schema), "graph")


def nearest(graphs: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` best found for each of the queries (id, vec)."""
    queries = queries.dropDuplicates(["id"])
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    last = graphs.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0]
    # Each query goes to each shard: the question itself, in blocks.
    asked = queries.select(
        "id", "vec", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(last))).alias("shard"),
    )
    held = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if own.empty or asked.empty:
            return empty
        own = own.sort_values("node", ignore_index=True)
        vectors = _stack(own["vec"])
        points = np.hstack([vectors, own["extra"].to_numpy()[:, None]]).astype(np.float32)
        graph = Graph(points, _stack(own["edges"], np.int64), np.flatnonzero(own["entry"]))
        holders = own["members"].tolist()
        out = []
        for i in range(0, len(asked), 256):
            part = asked.iloc[i : i + 256]
            vec = _stack(part["vec"])
            found = graph.best(np.hstack([vec, np.zeros((len(vec), 1))]).astype(np.float32), k + 1, max(beam, k + 1))
            for own_id, q, nodes in zip(part["id"].tolist(), vec, found):
                nodes = nodes[nodes >= 0]
                score = (vectors[nodes] * q).sum(axis=1)
                ids = np.concatenate([holders[x] for x in nodes])
                score = np.repeat(score, [len(holders[x]) for x in nodes])
                score, ids = score[ids != own_id], ids[ids != own_id]
                best = np.lexsort((ids, -score))[:k]
                out.append((np.full(len(best), own_id), ids[best], score[best]))
        q, ids, score = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"query_id": q, "id": ids.astype(np.int64), "score": score})

    found = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    # An id that is repeated with several vectors counts once, by its best.
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
