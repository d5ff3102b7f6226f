"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Vectors are dealt to shards of about ``SHARD`` by a hash of their identifier, so neither copies nor
clusters crowd one. In a shard equal vectors are one node. The graph is built in batches: a greedy
beam search proposes what it finds and what it passes as neighbours of each node; pruning takes the
nearest candidate (of ``OPTIONS``) and drops those that are nearer to it, by the factor ``alpha``, than to the node,
until ``degree`` are taken; the edges are then laid backwards too and crowded nodes pruned again. A
first pass prunes by factor 1, a second by ``alpha``, which keeps diverse, longer edges. As a tight
group may keep all its edges to itself, searches begin at ``STARTS`` nodes that lie far apart: the
medoid, then again and again the node farthest from those taken.

Each query searches every shard by beam search; the best of all shards are kept, with distances
computed anew in double precision on the original vectors. Every vector is indexed; recall against
brute force is measured by tests. Vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without an identifier. Vectors of different length are never
compared. Rows that repeat an identifier are candidates each, but for queries of that identifier; as a
query such an identifier is asked once, with the least of its vectors. Ties go to the smaller
identifier among all that a shard's search found. Other columns play no part, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionlake.llm.scratch import stored

SHARD, DEGREE, BUILD_BEAM, BEAM, ALPHA = 16384, 32, 64, 64, 1.2
STARTS, OPTIONS = 48, 128  # of a shard; neighbours that pruning chooses from
QUERY_BLOCK = 512
SEEN = 1 << 25  # bytes of marks on nodes that a search has met
AT_ONCE = 4  # nodes of a beam whose neighbours are looked up in one step


def usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


class Graph:
    """A graph over the rows of data (double, so that near copies are told apart): edges, by node, -1 where there is none."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, starts: np.ndarray):
        self.data, self.edges, self.starts = data, edges, starts
        self.norm = np.einsum("nd,nd->n", data, data)
        self.looked_at = 0  # distances computed by searches

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the beam of nodes found, nearest first, and all nodes on the way to them; -1 where there are fewer."""
        step = max(1, SEEN // (len(self.data) + 1))
        found, way = zip(*(self._search(queries[at : at + step], beam) for at in range(0, len(queries), step)), strict=True)
        most = max(w.shape[1] for w in way)
        return np.concatenate(found), np.concatenate([np.pad(w, ((0, 0), (0, most - w.shape[1])), constant_values=-1) for w in way])

    def _search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        q, n = len(queries), len(self.data)
        rows = np.arange(q)[:, None]
        seen = np.zeros((q, n + 1), bool)  # the last for no node
        seen[:, [*self.starts, n]] = True
        node = np.full((q, beam), -1)
        far = np.full((q, beam), np.inf)
        first = self.norm[self.starts] - 2 * queries @ self.data[self.starts].T
        best = np.argsort(first, axis=1, kind="stable")[:, :beam]
        node[:, : best.shape[1]] = self.starts[best]
        far[:, : best.shape[1]] = np.take_along_axis(first, best, axis=1)
        self.looked_at += first.size
        open_ = np.zeros((q, beam), bool)
        open_[:, : min(best.shape[1], AT_ONCE)] = True
        way = [np.full((q, 1), -1)]
        while open_.any():
            # The beam is sorted, so the first open places are the nearest.
            pick = np.argsort(~open_, axis=1, kind="stable")[:, :AT_ONCE]
            live = np.take_along_axis(open_, pick, axis=1)
            np.put_along_axis(open_, pick, False, axis=1)
            way.append(np.where(live, np.take_along_axis(node, pick, axis=1), -1))
            next_ = np.where(live[:, :, None], self.edges[np.take_along_axis(node, pick, axis=1)], -1).reshape(q, -1)
            next_ = np.where(next_ < 0, n, next_)
            next_ = np.where(seen[rows, next_], n, next_)
            next_.sort(axis=1)
            next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = n
            seen[rows, next_] = True
            at, place = np.nonzero(next_ < n)
            if not len(at):
                continue
            found = next_[at, place]
            self.looked_at += len(found)
            away = np.full(next_.shape, np.inf)
            away[at, place] = self.norm[found] - 2 * np.einsum("nd,nd->n", queries[at], self.data[found])
            all_far = np.concatenate([far, away], axis=1)
            best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            far = np.take_along_axis(all_far, best, axis=1)
            node = np.take_along_axis(np.concatenate([node, np.where(next_ < n, next_, -1)], axis=1), best, axis=1)
            open_ = np.take_along_axis(np.concatenate([open_, next_ < n], axis=1), best, axis=1) & np.isfinite(far)
        return np.where(np.isfinite(far), node, -1), np.concatenate(way, axis=1)


def prune(data: np.ndarray, norm: np.ndarray, nodes: np.ndarray, options: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node at most degree of its options (-1: none), nearest first, without those that are alpha times nearer to one taken."""
    options = np.where(options == nodes[:, None], -1, options)
    options = np.sort(options, axis=1)
    options[:, 1:][options[:, 1:] == options[:, :-1]] = -1
    points = data[options]  # of -1 the last; not used
    far = norm[options] + norm[nodes][:, None] - 2 * np.einsum("nmd,nd->nm", points, data[nodes])
    far = np.where(options < 0, np.inf, np.maximum(far, 0))
    order = np.argsort(far, axis=1, kind="stable")[:, :OPTIONS]
    options, far, points = np.take_along_axis(options, order, axis=1), np.take_along_axis(far, order, axis=1), np.take_along_axis(points, order[:, :, None], axis=1)
    own = norm[options]
    alive = np.isfinite(far)
    rows = np.arange(len(nodes))
    taken = np.full((len(nodes), degree), -1)
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        taken[:, k] = np.where(some, options[rows, first], -1)
        between = own + own[rows, first][:, None] - 2 * np.einsum("nmd,nd->nm", points, points[rows, first])
        alive &= alpha * alpha * between > far
        alive[rows, first] = False
    return taken


def spread_out(data: np.ndarray, norm: np.ndarray, count: int) -> np.ndarray:
    """The medoid and nodes far apart from it and each other."""
    taken = [int(np.argmin(((data - data.mean(axis=0)) ** 2).sum(axis=1)))]
    least = np.full(len(data), np.inf)
    while len(taken) < min(count, len(data)):
        least = np.minimum(least, norm + norm[taken[-1]] - 2 * data @ data[taken[-1]])
        least[taken] = -np.inf
        taken.append(int(least.argmax()))
    return np.array(taken)


def build(data: np.ndarray, *, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, batch: int = 256, seed: int = 0) -> Graph:
    """data: distinct vectors, double."""
    n = len(data)
    rng = np.random.default_rng(seed)
    starts = spread_out(data, np.einsum("nd,nd->n", data, data), STARTS)
    if n <= degree + 1:
        every = np.tile(np.arange(n), (n, 1))
        every[np.arange(n), np.arange(n)] = -1
        return Graph(data, every, starts)
    edges = rng.integers(0, n, (n, degree))
    graph = Graph(data, edges, starts)
    for factor in (1.0, alpha):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            nodes = order[at : at + batch]
            options = np.concatenate([*graph.search(data[nodes], beam), edges[nodes]], axis=1)
            edges[nodes] = prune(data, graph.norm, nodes, options, degree, factor)
            _lay_back(graph, edges, nodes, factor)
    return graph


def _lay_back(graph: Graph, edges: np.ndarray, nodes: np.ndarray, factor: float) -> None:
    """For each of the edges of nodes one in the other direction; nodes that get too many are pruned."""
    degree = edges.shape[1]
    source, target = np.repeat(nodes, degree), edges[nodes].ravel()
    source, target = source[target >= 0], target[target >= 0]
    new = ~(edges[target] == source[:, None]).any(axis=1)
    source, target = source[new], target[new]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    if not len(target):
        return
    who, first, count = np.unique(target, return_index=True, return_counts=True)
    extra = np.full((len(who), count.max()), -1)
    extra[np.repeat(np.arange(len(who)), count), np.arange(len(target)) - np.repeat(first, count)] = source
    for at in range(0, len(who), 256):
        some = who[at : at + 256]
        options = np.concatenate([edges[some], extra[at : at + 256]], axis=1)
        full = (options >= 0).sum(axis=1) > degree
        if full.any():
            edges[some[full]] = prune(graph.data, graph.norm, some[full], options[full], degree, factor)
        if not full.all():  # there is room for all
            order = np.argsort(options[~full] < 0, axis=1, kind="stable")[:, :degree]
            edges[some[~full]] = np.take_along_axis(options[~full], order, axis=1)


INDEX = "dim int, bucket int, ids binary, places binary, data binary, edges binary, starts binary"


def index(vectors: DataFrame, shards: int) -> DataFrame:
    """vectors: id, dim, vec (array of float or double). A row for each shard and dimension: its graph."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        exact = np.stack(table.column("vec").to_numpy(zero_copy_only=False)).astype(np.float64)
        order = np.argsort(ids, kind="stable")
        ids, exact = ids[order], exact[order]
        _, first, back = np.unique(exact, axis=0, return_index=True, return_inverse=True)
        graph = build(exact[first])
        # The members of each node, by id: places[n] to places[n + 1] of ids.
        member = np.argsort(back.ravel(), kind="stable")
        places = np.concatenate([[0], np.cumsum(np.bincount(back.ravel(), minlength=len(first)))])
        out = [ids[member].astype("<i8"), places.astype("<i8"), exact[first].astype("<f8"), graph.edges.astype("<i4"), graph.starts.astype("<i4")]
        row = [table.column("dim")[0].as_py(), table.column("bucket")[0].as_py(), *(x.tobytes() for x in out)]
        return pa.table([pa.array([v], t) for v, t in zip(row, [pa.int32()] * 2 + [pa.binary()] * 5, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

    bucket = F.pmod(F.xxhash64(F.lit("shard"), "id", F.col("vec")[0]), F.lit(shards)).cast("int")
    # A shard is few bytes and much work: a number of tasks that Spark doesn't lower by size.
    n = max(shards, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return vectors.withColumn("bucket", bucket).repartition(n, "dim", "bucket").groupBy("dim", "bucket").applyInArrow(run, INDEX)


def _nearest(found: np.ndarray, places: np.ndarray, ids: np.ndarray, data: np.ndarray, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows of the nodes found, by exact distance, then id, without those of the query's id."""
    away = np.sqrt(((data[found] - query) ** 2).sum(axis=1))
    out_ids, out_far = [], []
    need, last = k, np.inf
    for node in np.argsort(away, kind="stable"):
        if away[node] > last:
            break
        members = ids[places[found[node]] : places[found[node] + 1]]
        members = members[members != query_id][:k]
        out_ids.append(members)
        out_far.append(np.full(len(members), away[node]))
        need -= len(members)
        if need <= 0:
            last = away[node]  # others as far may have lesser ids
    out_ids, out_far = np.concatenate(out_ids), np.concatenate(out_far)
    order = np.lexsort([out_ids, out_far])[:k]
    return out_ids[order], out_far[order]


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 10, beam: int = BEAM, shard: int = SHARD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each of queries (columns as of vectors) its k nearest of vectors: query_id, rank (from 1), vec_id, score (Euclidean distance)."""
    spark = vectors.sparkSession

    def clean(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        return rows.filter(F.col("id").isNotNull() & usable(F.col("vec"))).withColumn("dim", F.size("vec"))

    given = stored(clean(vectors), "ann-vectors")
    shards = max(1, -(-given.count() // shard))
    graphs = stored(index(given, shards), "ann-index")
    asked = clean(queries).groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    # All queries meet each shard, in blocks: a copy of each block for each shard, joined by the shard.
    block = F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)).alias("block")
    dealt = asked.groupBy("dim", block).agg(F.collect_list(F.struct("id", "vec")).alias("asked"))
    dealt = dealt.select("dim", F.col("asked.id").alias("query_ids"), F.flatten("asked.vec").alias("flat"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("bucket"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = dealt.repartition(n, "dim", "bucket").join(graphs.repartition(n, "dim", "bucket").hint("shuffle_hash"), ["dim", "bucket"])

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                dim, query_ids, flat, ids, places, data, edges, starts = (batch.column(c)[at] for c in ("dim", "query_ids", "flat", "ids", "places", "data", "edges", "starts"))
                dim = dim.as_py()
                query_ids, flat = query_ids.values.to_numpy(), flat.values.to_numpy().reshape(-1, dim)
                ids, places = np.frombuffer(ids.as_buffer(), "<i8"), np.frombuffer(places.as_buffer(), "<i8")
                data = np.frombuffer(data.as_buffer(), "<f8").reshape(-1, dim)
                graph = Graph(data, np.frombuffer(edges.as_buffer(), "<i4").reshape(len(data), -1).astype(np.int64), np.frombuffer(starts.as_buffer(), "<i4").astype(np.int64))
                nodes = graph.search(flat, max(beam, 2 * k))[0]
                got = [(q, *_nearest(f[f >= 0], places, ids, data, v, q, k)) for q, f, v in zip(query_ids.tolist(), nodes, flat, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _, _ in got], [len(i) for _, i, _ in got]), pa.int64()), pa.array(np.concatenate([i for _, i, _ in got]), pa.int64()), pa.array(np.concatenate([f for _, _, f in got]), pa.float64())], names=["query_id", "vec_id", "score"])

    near = pairs.select("dim", "query_ids", "flat", "ids", "places", "data", "edges", "starts").mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
