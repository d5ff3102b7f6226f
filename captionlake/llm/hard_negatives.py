"""Hard negatives by inner products that are given up early.

Candidates are dealt to shards of about ``CELLS`` components by a hash of their identifier. A shard
turns its vectors by an orthogonal matrix whose leading axes carry the most of their squared length
(its principal axes through the origin). A block of anchors meets each shard. For a pair, the product
over the leading components, and the product of the lengths of what remains, bound the whole product
from both sides, but for rounding, for which slack is added; a pair that can't be among the results is
discarded, the others go on to the next components. Those left at the end are verified by the product
of the integers themselves, so results don't depend on the rotation or on rounding.

Two rounds: positives, the highest products of the anchor's label; then, for each positive, the
highest of other labels in its window. In each the best of a shard go on, and the best of those stay.

Integer vectors whose squared length is 2^63 or more take no part, as products wouldn't fit a long.
Rows without identifier, label or vector, or with a null or non-finite component, take no part.
Vectors of different length never meet. Rows that repeat an identifier are candidates each, but never
for an anchor of that identifier; an anchor that repeats is asked once, with its least label and
vector. Ties go to the smaller identifier. An empty table gives no rows. Other columns play no part,
whatever they are called.

Equal vectors of one label are one node in a shard, with the first identifiers that any anchor can
ask for, so a vector that a third of all rows have is compared once a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionlake.llm.scratch import stored

CELLS = 1 << 20  # components of a shard: 16,384 vectors of 64
BLOCK = 1024  # anchors that meet a shard at once
AT_ONCE = 1 << 20  # pairs or components that one numpy step holds
FIRST = 128  # nodes of the first step, before there is anything to discard by; each step has twice those of the last
LIMIT = float(1 << 63)
LEAST, MOST = -(1 << 63) + 1, (1 << 63) - 1


def quantised(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component, in double precision; null where the vector takes no part."""
    x = lambda v: v.cast("double")
    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < float(1 << 32) / factor))
    return F.when(F.coalesce(whole, F.lit(False)), F.transform(vector, lambda v: F.floor(x(v) * factor).cast("long")))


def usable(rows: DataFrame) -> DataFrame:
    """rows: id, label, vec (integers). Those that take part, with dim."""
    length = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    return rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & (length < LIMIT)).select("id", "label", "vec", F.size("vec").alias("dim"))


def bands(dim: int) -> list[int]:
    """Where bounds are looked at: after so many leading components, at last after all."""
    return sorted({max(1, dim // 8), max(1, dim // 4), max(1, dim // 2), max(1, dim)})


def principal_axes(vectors: np.ndarray) -> np.ndarray:
    """An orthogonal matrix: its columns are the axes, that of the most squared length first."""
    return np.ascontiguousarray(np.linalg.eigh(vectors.T @ vectors)[1][:, ::-1])


def slack_of(axes: np.ndarray) -> float:
    """What rounding, and axes that aren't quite orthogonal, may add to a product of vectors of length one."""
    d = len(axes)
    return 16 * (d + 8) ** 1.5 * 2.0**-53 + 2 * float(np.linalg.norm(axes.T @ axes - np.eye(d)))


def residuals(turned: np.ndarray) -> np.ndarray:
    """For each vector, the length of what remains after each band."""
    square = turned * turned
    return np.sqrt(np.stack([square[:, b:].sum(axis=1) for b in bands(turned.shape[1])], axis=1))


def _products(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """a[i] times b[j], row by row."""
    step = max(1, AT_ONCE // max(1, a.shape[1]))
    found = [np.einsum("nd,nd->n", a[i[at : at + step]], b[j[at : at + step]]) for at in range(0, len(i), step)]
    return np.concatenate(found) if found else np.empty(0, np.result_type(a, b))


class Shard:
    """vectors: integers, distinct for each label; places[n] to places[n + 1] of ids are the members of node n."""

    def __init__(self, ids: np.ndarray, places: np.ndarray, labels: np.ndarray, vectors: np.ndarray, turned: np.ndarray, axes: np.ndarray):
        self.ids, self.places, self.labels, self.vectors, self.turned, self.axes = ids, places, labels, vectors, turned, axes
        self.left, self.slack = residuals(turned), slack_of(axes)
        self.length = np.sqrt((turned * turned).sum(axis=1))
        self.verified = 0  # pairs whose integers were multiplied

    def best(self, anchors: np.ndarray, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, ...]:
        """For each anchor and each of its windows (columns of low and high; none where low > high) its k best candidates of the same label, or of others: anchor, window, id, score."""
        q, windows = low.shape
        turned = anchors.astype(np.float64) @ self.axes
        left, length = residuals(turned), np.sqrt((turned * turned).sum(axis=1))
        cut = bands(turned.shape[1])
        held = [np.empty(0, np.int64)] * 3  # slot, score, id
        least = np.nextafter(np.where(low <= high, low, MOST).astype(np.float64), -np.inf)
        most = np.nextafter(np.where(low <= high, high, LEAST).max(axis=1).astype(np.float64), np.inf)
        at, step, most_step = 0, min(FIRST, AT_ONCE // max(1, q)), AT_ONCE // max(1, q)
        while at < len(self.labels):
            step = max(1, step)
            some = slice(at, at + step)
            need = least.min(axis=1)
            part = turned[:, : cut[0]] @ self.turned[some, : cut[0]].T
            room = left[:, :1] * self.left[some, 0] + self.slack * length[:, None] * self.length[some]
            alive = (labels[:, None] == self.labels[some]) == same
            alive &= (part + room >= need[:, None]) & (part - room <= most[:, None])
            i, j = np.nonzero(alive)
            product = part[i, j]
            j += at
            for b in range(1, len(cut)):
                product += _products(turned[:, cut[b - 1] : cut[b]], i, self.turned[:, cut[b - 1] : cut[b]], j)
                room = left[i, b] * self.left[j, b] + self.slack * length[i] * self.length[j]
                stay = (product + room >= need[i]) & (product - room <= most[i])
                i, j, product = i[stay], j[stay], product[stay]
            if len(i):
                held = self._kept(held, i, j, _products(anchors, i, self.vectors, j), ids, low, high, k)
                slot, score, _ = held
                last = np.flatnonzero(np.append(slot[1:] != slot[:-1], True))
                full = np.diff(np.append(-1, last)) == k
                kth = np.nextafter(score[last[full]].astype(np.float64), -np.inf)
                at_slot = np.unravel_index(slot[last[full]], least.shape)
                least[at_slot] = np.maximum(least[at_slot], kth)
            self.verified += len(i)
            at, step = at + step, min(2 * step, most_step)
        slot, score, found = held
        return slot // windows, slot % windows, found, score

    def _kept(self, held: list[np.ndarray], i: np.ndarray, j: np.ndarray, score: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[np.ndarray]:
        """held and the members of new pairs of anchors i and nodes j, of each slot the k best in order."""
        windows = low.shape[1]
        slots, scores, nodes = [], [], []
        for w in range(windows):
            inside = (score >= low[i, w]) & (score <= high[i, w])
            slots.append(i[inside] * windows + w)
            scores.append(score[inside])
            nodes.append(j[inside])
        slot, score, node = (np.concatenate(x) for x in (slots, scores, nodes))
        count = self.places[node + 1] - self.places[node]
        first = np.repeat(self.places[node] - np.append(0, np.cumsum(count)[:-1]), count)
        member = self.ids[first + np.arange(len(first))]
        slot, score = np.repeat(slot, count), np.repeat(score, count)
        other = member != ids[slot // windows]
        slot, score, member = (np.concatenate([h, x[other]]) for h, x in zip(held, (slot, score, member), strict=True))
        order = np.lexsort([member, -score, slot])
        slot = slot[order]
        begin = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.empty(0, np.int64)
        rank = np.arange(len(slot)) - np.repeat(begin, np.diff(np.append(begin, len(slot))))
        return [slot[rank < k], score[order][rank < k], member[order][rank < k]]


def build(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """What a Shard is made of, longest vectors first. Of a node's members 2k stay, k of one identifier at most: for any anchor these hold the first k others."""
    both, back = np.unique(np.column_stack([labels, vectors]), axis=0, return_inverse=True)
    order = np.lexsort([ids, back.ravel()])
    node, ids = back.ravel()[order], ids[order]
    for key, most in ((ids, k), (node, 2 * k)):
        new = np.append(True, (node[1:] != node[:-1]) | (key[1:] != key[:-1]))
        begin = np.flatnonzero(new)
        stay = np.arange(len(node)) - np.repeat(begin, np.diff(np.append(begin, len(node)))) < most
        node, ids = node[stay], ids[stay]
    labels, vectors = both[:, 0], np.ascontiguousarray(both[:, 1:])
    exact = vectors.astype(np.float64)
    longest = np.argsort(-(exact * exact).sum(axis=1), kind="stable")
    place = np.empty(len(longest), np.int64)
    place[longest] = np.arange(len(longest))
    order = np.argsort(place[node], kind="stable")
    places = np.append(0, np.cumsum(np.bincount(place[node], minlength=len(longest))))
    axes = principal_axes(exact)
    return ids[order], places, labels[longest], vectors[longest], exact[longest] @ axes, axes


INDEX = "dim int, bucket int, ids binary, places binary, labels binary, vectors binary, turned binary, axes binary"
_KINDS = ("<i8", "<i8", "<i8", "<i8", "<f8", "<f8")


def index(rows: DataFrame, shards: int, k: int) -> DataFrame:
    """rows: of usable. A row for each shard and dimension."""

    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        vectors = table.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, dim) if dim else np.zeros((table.num_rows, 1), np.int64)
        made = build(table.column("id").to_numpy(), table.column("label").to_numpy(), vectors, k)
        row = [dim, table.column("bucket")[0].as_py(), *(x.astype(t).tobytes() for x, t in zip(made, _KINDS, strict=True))]
        return pa.table([pa.array([v], t) for v, t in zip(row, [pa.int32()] * 2 + [pa.binary()] * 6, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])

    bucket = F.pmod(F.xxhash64(F.lit("shard"), "id", F.get("vec", F.lit(0))), F.lit(shards)).cast("int")
    # A shard is few bytes and much work: a number of tasks that Spark doesn't lower by size.
    n = max(shards, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vec", "dim", bucket.alias("bucket")).repartition(n, "dim", "bucket").groupBy("dim", "bucket").applyInArrow(run, INDEX)


def sweep(shards: DataFrame, anchors: DataFrame, n_shards: int, same: bool, k: int) -> DataFrame:
    """anchors: id, label, vec, dim, windows (array of low, high). anchor_id, window, id, score: the best of each shard."""
    spark = shards.sparkSession
    blocks = max(1, -(-anchors.count() // BLOCK))
    block = F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)).alias("block")
    dealt = anchors.groupBy("dim", block).agg(F.collect_list(F.struct("id", "label", "vec", "windows")).alias("asked"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    copied = dealt.select("dim", "asked", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("bucket"))
    pairs = copied.repartition(n, "dim", "bucket").join(shards.repartition(n, "dim", "bucket").hint("shuffle_hash"), ["dim", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                dim = batch.column("dim")[at].as_py() or 1
                made = [np.frombuffer(batch.column(c.split()[0])[at].as_buffer(), t) for c, t in zip(INDEX.split(", ")[2:], _KINDS, strict=True)]
                shard = Shard(*made[:3], *(x.reshape(-1, dim) for x in made[3:]))
                asked = batch.column("asked")[at].values
                own = lambda f, asked=asked: asked.field(f).to_numpy()
                windows = asked.field("windows")
                count = windows.value_lengths().to_numpy()
                flat = windows.flatten()
                low, high = np.full((len(asked), max(1, count.max(initial=0))), MOST), np.full((len(asked), max(1, count.max(initial=0))), LEAST)
                there = np.arange(low.shape[1]) < count[:, None]
                low[there], high[there] = flat.field("low").to_numpy(), flat.field("high").to_numpy()
                vectors = asked.field("vec").flatten().to_numpy()
                vectors = vectors.reshape(-1, dim) if len(vectors) else np.zeros((len(asked), dim), np.int64)
                who, window, found, score = shard.best(vectors, own("id"), own("label"), low, high, same, k)
                yield pa.RecordBatch.from_arrays([pa.array(own("id")[who], pa.int64()), pa.array(window, pa.int32()), pa.array(found, pa.int64()), pa.array(score, pa.int64())], names=["anchor_id", "window", "id", "score"])

    names = [c.split()[0] for c in INDEX.split(", ")[2:]]
    return pairs.select("dim", "asked", *names).mapInArrow(run, "anchor_id long, window int, id long, score long")


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5) -> DataFrame:
    """rows, anchors: id, label, vec (array of long). anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A negative's product is at most the positive's and at least 80 % of it.
    """
    spark = rows.sparkSession
    given = stored(usable(rows), "mining-vectors")
    shards = max(1, -(-(given.agg(F.sum("dim")).first()[0] or 0) // CELLS))
    made = stored(index(given, shards, max(positives, negatives)), "mining-shards")
    once = usable(anchors).groupBy("id", "dim").agg(F.min(F.struct("label", "vec")).alias("x")).groupBy("id").agg(F.min(F.struct("dim", "x")).alias("y"))
    asked = stored(once.select(F.col("id").cast("long").alias("id"), F.col("y.x.label").cast("long").alias("label"), F.col("y.x.vec").alias("vec"), F.col("y.dim").alias("dim")), "mining-anchors")
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    every = F.array(F.struct(F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")))
    near = sweep(made, asked.withColumn("windows", every), shards, True, positives)
    chosen = stored(near.withColumn("n", best("anchor_id")).filter(F.col("n") <= positives).select("anchor_id", F.col("id").alias("positive_id"), "score", F.col("n").cast("int").alias("n")), "mining-positives")
    # 80 p <= 100 n is n >= p - floor(p / 5); below zero there is no such n up to p.
    window = F.struct("n", (F.col("score") - F.expr("score div 5")).alias("low"), F.col("score").alias("high"))
    windows = chosen.filter("score >= 0").groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(window)).alias("w"))
    again = asked.join(windows, "id").select("id", "label", "vec", "dim", F.transform("w", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"))).alias("windows"))
    far = sweep(made, again, shards, False, negatives)
    ranked = far.withColumn("rank", best("anchor_id", "window")).filter(F.col("rank") <= negatives)
    # A positive's window is its place among those at zero or above, and these come first.
    told = ranked.join(chosen.select("anchor_id", (F.col("n") - 1).alias("window"), "positive_id", F.col("score").alias("positive_score")), ["anchor_id", "window"])
    return told.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
