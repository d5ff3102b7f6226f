"""SimHash fingerprints of word shingles, and near-duplicates by tiled exact comparison.

A text is lower-cased (A-Z only) and cut into words at ASCII white space. Each shingle of ``words``
words in a row, repeats included, is joined by spaces and hashed by XXH64 with seed 42 over UTF-8;
a text of fewer words is one shingle. A bit of the fingerprint is 1 if it is set in more than half
of the hashes. A text without words (a null too) has the fingerprint zero, linked like any other.

Comparison: equal fingerprints meet first. The distinct ones are dealt to tiles by the population
counts of their sub-words, large classes to several tiles. Two fingerprints differ in at least as
many bits as their population counts do, summed over the sub-words, so tile pairs whose counts
differ beyond the radius are skipped; in all others every pair is compared by numpy exclusive-or
and bit counts. A tile pair returns a star for each of its connected groups, not all their pairs,
so a dense group costs a row for each member. All links are found, whatever the group sizes.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionlake.llm.graph import components
from captionlake.llm.scratch import stored

SEED = 42
TILE = 4096
BLOCK = 1 << 20
#: Members of a group, and shingles of them, that are compared with so many others at once; bits of the filter for texts.
PART, PART_SHINGLES, FILTER = 512, 1 << 20, 1 << 25
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about a megabyte of it at a time."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + BLOCK)
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()
        at = end


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, in order, in blocks."""
    digest, held, met = xxhash.xxh64_intdigest, [], False
    for block in word_blocks(text):
        held += block
        n = len(held) - words + 1
        if n > 0:
            met = True
            parts = zip(*(held[i : i + n] for i in range(words)), strict=True)
            yield np.fromiter((digest(b" ".join(p), SEED) for p in parts), np.uint64, n)
            held = held[n:]
    if held and not met:
        yield np.array([digest(b" ".join(held), SEED)], np.uint64)


def _mixed(hashes: np.ndarray, n: int) -> np.ndarray:
    """The n-th hash made of each hash (splitmix64); the 0th is itself."""
    if not n:
        return hashes
    z = hashes + np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _majority(blocks: Iterable[np.ndarray], size: int) -> np.ndarray:
    """The bits set in more than half of the hashes, as size signed 64-bit numbers. The first is of the hashes, others of hashes of these."""
    ones, n = np.zeros((size, 64), np.int64), 0
    for hashes in blocks:
        n += len(hashes)
        for i in range(size):
            bits = np.unpackbits(_mixed(hashes, i).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            whole = len(bits) // 255 * 255  # so many that a byte can count them
            ones[i] += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            ones[i] += bits[whole:].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.int64)[:, 0]


def fingerprint(text: bytes, words: int, size: int = 1) -> np.ndarray:
    """A text's fingerprint as size signed 64-bit numbers, of all its shingles, repeats included."""
    return _majority(shingle_hashes(text, words), size)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order of size."""
    found = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def _set_name(own: np.ndarray) -> int:
    """A hash of a set of shingles, as a signed long."""
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - 2**63


def fingerprints(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each of docs: id_col and fp (a signed long)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words)[0] for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _class(fp: Column, parts: int, width: int) -> list[Column]:
    """The population counts of the parts equal sub-words of fp, in steps of width."""
    bits = 64 // parts
    mask = F.lit((1 << bits) - 1) if parts > 1 else F.lit(-1)
    return [F.floor(F.bit_count(F.shiftrightunsigned(fp, i * bits).bitwiseAND(mask)) / width).cast("int") for i in range(parts)]


def _size_class(n: Column, similarity: float) -> Column:
    """Sets of so many members have this similarity only if their classes are at most one apart."""
    return F.floor(F.log(F.greatest(n, F.lit(1))) / (1.0001 * -math.log(similarity))).cast("int")


def _steps(parts: int, radius: int, sized: bool) -> list[list[int]]:
    """Differences of classes within the radius (and a step of size), of each two opposite ones the first that isn't below zero."""
    near = [[*d] for d in itertools.product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius]
    if sized:
        near = [[n, *d] for n in (-1, 0, 1) for d in near]
    return [d for d in near if d >= [0] * len(d)]


def _joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merges the groups of u[i] and v[i]; label holds each node's least known companion, and its own for that."""
    while True:
        a, b = label[u], label[v]
        if not (open_ := a != b).any():
            return
        a, b = a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (up := label[label]).tobytes() != label.tobytes():
            label[:] = up


def tile_links(left: np.ndarray, right: np.ndarray, same: bool, radius: int, more: tuple[np.ndarray, np.ndarray] | None = None, within: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the groups that links between two tiles make (or within one, if they are the same).

    The places of members and of their stars' centres, those of right after those of left. more: the
    further words of both sides; then links are those that also differ in at most within bits of all.
    """
    n, m = len(left), len(right)
    label = np.arange(n if same else n + m)
    step = max(1, (1 << 17) // max(1, m))
    for at in range(0, n, step):
        far = np.bitwise_count(left[at : at + step, None] ^ right[None, :])
        if same or (far <= radius).any():
            u, v = np.nonzero(far <= radius)
            if more is not None and len(u):
                near = far[u, v] + np.bitwise_count(more[0][at + u] ^ more[1][v]).sum(axis=1) <= within
                u, v = u[near], v[near]
            u += at
            if same:
                u, v = u[u < v], v[u < v]
            else:
                v = v + n
            if len(u):
                _joined(label, u, v)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


def links(fps: DataFrame, *, radius: int = 2, tile: int = TILE, within: int | None = None, similarity: float | None = None) -> DataFrame:
    """fps: distinct longs fp. Columns a, b: links whose connected groups are those of all pairs within radius bits.

    With within and similarity, fps has node (a distinct long), fps (a fingerprint of several words,
    fp its first) and n (the size of its set) too, links are between nodes, and their words differ
    in at most within bits in all. Tiles whose sizes are too far apart for the similarity are skipped.
    """
    spark = fps.sparkSession
    parts = 4 if radius <= 2 else 2 if radius <= 4 else 1
    wide = within is not None
    # A large radius skips few tiles by their counts: these go in steps as wide as it, so that few tiles need many copies.
    width = radius + 1 if parts == 1 else 1
    sized = [_size_class(F.col("n"), similarity)] if wide else []
    classed = fps.select("fp", *(["node", "fps"] if wide else []), F.array(*sized, *_class(F.col("fp"), parts, width)).alias("class"))
    # At most (64 / parts + 1) ** parts classes, under 84,000, or three for each step of size: this table's size is bounded.
    sizes = stored(classed.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("chunks")), "simhash-classes")
    chunk = F.pmod(F.xxhash64(F.lit("tile"), "fp"), F.col("chunks")).cast("int").alias("chunk")
    member = F.struct("fp", *(["node", "fps"] if wide else []))
    tiles = classed.join(F.broadcast(sizes), "class").select("class", chunk, member.alias("m")).groupBy("class", "chunk").agg(F.collect_list("m").alias("m"))
    data = F.struct(F.col("m.fp").alias("fp"), *([F.col("m.node").alias("node"), F.flatten("m.fps").alias("words")] if wide else []))
    tiles = stored(tiles.select("class", "chunk", data.alias("tile")), "simhash-tiles")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = F.array(*(F.array(*map(F.lit, d)) for d in _steps(parts, 1 if width > 1 else radius, wide)))
    near = tiles.select(F.col("class").alias("c"), F.col("chunk").alias("k"), F.col("tile").alias("left"), F.explode(steps).alias("step"))
    near = near.select("c", "k", "left", F.transform("step", lambda d, i: d + F.get("c", i)).alias("class"))
    near = near.join(F.broadcast(sizes), "class").select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    near = near.filter((F.col("c") != F.col("class")) | (F.col("k") <= F.col("chunk")))
    # Tiles are few and large, so their number of bytes says little about the work: as many tasks as asked for.
    pairs = near.repartition(n, "class", "chunk").join(tiles.repartition(n, "class", "chunk").hint("shuffle_hash"), ["class", "chunk"])
    pairs = pairs.select("left", F.col("tile").alias("right"), ((F.col("c") == F.col("class")) & (F.col("k") == F.col("chunk"))).alias("same"))

    def run(batches):
        for batch in batches:
            sides = [[(c.offsets.to_numpy(), c.values.to_numpy()) for c in side.flatten()] for side in batch.columns[:2]]
            out = []
            for i, same in enumerate(batch.column(2).to_pylist()):
                left, right = ([values[ends[i] : ends[i + 1]] for ends, values in side] for side in sides)
                more = tuple(x[2].view(np.uint64).reshape(len(x[0]), -1)[:, 1:] for x in (left, right)) if wide else None  # the first is fp
                found = tile_links(left[0].view(np.uint64), right[0].view(np.uint64), same, radius, more, within or 0)
                if len(found[0]):
                    names = left[wide] if same else np.concatenate([left[wide], right[wide]])
                    out.append((names[found[0]], names[found[1]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def groups(prints: DataFrame, *, radius: int = 2, id_col: str = "doc_id") -> DataFrame:
    """prints: id_col, fp. The distinct fingerprints: fp, component_id, the least id of all that link to it, directly or not."""
    own = stored(prints.groupBy("fp").agg(F.min(id_col).alias("own")), "simhash-distinct")
    root = components(links(own.select("fp"), radius=radius)).withColumnRenamed("node", "fp")
    rooted = own.join(root, "fp", "left").select("fp", "own", F.coalesce("root", "fp").alias("root"))
    # Grouped sides are written first, so that their joins can split the rows of a large group.
    least = stored(rooted.groupBy("root").agg(F.min("own").alias("component_id")), "simhash-least")
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, *, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each of docs: id_col, fingerprint (16 hex digits), component_id.

    Repeated rows each have their row. A null identifier is no candidate for component_id, which is
    null where a group has no other. An empty table gives no rows; other columns play no part.
    """
    prints = stored(fingerprints(docs, words=words, id_col=id_col, text_col=text_col), "simhash-prints")
    found = prints.join(groups(prints, radius=radius, id_col=id_col), "fp")
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def bits_apart(similarity: float, bits: int) -> float:
    """Of how many bits fingerprints are expected to differ, where two sets of shingles of one size have this Jaccard similarity."""
    return bits * math.acos(2 * similarity / (1 + similarity)) / math.pi


def shared_links(fps: np.ndarray, sets: list[np.ndarray], right: np.ndarray, similarity: float, within: int) -> list[tuple[int, int]]:
    """Links between members (one of the right with one of the others, or all if none is) that join them as all similar pairs would.

    Pairs within so many bits are compared by their sets, the nearest first, if no links join them yet.
    """
    left = np.flatnonzero(~right)
    other = np.flatnonzero(right) if right.any() else left
    n = np.array([len(own) for own in sets])
    far = sum(np.bitwise_count(fps[left, None, i] ^ fps[None, other, i]).astype(np.int32) for i in range(fps.shape[1]))
    sizes = np.minimum(n[left, None], n[None, other]) >= similarity * np.maximum(n[left, None], n[None, other]) - 1e-6
    u, v = np.nonzero((far <= within) & sizes)
    order = np.argsort(far[u, v], kind="stable")
    root, out = list(range(len(sets))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in zip(left[u[order]].tolist(), other[v[order]].tolist(), strict=True):
        if (left is not other or a < b) and (x := find(a)) != (y := find(b)):
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if both / (n[a] + n[b] - both) >= similarity:
                root[x] = y
                out.append((a, b))
    return out


def _set_links(texts: DataFrame, candidates: DataFrame, words: int, similarity: float, within: int) -> DataFrame:
    """Columns a, b: the links among candidates (node, root of its group, fps, n shingles, of one of its texts) that their sets confirm.

    texts: of, text. A group is dealt to parts, and all pairs of its parts are compared, each in one row.
    """
    # The texts of candidates are known by a bit each; others of the same bit are dropped by the join.
    bit = F.pmod("of", F.lit(FILTER)) + 1
    held = np.zeros((FILTER + 32767 >> 15, 4096), np.uint8)
    for row in candidates.groupBy(F.bitmap_bucket_number(bit).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect():
        held[row["at"] - 1] = np.frombuffer(row["bits"], np.uint8)
    held = held.reshape(-1)

    def sets(batches):
        met = set()
        for batch in batches:
            bits = batch.column(0).to_numpy() & (FILTER - 1)
            found = {}
            for i in np.flatnonzero(held[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).tolist():
                own = shingle_set(batch.column(1)[i].as_buffer().to_pybytes(), words)
                if (name := _set_name(own)) not in met:
                    met.add(name)
                    found[name] = pa.array(own.view(np.int64))
            own = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found.values())]), pa.int32()), pa.concat_arrays([pa.array([], pa.int64()), *found.values()]))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), own], names=["node", "own"])

    own = texts.select("of", "text").mapInArrow(sets, "node long, own array<long>").dropDuplicates(["node"])
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / PART), F.ceil(F.sum("n") / PART_SHINGLES)).cast("int")
    large = stored(candidates.groupBy("root").agg(parts.alias("parts")).filter("parts > 1"), "similar-large")
    dealt = candidates.join(large, "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.join(own, "node").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "node"), F.col("parts")).cast("int"))
    pairs = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    member = F.struct((F.col("part") > F.col("other")).alias("right"), "node", "fps", "own")
    keys = ["root", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q")]
    pairs = pairs.groupBy(*keys).agg(F.collect_list(member).alias("m")).filter(F.size("m") > 1).select("m")

    def run(batches):
        for batch in batches:
            ends = batch.column(0).offsets.to_numpy()
            right, node, fps, own = batch.column(0).values.flatten()
            right, node = right.to_numpy(zero_copy_only=False), node.to_numpy()
            words, cuts = fps.values.to_numpy().view(np.uint64), fps.offsets.to_numpy()
            hashes, places = own.values.to_numpy().view(np.uint64), own.offsets.to_numpy()
            out = []
            for lo, hi in itertools.pairwise(ends.tolist()):
                found = shared_links(words[cuts[lo] : cuts[hi]].reshape(hi - lo, -1), [hashes[places[j] : places[j + 1]] for j in range(lo, hi)], right[lo:hi], similarity, within)
                out += [(node[lo + a], node[lo + b]) for a, b in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def similar(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, size: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose sets of shingles have this Jaccard similarity or more, directly or by others.

    Fingerprints of size words, of distinct shingles, propose: tiles compare the first word, then all
    words, each with as many bits as expected at this very similarity and four standard deviations.
    Each link among the groups so proposed is confirmed by the sets of hashes themselves.

    A row for each distinct identifier and text: id_col, of (a hash of the text) and kept, which
    one row of each group is: that of the least identifier, then of the least hash.
    """
    apart = bits_apart(similarity, 1)
    radius, within = (math.ceil(bits * apart + 4 * math.sqrt(bits * apart * (1 - apart))) for bits in (64, 64 * size))

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_buffer().to_pybytes(), words) for t in batch.column(2)]
            fps = [_majority((own[i : i + TILE] for i in range(0, len(own), TILE)), size) for own in sets]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1) * size, pa.int32()), pa.array(np.concatenate(fps) if fps else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(_set_name, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), flat], names=["id", "of", "node", "n", "fps"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("of"), text.cast("binary").alias("text"))
    prints = stored(texts.mapInArrow(run, f"id {kind}, of long, node long, n long, fps array<long>"), "similar-prints")
    nodes = stored(prints.groupBy("node").agg(F.first("fps").alias("fps"), F.first("n").alias("n"), F.min("of").alias("of")), "similar-nodes").withColumn("fp", F.col("fps")[0])
    near = components(links(nodes, radius=radius, within=within, similarity=similarity))
    near = near.union(near.select("root", "root").distinct())
    candidates = stored(near.join(nodes.drop("fp"), "node"), "similar-candidates")
    root = components(_set_links(texts, candidates, words, similarity, within))
    # Only members of groups move; a document alone keeps itself.
    first = F.struct(F.col("id").isNull().alias("none"), "id", "of")
    grouped = stored(prints.select("id", "of", "node").join(root, "node", "left").select("id", "of", F.coalesce("root", "node").alias("root")), "similar-grouped")
    least = stored(grouped.groupBy("root").agg(F.min(first).alias("least")), "similar-least")
    met = grouped.join(least, "root").select("id", "of", (first == F.col("least")).alias("kept"))
    return met.distinct().withColumnRenamed("id", id_col)
