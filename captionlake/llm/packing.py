"""Packing of tokenised documents into windows by Karmarkar-Karp multiway differencing.

Documents are encoded and packed where they are read: no shuffle, and no task holds more than one
block. A document is its ids and an end id. Full windows are cut off its front; the rest, and every
document that fits a window, is a piece. The pieces of a block of about ``block`` windows are dealt
to the fewest windows that could hold them: each piece begins as a partial partition of its own,
and the two partial partitions with the largest imbalance are merged again and again, the fullest
windows of one with the emptiest of the other. Windows of the last one standing that are above
capacity exchange members with others that have room; where that isn't enough the number of windows
rises and the block is dealt anew, until all fit. So only what is longer than a window is ever cut.

Nulls and empty texts hold the end id alone. Repeated rows are packed each. Rows may come from
any partitioning; sequence ids are unique over all partitions but not gapless. Other columns of the
input play no part, whatever they are called. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionlake.llm import bpe as bpe_

WINDOW = 2048
BLOCK = 128


def differences(sizes: Sequence[int], k: int) -> list[list[int]]:
    """sizes dealt to at most k windows of near-equal sums: the places of each window's members."""
    # A partial partition: sums of its windows that aren't empty, ascending, and the node of each.
    # A node is the place of a size, or the number of a pair of nodes, counted from len(sizes).
    heap = [(-s, n, [s], [n]) for n, s in enumerate(sizes)]
    heapq.heapify(heap)
    pairs: list[tuple[int, int]] = []
    turn = n_sizes = len(sizes)
    while len(heap) > 1:
        _, _, sums, nodes = heapq.heappop(heap)
        _, _, more, others = heapq.heappop(heap)
        if len(sums) < len(more):
            sums, nodes, more, others = more, others, sums, nodes
        both = len(sums) + len(more) - k
        if both <= 0 and len(more) == 1:
            at = bisect_left(sums, more[0])
            sums.insert(at, more[0])
            nodes.insert(at, others[0])
        else:
            both = max(both, 0)
            # The emptiest windows of the one, from below, with the fullest of the other, from above.
            joined = [(a + b, n_sizes + len(pairs) + i) for i, (a, b) in enumerate(zip(sums[:both], reversed(more[:both]), strict=True))]
            pairs += zip(nodes[:both], reversed(others[:both]), strict=True)
            alone = [*zip(sums[both:], nodes[both:], strict=True), *zip(more[both:], others[both:], strict=True)]
            merged = sorted(joined + alone)
            sums, nodes = [s for s, _ in merged], [n for _, n in merged]
        turn += 1
        heapq.heappush(heap, ((sums[0] if len(sums) == k else 0) - sums[-1], turn, sums, nodes))
    windows = []
    for node in heap[0][3] if heap else []:
        members, todo = [], [node]
        while todo:
            at = todo.pop()
            if at < n_sizes:
                members.append(at)
            else:
                todo += pairs[at - n_sizes]
        windows.append(sorted(members))
    return windows


def evened(windows: list[list[int]], sizes: np.ndarray, window: int) -> list[list[int]] | None:
    """windows after exchanges that leave none above capacity; None where there are none that do.

    The fullest window gives a member for a smaller one, or for nothing, of a window with room for
    the difference: the least that brings it to its capacity, or else the most there is room for.
    """
    where = np.empty(len(sizes), np.int64)
    for at, members in enumerate(windows):
        where[members] = at
    room = window - np.bincount(where, weights=sizes, minlength=len(windows)).astype(np.int64)
    # A member of no size in each window: what is exchanged for it is given for nothing.
    size, of = np.append(sizes, np.zeros(len(windows), np.int64)), np.append(where, np.arange(len(windows)))
    while room.min() < 0:
        at = int(room.argmin())
        own = np.flatnonzero(of == at)
        less = size[own][:, None] - size
        fits = (less > 0) & (less <= room[of])
        enough = np.where(fits & (less >= -room[at]), less, window + 1)
        one, other = np.unravel_index(int(enough.argmin()), enough.shape)
        if enough[one, other] > window:
            most = np.where(fits, less, 0)
            one, other = np.unravel_index(int(most.argmax()), most.shape)
            if not most[one, other]:
                return None
        to, moved = int(of[other]), int(less[one, other])
        of[own[one]], of[other] = to, at
        room[at] += moved
        room[to] -= moved
    out: list[list[int]] = [[] for _ in windows]
    for n, at in enumerate(of[: len(sizes)].tolist()):
        out[at].append(n)
    return out


def pack_block(sizes: Sequence[int], window: int) -> list[list[int]]:
    """sizes, none above window, in near-equal windows of that capacity: the places of each window's members. The number of windows rises until all fit."""
    own = np.asarray(sizes, np.int64)
    k = max(1, -(-int(own.sum()) // window))
    while len(own):
        windows = differences(sizes, k)
        if (fitting := evened(windows + [[] for _ in range(k - len(windows))], own, window)) is not None:
            return [w for w in fitting if w]
        k += 1
    return []


def pack(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, window: int = WINDOW, block: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """A row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    start counts the document's ids before the piece, offset those before it in its sequence; both
    are gapless. ids_crc32 is over the ids as unsigned little-endian 32-bit numbers. doc_tokens
    counts the document's ids with the end id.
    """
    if window < 1:
        raise ValueError("a window holds at least one id")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long" + (", ids array<int>" if with_ids else "")
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def run(batches):
        bpe = bpe_.load(path)
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # doc, start, its ids as bytes, doc_tokens: pieces of at most a window
        loose = 0

        def dealt():
            nonlocal number, held, loose
            full = [n for n, p in enumerate(held) if len(p[2]) == 4 * window]
            rest = [n for n, p in enumerate(held) if len(p[2]) < 4 * window]
            rows = []
            for members in [*([(n, 0, window)] for n in full), *([(rest[i], 0, len(held[rest[i]][2]) // 4) for i in w] for w in pack_block([len(held[n][2]) // 4 for n in rest], window))]:
                place = 0
                for n, at, s in sorted(members):
                    doc, start, raw, tokens = held[n]
                    raw = raw[4 * at : 4 * (at + s)]
                    rows.append((n, start + at, doc, s, zlib.crc32(raw), tokens, number, place, raw))
                    place += s
                number += 1
            rows.sort(key=lambda r: r[:2])
            columns = list(zip(*rows, strict=True))
            data = [pa.array(columns[2], docs_type), *(pa.array(columns[c], pa.int64()) for c in (1, 3, 4, 5, 6, 7))]
            if with_ids:
                data.append(pa.array([np.frombuffer(raw, "<i4") for raw in columns[8]], pa.list_(pa.int32())))
            held, loose = [], 0
            return pa.RecordBatch.from_arrays(data, names=names)

        for batch in batches:
            docs_type = batch.column(0).type
            ids_of = batch.column(0).to_pylist()
            row = 0
            for ids, counts in bpe.encode(bpe_.in_texts(batch.column(1))):
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype("<u4")
                ends += np.arange(1, len(counts) + 1)
                raw = memoryview(ids.tobytes())
                for begin, end in zip((ends - counts - 1).tolist(), ends.tolist(), strict=True):
                    for at in range(begin, end, window):
                        size = min(window, end - at)
                        held.append((ids_of[row], at - begin, raw[4 * at : 4 * (at + size)], end - begin))
                        loose += size if size < window else 0
                    row += 1
                    if loose >= block * window or len(held) >= 64 * block:
                        yield dealt()
        if held:
            yield dealt()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
