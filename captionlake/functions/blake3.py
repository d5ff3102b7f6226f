"""BLAKE3 digests of many byte strings at once, in numpy.

A string is chunks of 1,024 bytes, a chunk up to 16 blocks, compressed one after another; chunks are
the leaves of a tree whose parents compress two chaining values. All chunks of all strings go through
one block after another together, then all pairs of a level. A part of a long string that begins at a
multiple of PART is a whole subtree, so parts are digested on their own, wherever they are, and their
values merged by the same tree.
"""

from __future__ import annotations

import numpy as np

# Those of the published algorithm.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
ROUNDS, CHUNK, BLOCK = 7, 1024, 64
MIXES = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]

PART = 4096 * CHUNK  # bytes of a part: a power of two of chunks
AT_ONCE = 4096  # chunks that are in work at once


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def compress(chain: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """chain: 8 x n, words: 16 x n, the rest: n. The next chaining values, 8 x n."""
    n = chain.shape[1]
    counter = counter.astype(np.uint64)
    tail = np.stack([counter.astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)])
    v = [*chain, *np.broadcast_to(IV[:4, None], (4, n)), *tail]
    m = list(words)
    for _ in range(ROUNDS):
        for i, (a, b, c, d) in enumerate(MIXES):
            for x, first, second in ((m[2 * i], 16, 12), (m[2 * i + 1], 8, 7)):
                v[a] = v[a] + v[b] + x
                v[d] = _turned(v[d] ^ v[a], first)
                v[c] = v[c] + v[d]
                v[b] = _turned(v[b] ^ v[c], second)
        m = [m[p] for p in PERMUTATION]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)])


def _leaves(data: np.ndarray, begin: np.ndarray, size: np.ndarray, counter: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Chaining values of the chunks data[begin:begin + size]; alone: the chunk is a whole string."""
    out = np.empty((8, len(begin)), np.uint32)
    for at in range(0, len(begin), AT_ONCE):
        some = slice(at, at + AT_ONCE)
        held = np.minimum(begin[some, None] + np.arange(CHUNK), max(0, len(data) - 1))
        laid = np.where(np.arange(CHUNK) < size[some, None], data[held] if len(data) else 0, 0).astype(np.uint8)
        words = laid.view("<u4").reshape(len(laid), CHUNK // BLOCK, 16)
        blocks = np.maximum(1, -(-size[some] // BLOCK))
        chain = np.repeat(IV[:, None], len(laid), axis=1)
        for b in range(int(blocks.max(initial=0))):
            live = np.flatnonzero(blocks > b)
            last = blocks[live] == b + 1
            flags = CHUNK_START * (b == 0) + last * (CHUNK_END + ROOT * alone[some][live])
            chain[:, live] = compress(chain[:, live], words[live, b].T, counter[some][live], np.minimum(BLOCK, size[some][live] - b * BLOCK), flags)
        out[:, some] = chain
    return out


def _merged(values: np.ndarray, count: np.ndarray, whole: bool) -> np.ndarray:
    """values: 8 x n, count of them for each string, one after another. The value at the top of each string's tree; whole: the last merge is the root."""
    count = count.copy()
    while count.max(initial=0) > 1:
        first = np.cumsum(count) - count
        pairs, odd = count // 2, count % 2
        of = np.repeat(np.arange(len(count)), pairs)
        left = np.repeat(first, pairs) + 2 * (np.arange(len(of)) - np.repeat(np.cumsum(pairs) - pairs, pairs))
        flags = PARENT + ROOT * (whole & (count[of] == 2))
        joined = compress(np.repeat(IV[:, None], len(left), axis=1), np.concatenate([values[:, left], values[:, left + 1]]), np.zeros(len(left)), np.full(len(left), BLOCK), flags)
        new = pairs + odd
        out = np.empty((8, int(new.sum())), np.uint32)
        place = np.cumsum(new) - new
        out[:, np.repeat(place, pairs) + (np.arange(len(of)) - np.repeat(np.cumsum(pairs) - pairs, pairs))] = joined
        lone = np.flatnonzero(odd)
        out[:, place[lone] + pairs[lone]] = values[:, first[lone] + count[lone] - 1]
        values, count = out, new
    return values


def _bytes(values: np.ndarray) -> list[bytes]:
    flat = np.ascontiguousarray(values.T).astype("<u4").tobytes()
    return [flat[i : i + 32] for i in range(0, len(flat), 32)]


def digests(data: np.ndarray, ends: np.ndarray, first: np.ndarray | None = None) -> list[bytes]:
    """The digest of each string data[ends[i]:ends[i + 1]] (bytes).

    first: of parts of longer strings, the number of each part's first chunk; then these are chaining
    values, for merged_parts.
    """
    size = np.diff(ends)
    chunks = np.maximum(1, -(-size // CHUNK))
    of = np.repeat(np.arange(len(size)), chunks)
    number = np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    whole = first is None
    counter = number if whole else number + first[of]
    alone = (chunks[of] == 1) & whole
    leaves = _leaves(data, ends[:-1][of] + number * CHUNK, np.minimum(CHUNK, size[of] - number * CHUNK), counter, alone)
    return _bytes(_merged(leaves, chunks, whole))


def merged_parts(values: list[bytes]) -> bytes:
    """The digest of a string from the chaining values of its parts, two of them at least."""
    given = np.frombuffer(b"".join(values), "<u4").reshape(-1, 8).T.astype(np.uint32)
    return _bytes(_merged(given, np.array([len(values)]), True))[0]
