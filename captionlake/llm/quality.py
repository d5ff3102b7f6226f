"""Quality classifier: a convolutional network over bytes, in numpy.

A document's UTF-8 bytes are covered whole by overlapping chunks of ``CHUNK`` bytes, each half of
which is shared with the next. A filter adds a learned weight for each of ``WIDTH`` bytes in a row
(a table by place and byte value, which is a byte embedding times the filter); its greatest value
in a chunk is kept. A hidden layer sees a chunk's maxima, the mean of its values over all chunks
goes to a logistic unit: one probability of label 1 for each document, of whatever length.

Training sees a bounded sample: of each label at most ``per_class`` labelled rows, those of least
hash of their id, each with its whole text, or with pieces from all over it where it has more than
``per_text`` bytes, so what goes to the driver is bounded in bytes too. A step takes a minibatch of documents, half of each label,
and of each of them at most ``DRAWN`` chunks, drawn anew each time from all of its chunks. One time in
ten, whatever the label, a document stands for a short piece drawn from anywhere in it, as short texts
are few among the labelled. Errors are weighted by the share of each label among all labelled rows,
so scores are probabilities for such rows. Rows held out (crc32 of the id as text, modulo 4, is 2)
never take part. Labels, language, source and id are no inputs of a score.

Null and empty texts have the score 0: there is nothing in them to keep. Labels that are null or other
than 0 and 1 are left out, repeated equal labels count once, and an id with both labels is left out.
Without rows of both labels every score but that of empty texts is the smoothed share of label 1.
Repeated rows each get a score. A column called as the scores are gives way to them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HALF, WIDTH, FILTERS, HIDDEN = 128, 5, 16, 16
CHUNK = 2 * HALF
DRAWN = 8
PIECE = 2048  # bytes of the pieces of a long text that training gets
SHORT, DECAY = 0.1, 3e-3  # share of short pieces among what is drawn; weight decay
SLICE = 256  # blocks of HALF bytes that are in work at once
PAD = WIDTH - 1  # zero bytes before and, at least, after each text: no filter sees two texts


def held_out(doc_id: Column) -> Column:
    """Whether a row is held out of training; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the end of each row among them; nulls are empty."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), ends


def blocks_of(size: np.ndarray) -> np.ndarray:
    """Blocks of HALF bytes that hold texts of so many bytes and the zeros around them; a chunk is two of them."""
    return np.maximum(2, -(-(size + 2 * PAD) // HALF))


def laid_out(data: np.ndarray, ends: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The texts data[ends[i]:ends[i + 1]] at the beginning of their blocks, after PAD zeros each, and PAD zeros at the end."""
    padded = np.zeros(int(blocks.sum()) * HALF + PAD, np.uint8)
    for begin, end, place in zip(ends[:-1].tolist(), ends[1:].tolist(), ((np.cumsum(blocks) - blocks) * HALF + PAD).tolist(), strict=True):
        padded[place : place + end - begin] = data[begin:end]
    return padded


@dataclass
class Model:
    table: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    prior: float | None = None  # if set, every score

    def maxima(self, data: np.ndarray) -> np.ndarray:
        """data: whole blocks, then PAD bytes more. Each filter's greatest value in each block."""
        n = (len(data) - PAD) // HALF
        best = np.empty((n, FILTERS), np.float32)
        for at in range(0, n, SLICE):
            some = data[at * HALF : min(n, at + SLICE) * HALF + PAD]
            size = len(some) - PAD
            value = self.table[0].take(some[:size], axis=0)
            for j in range(1, WIDTH):
                value += self.table[j].take(some[j : j + size], axis=0)
            best[at : at + SLICE] = value.reshape(-1, HALF, FILTERS).max(axis=1)
        return best

    def scores(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The score of each text data[ends[i]:ends[i + 1]]."""
        if self.prior is not None:
            return np.where(np.diff(ends) > 0, self.prior, 0.0)
        out = []
        at = 0
        while at < len(ends) - 1:  # about a megabyte of texts at once, or one longer text
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 20), side="right")) - 1)
            size = np.diff(ends[at : to + 1])
            blocks = blocks_of(size)
            first = np.cumsum(blocks) - blocks
            padded = laid_out(data, ends[at : to + 1], blocks)
            best = self.maxima(padded)
            pooled = np.maximum(best[:-1], best[1:])  # chunks of two blocks
            last = np.zeros(len(best), bool)
            last[first + blocks - 1] = True
            pooled = np.maximum(pooled + self.bias, 0)
            seen = np.maximum(pooled @ self.hidden + self.hidden_bias, 0)
            seen[last[:-1]] = 0  # a chunk over two documents
            mean = np.add.reduceat(np.vstack([seen, np.zeros((1, HIDDEN), seen.dtype)]), first, axis=0) / (blocks - 1)[:, None]
            found = 1 / (1 + np.exp(-np.clip((mean @ self.out + self.out_bias).astype(np.float64), -30, 30)))
            out.append(np.where(size > 0, found, 0.0))
            at = to
        return np.concatenate(out) if out else np.empty(0)


def fit(data: np.ndarray, ends: np.ndarray, label: np.ndarray, *, share: float = 0.5, seed: int = 1, steps: int = 1200, batch: int = 48, rate: float = 0.01) -> Model:
    """Adam on the log loss of the texts data[ends[i]:ends[i + 1]] and their labels, both of which occur; share: of label 1 where scores will be used."""
    rng = np.random.default_rng(seed)
    p = [
        rng.normal(0, 0.3, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), rng.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)), np.full(HIDDEN, 0.1),
        rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1),
    ]
    p = [x.astype(np.float32) for x in p]
    first, second = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    size = np.diff(ends)
    blocks = blocks_of(size)
    flat, first_block = laid_out(data, ends, blocks), np.cumsum(blocks) - blocks
    by_label = [np.flatnonzero(label == v) for v in (0, 1)]
    weight = np.array([2 * (1 - share), 2 * share])
    queue = [np.empty(0, np.int64)] * 2
    span = np.arange(CHUNK + PAD)
    for step in range(1, steps + 1):
        some = []
        for v in (0, 1):
            while len(queue[v]) < batch // 2:
                queue[v] = np.concatenate([queue[v], rng.permutation(by_label[v])])
            some.append(queue[v][: batch // 2])
            queue[v] = queue[v][batch // 2 :]
        some = np.concatenate(some)
        begin, upto, of = [], [], []
        for i, d in enumerate(some.tolist()):
            if rng.random() < SHORT:  # a short piece of it, as a text of its own
                n = int(min(size[d], np.exp(rng.uniform(np.log(4), np.log(CHUNK - 2 * PAD)))))
                at = int(rng.integers(0, size[d] - n + 1)) + first_block[d] * HALF + PAD
                begin.append([at - PAD])
                upto.append(PAD + n)
                of.append(i)
            else:
                chunks = blocks[d] - 1
                drawn = rng.choice(chunks, DRAWN, replace=False) if chunks > DRAWN else np.arange(chunks)
                begin.append((first_block[d] + drawn) * HALF)
                upto += [CHUNK + PAD] * len(drawn)
                of += [i] * len(drawn)
        begin, of, upto = np.concatenate(begin), np.array(of), np.array(upto)
        n = np.bincount(of, minlength=len(some))[:, None]
        x = flat[np.minimum(begin[:, None] + span, len(flat) - 1)]
        cut = upto < CHUNK + PAD
        x[cut] = np.where((span >= PAD) & (span < upto[cut, None]), x[cut], 0)
        value = p[0][0].take(x[:, :CHUNK], axis=0)
        for j in range(1, WIDTH):
            value += p[0][j].take(x[:, j : j + CHUNK], axis=0)
        where = value.argmax(axis=1)
        top = np.take_along_axis(value, where[:, None], axis=1)[:, 0] + p[1]
        pooled = np.maximum(top, 0)
        before = pooled @ p[2] + p[3]
        seen = np.maximum(before, 0)
        mean = np.zeros((len(some), HIDDEN), np.float32)
        np.add.at(mean, of, seen)
        mean /= n
        logit = mean @ p[4] + p[5]
        error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label[some]) * weight[label[some]] / len(some)).astype(np.float32)
        d_seen = (error[:, None] * p[4] / n)[of] * (before > 0)
        d_top = (d_seen @ p[2].T) * (top > 0)
        g_table = np.zeros_like(p[0])
        filters = np.broadcast_to(np.arange(FILTERS), where.shape)
        for j in range(WIDTH):
            np.add.at(g_table[j], (np.take_along_axis(x, where + j, axis=1), filters), d_top)
        grads = [g_table, d_top.sum(0), pooled.T @ d_seen, d_seen.sum(0), mean.T @ error, error.sum(keepdims=True)]
        pace = rate * (1 - (step - 1) / steps)
        for i, g in enumerate(grads):
            g = g.astype(np.float32) + DECAY * p[i]
            first[i] += 0.1 * (g - first[i])
            second[i] += 0.01 * (g * g - second[i])
            p[i] -= pace * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return Model(p[0], p[1], p[2], p[3], p[4], float(p[5][0]))


def drawn(text: Column, most: int) -> Column:
    """A binary text, or of one longer than most bytes as many pieces of PIECE bytes as that holds, one after another, evenly from its beginning to its end."""
    count = max(2, most // PIECE)
    begin = lambda i: F.floor((F.octet_length(text) - PIECE) * i / (count - 1)) + 1
    pieces = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.hex(F.substring(text, begin(i).cast("int"), F.lit(PIECE))))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.unhex(F.array_join(pieces, "")))


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = 2500, per_text: int = 1 << 15, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits a model to a bounded sample of the rows of docs that labels names and that aren't held out: at most per_class of each label, and per_text bytes of each."""
    key = F.col(id_col)
    known = labels.select(key.alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").select("id", "label")
    counted = dict(known.groupBy("label").count().collect())
    texts = docs.select(key.alias("id"), F.col(text_col).cast("binary").alias("text")).filter(F.octet_length("text") > 0)
    some = [known.filter(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(per_class) for v in (0, 1)]
    # At most 2 * per_class ids: this side is bounded.
    sample = texts.join(F.broadcast(some[0].union(some[1])), "id")
    # One text of each id, and so few of them, go to the driver; of a long one, pieces from all over it.
    got = sample.groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "label", drawn(F.col("text"), per_text).alias("text")).orderBy("id").select("label", "text").toArrow()
    label = got.column("label").to_numpy()
    ones = int(label.sum())
    if not 0 < ones < len(label):
        return Model(*(np.zeros(0),) * 5, 0.0, prior=(ones + 1) / (len(label) + 2))
    return fit(*as_bytes(got.column("text").combine_chunks()), label, share=counted.get(1, 0) / sum(counted.values()))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with a column of scores more, in place of one already called so."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != score_col.lower()]
    fields = [docs.schema[c] for c in keep]
    given = docs.select(F.col(f"`{text_col}`").alias("0"), *(F.col(f"`{c}`").alias(str(n)) for n, c in enumerate(keep, 1)))

    def run(batches):
        for batch in batches:
            scores = model.scores(*as_bytes(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], names=[*(f.name for f in fields), score_col])

    return given.mapInArrow(run, T.StructType([*fields, T.StructField(score_col, T.DoubleType())]))
