"""What each filter does after others, in every order, from a packed bitmap index.

Filters mark documents that fail. The index holds blocks of documents as bitsets: one for each
filter, one for each label, one for each part (value of a column) that occurs in the block. For each
subset of filters, a bitset AND-NOT the union of theirs and a count of its bits say how many documents
a prefix of that subset keeps, by part and label; the counts of blocks are summed by task, then by
Spark. All that an audit tells of any order follows from these counts.

The five filters of this module: under 100 words; fewer than 80 distinct words in 100; more than 10
capitals A-Z in 100 code points; a character of ``#$%&*|``; a text that is also that of a lesser
doc_id. Words are what stands between ASCII white space, in the case they have.

Null texts are empty, null parts the empty string. A row without doc_id never fails the last filter,
as it is greater than none, nor makes others fail it; rows that agree in doc_id and text aren't copies
of each other. Rows that repeat count each. A document has a label if any row of labels says so; one
without an identifier has none. Texts are the same if their SHA-256 is. An empty table gives no rows.
Other columns play no part, whatever they are called.

Scale: texts are read once and never shuffled; what is shuffled is an identifier, a digest and a few
bits a row, for two joins whose grouped sides are written first, so that Spark splits the rows of a
text that a third of all documents have. A task holds one block and the counts of at most ``PARTS``
parts.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionlake.llm.scratch import stored

SPACE = "\t-\r "  # a range of a character class, and the blank
WHITE = " \t\n\x0b\x0c\r"
PARTS = 4096  # counts that a task holds before it passes them on
FILTERS = ("A", "B", "C", "D", "E")
LABELS = ("good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text alone."""
    trimmed = F.trim(text, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    return {"words": counted, "C": 100 * capitals > 10 * F.char_length(text), "D": text.rlike("[#$%&*|]")}


def marked(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, A, B, C, D, E (whether the document fails), good, toxic: a row for each row of docs."""
    text = F.coalesce(text_col, F.lit(""))
    own = text_failures(text)
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(part_col, F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), own["words"].alias("words"), own["C"].alias("C"), own["D"].alias("D"))
    flags = read.select("id", "part", "digest", (F.col("words.n") < 100).alias("A"), (100 * F.col("words.distinct") < 80 * F.col("words.n")).alias("B"), "C", "D")
    flags = stored(flags, "audit-flags")
    # Grouped sides are written first, so that the joins can split the rows of a hot key.
    least = flags.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("digest", "least")
    met = flags.join(stored(least, "audit-copies"), "digest", "left")
    by_id = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
    known = by_id.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    told = met.join(stored(known, "audit-labels"), "id", "left")
    no = F.lit(False)
    return told.select("part", "A", "B", "C", "D", F.coalesce(F.col("id") > F.col("least"), no).alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


INDEX = "n int, parts array<string>, part_bits binary, filter_bits binary, label_bits binary"


def bitmap_index(rows: DataFrame, filters: Sequence[str] = FILTERS, labels: Sequence[str] = LABELS) -> DataFrame:
    """rows: part, and a boolean for each filter and label. A row for each block: how many documents, the names of parts, and bitsets of the block one after another."""
    filters, labels = list(filters), list(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = lambda batch, names: np.concatenate([np.packbits(batch.column(c).to_numpy(zero_copy_only=False).astype(bool)) for c in names]).tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("part").dictionary_encode()
            parts, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            part_bits = b"".join(np.packbits(code == p).tobytes() for p in range(len(parts)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.num_rows], pa.int32()), pa.array([parts], pa.list_(pa.string())), *(pa.array([x], pa.binary()) for x in (part_bits, packed(batch, filters), packed(batch, labels)))],
                names=[c.split()[0] for c in INDEX.split(", ")],
            )

    return rows.select("part", *filters, *labels).mapInArrow(run, INDEX)


def kept_by_subset(index: DataFrame, n_filters: int = len(FILTERS), n_labels: int = len(LABELS)) -> DataFrame:
    """part, what (0: documents, then each label), subset (a bit for each filter, the first is 1), kept: how many no filter of the subset removes."""
    subsets = 1 << n_filters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c.ravel().tolist() for c in counts.values()], pa.list_(pa.int64()))], names=["part", "counts"])
            counts.clear()
            return out

        for batch in batches:
            for row in batch.to_pylist():
                bits = lambda name, k, row=row: np.frombuffer(row[name], np.uint8).reshape(k, -1)
                fails, parts = bits("filter_bits", n_filters), bits("part_bits", len(row["parts"]))
                sets = [parts, *(parts & one for one in bits("label_bits", n_labels))]
                removed = np.zeros((subsets, fails.shape[1]), np.uint8)
                found = np.empty((len(parts), 1 + n_labels, subsets), np.int64)
                for s in range(subsets):
                    if s:
                        first = (s & -s).bit_length() - 1
                        removed[s] = removed[s & (s - 1)] | fails[first]
                    for what, members in enumerate(sets):
                        found[:, what, s] = np.bitwise_count(members & ~removed[s]).sum(axis=1, dtype=np.int64)
                for part, own in zip(row["parts"], found, strict=True):
                    counts[part] = counts[part] + own if part in counts else own
                if len(counts) >= PARTS:
                    yield told()
        if counts:
            yield told()

    by_task = index.mapInArrow(run, "part string, counts array<bigint>")
    summed = by_task.select("part", F.posexplode("counts").alias("at", "n")).groupBy("part", "at").agg(F.sum("n").alias("kept"))
    return summed.select("part", F.floor(F.col("at") / subsets).cast("int").alias("what"), (F.col("at") % subsets).alias("subset"), "kept")


def audit(kept: DataFrame, filters: Sequence[str] = FILTERS, labels: Sequence[str] = LABELS) -> DataFrame:
    """part, filter_order, step (from 1), kept, removed, redundant, unique_fails, <label>_lost, shapley: every order of the filters."""
    n = len(filters)
    full = (1 << n) - 1
    listed = lambda what: F.transform(F.array_sort(F.collect_list(F.when(F.col("what") == what, F.struct("subset", "kept")))), lambda x: x["kept"])
    tables = kept.groupBy("part").agg(listed(0).alias("k0"), *(listed(i + 1).alias(f"k{i + 1}") for i in range(len(labels))))
    k = F.col("k0")

    def shapley(f: int) -> Column:
        """What filter f removes, over all orders: a subset before it stands before it in so many of them."""
        return sum(((k[s] - k[s | 1 << f]) * (math.factorial(bin(s).count("1")) * math.factorial(n - 1 - bin(s).count("1"))) for s in range(full + 1) if not s >> f & 1), F.lit(0))

    steps = [(order, at + 1, f, sum(1 << x for x in order[:at])) for order in itertools.permutations(range(n)) for at, f in enumerate(order)]
    names, step, which, before = (F.lit(list(x)) for x in zip(*(("".join(filters[f] for f in o), at, f, s) for o, at, f, s in steps), strict=True))
    spread = tables.select("part", *(f"k{i}" for i in range(len(labels) + 1)), F.array(*(shapley(f) for f in range(n))).alias("shapley"), F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("i"))
    spread = spread.select("*", F.get(names, F.col("i")).alias("filter_order"), F.get(step, F.col("i")).cast("int").alias("step"), F.get(which, F.col("i")).alias("f"), F.get(before, F.col("i")).alias("s"))
    bit = F.get(F.lit([1 << f for f in range(n)]), F.col("f"))
    lost = lambda c: F.get(c, F.col("s")) - F.get(c, F.col("s") + bit)
    fails, removed = F.get("k0", F.lit(0)) - F.get("k0", bit), lost(F.col("k0"))
    return spread.select(
        "part", "filter_order", "step", F.get("k0", F.col("s") + bit).alias("kept"), removed.alias("removed"), (fails - removed).alias("redundant"),
        (F.get("k0", full - bit) - F.get("k0", F.lit(full))).alias("unique_fails"), *(lost(F.col(f"k{i + 1}")).alias(f"{name}_lost") for i, name in enumerate(labels)), F.get("shapley", F.col("f")).cast("long").alias("shapley"),
    )


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(kept_by_subset(bitmap_index(marked(docs, labels))))
