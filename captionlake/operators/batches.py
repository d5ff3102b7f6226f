"""Recoverable batches as a log of attempts: one row for each change, the state of things by aggregation.

log: batch_id, position, state, at_ms, seq (a tie-breaker). States: pending, running, complete,
failed, missing, needs-reprocessing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATES = ["pending", "running", "complete", "failed", "missing", "needs-reprocessing"]


def latest(log: DataFrame) -> DataFrame:
    """The last state of each item: batch_id, position, state, at_ms. Counted on the map side; nothing is sorted."""
    last = F.max(F.struct("at_ms", "seq", "state"))
    return log.groupBy("batch_id", "position").agg(last.alias("x")).select("batch_id", "position", "x.state", "x.at_ms")


def attempts(log: DataFrame) -> DataFrame:
    """log with attempt: how often an item was said to run by then. history() tells which of these were refused."""
    order = Window.partitionBy("batch_id", "position").orderBy("at_ms", "seq")
    return log.withColumn("attempt", F.sum((F.col("state") == "running").cast("long")).over(order))


#: What moves an item asks for, and the states it may be in. Interrupted is what a lease that runs out leaves.
MOVES = {
    "running": ("pending", "failed", "missing", "needs-reprocessing", "interrupted"),
    "complete": ("running",),
    "failed": ("running",),
    "missing": ("running",),
    "needs-reprocessing": ("running", "complete"),
}
REFUSED = {
    "running": "an item that runs or is complete doesn't start",
    "complete": "only an item that runs can end",
    "failed": "only an item that runs can end",
    "missing": "only an item that runs can end",
    "needs-reprocessing": "only an item that runs or is complete can need reprocessing",
}


class Item(NamedTuple):
    """Where an item stands: attempts rise by one with each start, since_ms is that of its last move."""

    state: str = "pending"
    attempt: int = 0
    since_ms: int = 0

    def expired(self, at_ms: int, lease_ms: int | None) -> Item | None:
        """The item after its lease has run out, if it has by then."""
        if lease_ms is None or self.state != "running" or self.since_ms + lease_ms > at_ms:
            return None
        return Item("interrupted", self.attempt, self.since_ms + lease_ms)

    def moved(self, wanted: str | None, at_ms: int) -> tuple[Item, str | None]:
        """The item after a change, or as it was and why the change is refused."""
        if wanted == "pending":
            return self, None if self.attempt == 0 else "an item that has begun isn't pending again"
        if wanted not in MOVES:
            return self, "unknown state"
        if self.state not in MOVES[wanted]:
            return self, REFUSED[wanted]
        return Item(wanted, self.attempt + (wanted == "running"), at_ms), None

    def after(self, wanted: str | None, at_ms: int, lease_ms: int | None) -> tuple[Item, list[tuple]]:
        """The item after a change and what to tell of it: wanted, state, attempt, at_ms, error, of a lease that ran out before it too."""
        told, item = [], self
        if lapsed := item.expired(at_ms, lease_ms):
            item = lapsed
            told.append(("interrupted", *item, None))
        item, error = item.moved(wanted, at_ms)
        return item, [*told, (wanted, item.state, item.attempt, at_ms, error)]


TOLD = "wanted string, state string, attempt long, at_ms long, error string"


def history(log: DataFrame, lease_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """What each change of a log did: batch_id, position, seq, wanted, state and attempt (after it), at_ms, error (why it was refused).

    An item begins pending. A lease of lease_ms that runs out, by the next change or by until_ms, adds
    a row whose seq is null. Changes of one item are in order of at_ms, seq, and state; those without
    at_ms come first and count as at 0. An item's changes are a sequence: they are read one after
    another in one task, which holds a batch of them and the item's state, however many there are.
    """
    schema = f"batch_id {_kind(log, 'batch_id')}, position {_kind(log, 'position')}, seq long, {TOLD}"
    key = ["batch_id", "position"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        item = Item()

        def end() -> list[tuple]:
            lapsed = item.expired(until_ms, lease_ms) if now is not None and until_ms is not None else None
            return [(*now, None, "interrupted", *lapsed, None)] if lapsed else []

        def as_batch(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*key, "seq", "wanted", "state", "attempt", "at_ms", "error"])

        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(0).type, batch.schema.field(1).type, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            out: list[tuple] = []
            for batch_id, position, state, at_ms, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (batch_id, position):
                    out += end()
                    now, item = (batch_id, position), Item()
                item, told = item.after(state, at_ms or 0, lease_ms)
                lapsed = [None] * (len(told) - 1)
                out += [(*now, n, *t) for n, t in zip([*lapsed, seq], told, strict=True)]
            if out:
                yield as_batch(out, types)
        if last := end():
            yield as_batch(last, types)

    rows = log.select(*key, "state", F.col("at_ms").cast("long").alias("at_ms"), F.col("seq").cast("long").alias("seq"))
    return rows.repartition(*key).sortWithinPartitions(*key, "at_ms", "seq", "state").mapInArrow(run, schema)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def counts(items: DataFrame) -> DataFrame:
    """batch_id, complete, incomplete, is_complete, has_running."""
    done = F.count_if(F.col("state") == "complete")
    return items.groupBy("batch_id").agg(done.alias("complete"), (F.count(F.lit(1)) - done).alias("incomplete"), (F.count(F.lit(1)) == done).alias("is_complete"), F.coalesce(F.bool_or(F.col("state") == "running"), F.lit(False)).alias("has_running"))


def activity(counted: DataFrame, leases: DataFrame) -> DataFrame:
    """leases: batch_id of batches that a process holds. batch_id, activity (complete, incomplete, active, interrupted).

    Only a batch with an item that runs is active or interrupted.
    """
    held = leases.select("batch_id", F.lit(True).alias("held")).distinct()
    kind = F.when(F.col("is_complete"), "complete").when(~F.col("has_running"), "incomplete").when(F.col("held"), "active").otherwise("interrupted")
    return counted.join(held, "batch_id", "left").select("batch_id", kind.alias("activity"))


def newest_incomplete(batches: DataFrame, counted: DataFrame) -> DataFrame:
    """batches: batch_id, scope, created_ms. For each scope its last batch that isn't complete."""
    open_ = batches.join(counted.filter(~F.col("is_complete")).select("batch_id"), "batch_id", "left_semi")
    return open_.groupBy("scope").agg(F.max(F.struct("created_ms", "batch_id")).alias("x")).select("scope", F.col("x.batch_id").alias("batch_id"), F.col("x.created_ms").alias("created_ms"))


def reconciled(items: DataFrame, receipts: DataFrame) -> DataFrame:
    """items: batch_id, position, attempt, state; receipts: batch_id, position, attempt, is_valid. items with the state that receipts prove.

    A running item whose attempt left a valid receipt is complete; a running or complete one without
    needs reprocessing. Others stay as they are.
    """
    good = receipts.filter("is_valid").select("batch_id", "position", "attempt", F.lit(True).alias("proved")).distinct()
    settled = F.when(F.col("proved"), "complete").otherwise("needs-reprocessing")
    state = F.when(F.col("state").isin("running", "complete"), settled).otherwise(F.col("state"))
    return items.join(good, ["batch_id", "position", "attempt"], "left").select("batch_id", "position", "attempt", state.alias("state"))


def resume_plan(items: DataFrame) -> DataFrame:
    """Items to run again, in their order."""
    return items.filter(F.col("state") != "complete").orderBy("batch_id", "position")


_ITEM = "struct<position:int,source:string,workspace:string,published_base:string,state:struct<status:string,attempt:struct<number:int,started_at_ms:bigint,finished_at_ms:bigint>>>"
JOURNAL = f"schema_version int, id string, tool_version string, created_at_ms bigint, updated_at_ms bigint, cwd string, corrections string, items array<{_ITEM}>"
VERSION = 1


def read_journals(raw: DataFrame) -> DataFrame:
    """raw: path, scope, json, and problem, if a source has told one. The journal's fields, and error: the first reason why it can't be used. No row is dropped."""
    problem = F.col("problem") if "problem" in raw.columns else F.lit(None).cast("string")
    parsed = raw.select("path", "scope", problem.alias("problem"), F.from_json("json", JOURNAL).alias("j"), F.get_json_object("json", "$").isNotNull().alias("is_json"))
    j, items = F.col("j"), F.col("j.items")
    positions = F.array_distinct(F.transform(items, lambda i: i["position"]))
    absolute = lambda path: F.coalesce(path.startswith("/"), F.lit(False))
    attempt = lambda i: i["state"]["attempt"]
    status = lambda i: F.coalesce(i["state"]["status"], F.lit(""))
    begun = F.filter(items, lambda i: status(i) != "pending")
    over = F.filter(begun, lambda i: status(i) != "running")
    checks = {
        "no journal": ~F.coalesce("is_json", F.lit(False)) | j["schema_version"].isNull(),
        "unsupported version": j["schema_version"] != VERSION,
        "no name": ~F.coalesce(j["id"].rlike("^[A-Za-z0-9_-]{1,96}$"), F.lit(False)),
        "no tool version": F.coalesce(F.trim(j["tool_version"]), F.lit("")) == "",
        "updated before it was created": ~F.coalesce(j["updated_at_ms"] >= j["created_at_ms"], F.lit(False)),
        "a path is not absolute": ~absolute(j["cwd"]) | (j["corrections"].isNotNull() & ~absolute(j["corrections"])) | F.exists(items, lambda i: ~(absolute(i["source"]) & absolute(i["workspace"]) & absolute(i["published_base"]))),
        "no items": F.coalesce(F.size(items), F.lit(0)) <= 0,
        "a position is there twice": F.size(positions) != F.size(items),
        "unknown state": F.exists(items, lambda i: ~status(i).isin(STATES)),
        "an attempt has no number": F.exists(begun, lambda i: F.coalesce(attempt(i)["number"], F.lit(0)) < 1),
        "a running item is finished": F.exists(items, lambda i: (status(i) == "running") & attempt(i)["finished_at_ms"].isNotNull()),
        "an item has no end": F.exists(over, lambda i: attempt(i)["finished_at_ms"].isNull()),
        "an item ends before it starts": F.exists(over, lambda i: attempt(i)["finished_at_ms"] < attempt(i)["started_at_ms"]),
        "positions have a gap": (F.array_max(positions) + 1 != F.size(items)) | (F.array_min(positions) != 0),
        "not of this scope": ~j["cwd"].eqNullSafe(F.col("scope")),
    }
    error = F.coalesce("problem", *(F.when(F.coalesce(c, F.lit(False)), k) for k, c in checks.items()))
    return parsed.select("path", "scope", "j.*", error.alias("error"))


def items_of(journals: DataFrame) -> DataFrame:
    """The items of journals that can be used: batch_id, position, source, workspace, state, attempt."""
    return journals.filter(F.col("error").isNull()).select(F.col("id").alias("batch_id"), F.explode("items").alias("i")).select("batch_id", "i.position", "i.source", "i.workspace", F.col("i.state.status").alias("state"), F.col("i.state.attempt.number").alias("attempt"))


def listed(journals: DataFrame) -> DataFrame:
    """Journals with place: in their scope the newest first by time and name, those that can't be used last."""
    fine = F.col("error").isNull()
    order = Window.partitionBy("scope").orderBy(F.desc(fine), F.desc(F.when(fine, F.col("created_at_ms"))), F.desc(F.when(fine, F.col("id"))), "path")
    return journals.withColumn("place", (F.row_number().over(order) - 1).cast("long"))


def invalid(log: DataFrame) -> DataFrame:
    """log: also, where there are any, started_at_ms, finished_at_ms and attempt. batch_id, error: unknown states, positions with a gap, identifiers that are no names, attempts and times that can't be."""
    last = {c: F.col(c) if c in log.columns else F.lit(None).cast("long") for c in ("attempt", "started_at_ms", "finished_at_ms")}
    begun = F.col("state") != "pending"
    per = log.groupBy("batch_id").agg(
        F.bool_or(~F.col("state").isin(STATES)).alias("odd"), F.count_distinct("position").alias("n"), F.max("position").alias("top"), F.min("position").alias("low"),
        F.bool_or(begun & (last["attempt"] < 1)).alias("none"), F.bool_or((F.col("state") == "running") & last["finished_at_ms"].isNotNull()).alias("open"),
        F.bool_or(begun & (F.col("state") != "running") & (last["finished_at_ms"] < last["started_at_ms"])).alias("early"),
    )
    errors = F.array(
        F.when(F.coalesce("odd", F.lit(True)), "unknown state"), F.when((F.col("top") + 1 != F.col("n")) | (F.col("low") != 0), "positions have a gap"), F.when(~F.col("batch_id").cast("string").rlike("^[A-Za-z0-9_-]{1,96}$"), "no name"),
        F.when(F.col("none"), "an attempt has no number"), F.when(F.col("open"), "a running item is finished"), F.when(F.col("early"), "an item ends before it starts"),
    )
    return per.select("batch_id", F.explode(F.filter(errors, lambda e: e.isNotNull())).alias("error"))


def outcome(items: DataFrame) -> DataFrame:
    """One row: succeeded, failed, exit_code."""
    failed = F.count_if(F.col("state") != "complete")
    return items.agg(F.count_if(F.col("state") == "complete").alias("succeeded"), failed.alias("failed"), F.when(failed > 0, 1).otherwise(0).alias("exit_code"))
