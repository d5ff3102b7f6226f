"""Provider calls that may fail: what came of each is a row of a log, and a later run asks only what isn't settled.

The log is a folder of Parquet files to which each run adds its own; nothing in it is changed. A key
is settled when an answer of it is there, and given up when so many attempts failed. A run that is
killed adds nothing, so what it asked is asked again; tasks that are run twice ask twice, but one
answer of them is kept. Two runs over one log at once may ask the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[str]]
LOG = "key string, attempt int, reply string, error string"
REPLY = "struct<reply:string,error:string>"


def replies(prompts: list[str | None], provider: Provider, per_call: int) -> list[tuple[str | None, str | None]]:
    """What the provider says to each prompt, or why it says nothing. A call that fails, or answers too few or too many, fails for its prompts alone; a null prompt isn't asked."""
    found: list[tuple[str | None, str | None]] = [(None, "nothing to ask")] * len(prompts)
    asked = [n for n, p in enumerate(prompts) if p is not None]
    for at in range(0, len(asked), per_call):
        some = asked[at : at + per_call]
        try:
            said = list(provider([prompts[n] for n in some]))
            if len(said) != len(some):
                raise ValueError(f"{len(said)} replies to {len(some)} prompts")
            told = [(s, None if s is not None else "no reply") for s in said]
        except Exception as failed:  # Whatever a provider raises is an outcome to record.
            told = [(None, f"{type(failed).__name__}: {failed}")] * len(some)
        for n, t in zip(some, told, strict=True):
            found[n] = t
    return found


def asked(rows: DataFrame, prompt: Column, provider: Provider, reply: str = "reply", error: str = "error", per_call: int = 16) -> DataFrame:
    """rows with what the provider makes of each prompt, and why it makes nothing of it: no call that fails ends the job."""
    if per_call < 1:
        raise ValueError("a call has one prompt at least")
    fields = [*((f.name, f.dataType.simpleString()) for f in rows.schema), (reply, "string"), (error, "string")]
    if len({n.lower() for n, _ in fields}) < len(fields):
        raise ValueError(f"columns called {reply} or {error} are there already")
    schema = ", ".join(f"`{n}` {t}" for n, t in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = replies(batch.columns[-1].to_pylist(), provider, per_call)
            said, why = pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], said, why], names=[n for n, _ in fields])

    return rows.withColumn("_prompt", prompt).mapInArrow(run, schema)


def attempts(spark: SparkSession, log: str) -> DataFrame:
    """The log: key, attempt (from 1), reply, error. Empty where no run has begun."""
    try:
        return spark.read.schema(LOG).parquet(log)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def outcomes(logged: DataFrame) -> DataFrame:
    """A row for each key that was asked: key, attempts (so many were made), reply (of the first that had one), error (of the last, where none had)."""
    has = F.col("reply").isNotNull()
    first = F.min(F.when(has, F.struct("attempt", "reply")))
    last = F.max(F.when(~has, F.struct("attempt", "error")))
    made = logged.groupBy("key").agg(F.max("attempt").alias("attempts"), first.alias("good"), last.alias("bad"))
    return made.select("key", "attempts", F.col("good.reply").alias("reply"), F.when(F.col("good").isNull(), F.col("bad.error")).alias("error"))


def open_prompts(prompts: DataFrame, logged: DataFrame, most: int | None = None) -> DataFrame:
    """prompts: key, prompt. Those to ask now, each key once, with the number of the attempt: neither answered nor given up after most attempts."""
    known = outcomes(logged).select("key", "attempts", F.col("reply").isNotNull().alias("settled"))
    each = prompts.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("prompt").alias("prompt"))
    left = each.join(known, "key", "left").filter(~F.coalesce("settled", F.lit(False)))
    if most is not None:
        left = left.filter(F.coalesce("attempts", F.lit(0)) < most)
    return left.select("key", "prompt", (F.coalesce("attempts", F.lit(0)) + 1).cast("int").alias("attempt"))


def resume(prompts: DataFrame, provider: Provider, log: str, most: int | None = None, per_call: int = 16) -> DataFrame:
    """prompts: key (string), prompt. One run: asks what isn't settled, adds what came of it to the log, and gives the outcomes so far of all that was ever asked.

    Prompts with a null key aren't asked; of several with one key the least is. Attempts of one key
    count on from run to run.
    """
    spark = prompts.sparkSession
    todo = open_prompts(prompts, attempts(spark, log), most)
    said = asked(todo, F.col("prompt"), provider, per_call=per_call)
    # The commit protocol makes a run's rows visible together, or not at all.
    said.select("key", "attempt", "reply", "error").write.mode("append").parquet(log)
    return outcomes(attempts(spark, log))
