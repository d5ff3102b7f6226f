"""Queries on batches, recorded files and inputs, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionlake.functions import paths
from captionlake.operators import attest as A
from captionlake.operators import batches as B
from captionlake.operators import recovery
from captionlake.sources import files as S
from captionlake.shared import folder
from captionlake.sources import fixtures as X
from captionlake.sources import publish
from captionlake.streaming import completions

STATE = {"view": "pending", "signup": "running", "error": "failed", "click": "complete", "purchase": "complete"}


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(X.table(spark, sf_dir, "events"))


def _changes(events: DataFrame) -> DataFrame:
    """Events as changes: a user is a batch, the event's kind a state; the last digit of the id is the item."""
    state = F.element_at(F.create_map(*(F.lit(x) for kv in STATE.items() for x in kv)), F.col("event_type"))
    return events.select(F.col("user_id").alias("batch_id"), (F.col("event_id") % 10).alias("position"), state.alias("state"), F.floor(F.col("event_id") / 7).alias("at_ms"), F.col("event_id").alias("seq"))


def batch_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.latest(_log(spark, sf_dir))


def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.counts(batch_latest_state(spark, sf_dir))


def batch_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.attempts(_log(spark, sf_dir)).select("batch_id", "position", "seq", "attempt")


def completion_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream follows the events and writes each end as it comes; both orders of the items from what it wrote."""
    fields = X.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").schema
    # A pattern, as a stream takes no path of a single file.
    events = spark.readStream.schema(fields).parquet(f"{sf_dir}/events.parque[t]")
    base = f"{folder(spark)}/ends-{uuid.uuid4().hex[:12]}"
    completions.follow(_changes(events), f"{base}/state", f"{base}/out").awaitTermination()
    return completions.orders(completions.followed(spark, f"{base}/out"))


LEASE_MS = 250


def item_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of every item, whether it was refused, and the leases that ran out by the end of the log. Dear clicks ask for another run, dear errors say that something is gone."""
    dear = X.table(spark, sf_dir, "events").filter("value > 60").select(F.col("event_id").alias("seq"), F.lit(True).alias("dear"))
    other = F.when(F.col("dear") & (F.col("state") == "complete"), "needs-reprocessing").when(F.col("dear") & (F.col("state") == "failed"), "missing").otherwise(F.col("state"))
    log = _log(spark, sf_dir).join(dear, "seq", "left").withColumn("state", other)
    until = log.agg(F.max("at_ms")).first()[0]
    return B.history(log, LEASE_MS, until).withColumn("seq", F.coalesce("seq", F.lit(-1))).withColumn("error", F.coalesce("error", F.lit("")))


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).groupBy("batch_id").agg(F.min("at_ms").alias("created_ms"))
    return log.select("batch_id", (F.col("batch_id") % 6).alias("scope"), "created_ms")


def newest_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.newest_incomplete(_batches(spark, sf_dir), batch_counts(spark, sf_dir))


def batch_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    leases = _batches(spark, sf_dir).filter("batch_id % 4 = 0").select("batch_id")
    return B.activity(batch_counts(spark, sf_dir), leases)


def verify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.table(spark, sf_dir, "documents")
    path, digest = F.concat(F.when(F.col("doc_id") % 17 == 0, "../").otherwise(""), F.lit("doc-"), F.col("doc_id")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256)
    tracked = docs.select(path, F.when(F.col("doc_id") % 7 == 0, F.sha2(F.lit("x"), 256)).otherwise(digest).alias("digest"), F.when(F.col("doc_id") % 2 == 0, "artifact").otherwise("source").alias("kind"))
    actual = docs.filter(F.col("doc_id") % 11 != 0).select(path, F.upper(digest).alias("digest"), (F.col("doc_id") % 13 != 0).alias("is_file"))
    return A.verified(tracked, actual)


def publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files to be written, files that are there and files that we own, by remainders of the id."""
    docs = X.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"))
    one = lambda keep, text: docs.filter(keep).select("path", text.cast("string").alias("digest"))
    i = F.col("doc_id")
    return A.publication(one(i % 2 == 0, i % 5), one(i % 3 != 0, i % 4), one(i % 7 != 0, i % 6))


def published_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a file, published twice: at first those of even ids in upper case, then all; what lies there afterwards."""
    root = f"{folder(spark)}/published-{uuid.uuid4().hex[:12]}"
    publish.register(spark)
    docs = X.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id") % 10, F.lit("/doc-"), "doc_id", F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    for some in (docs.filter("doc_id % 2 = 0").select("path", F.upper("text").alias("content")).union(docs.filter("doc_id = 0").select(F.lit("stale.txt"), F.lit("x"))), docs.select("path", F.col("text").alias("content"))):
        some.select("path", F.col("content").cast("binary").alias("content")).write.format("published").mode("append").option("root", root).save()
    lie = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(root)
    return lie.select(F.regexp_extract("path", r"([^/]*/[^/]*\.txt)$", 1).alias("path"), F.sha2("content", 256).alias("digest"))


def resumed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider asked about every turn in three runs over one log. In the first it fails where a text's length divides by three, in the second by nine, in the third by 27: these stay without an answer."""
    turns = X.table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.coalesce("text", F.lit("")).alias("prompt"))
    log = f"{folder(spark)}/replies-{uuid.uuid4().hex[:12]}"

    def failing(every: int):
        def provider(prompts: list[str]) -> list[str]:
            if len(prompts[0]) % every == 0:
                raise TimeoutError(f"no answer to {len(prompts[0])} letters")
            return [f"You said: {p}" for p in prompts]

        return provider

    for every in (3, 9, 27):
        told = recovery.resume(turns, failing(every), log, per_call=1)
    return told.select("key", F.col("attempts").cast("long").alias("attempts"), F.sha2(F.coalesce("reply", F.lit("")), 256).alias("reply_sha256"), F.coalesce("error", F.lit("")).alias("error"))


def media_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files named on three command lines, some by a roundabout path, some with other endings."""
    i = F.col("doc_id")
    ending = F.when(i % 4 == 0, ".MP4").when(i % 4 == 1, ".txt").when(i % 4 == 2, ".tar.wav").otherwise("")
    path = F.concat(F.lit("in/"), "source", F.when(i % 5 == 0, "/x/../").when(i % 5 == 1, "/./").otherwise("/"), (i % 700).cast("string"), ending)
    found = S.media_inputs(X.table(spark, sf_dir, "documents").select((i % 3).alias("group_pos"), path.alias("path")))
    return found.withColumn("position", F.col("position").cast("long"))


def output_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as paths; of each that meets another its digest."""
    found = A.collisions(X.table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select(F.col("text").alias("path")))
    return found.select(F.sha2("folded", 256).alias("folded"), "n")


def path_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages as files, some named from the working folder or in a roundabout way, seen from the folder of the page before, from one that holds the file and from one below the file's own."""
    i, address = F.col("page_id"), F.regexp_replace("url", r"^[a-z]+://|/*([?#].*)?$", "")
    spelt = F.when(i % 4 == 0, address).when(i % 4 == 1, F.concat(F.lit("/web/./"), address)).when(i % 4 == 2, F.concat(F.lit("x/..//"), address, F.lit("/"))).otherwise(F.concat(F.lit("/../web/y/z/../../"), address))
    pages = X.table(spark, sf_dir, "pages").select(i, address.alias("address"), spelt.alias("path"))
    before = pages.select((i + 1).alias("page_id"), F.concat(F.lit("/web/"), F.col("address"), F.lit("/..")).alias("before"))
    base = F.when(i % 3 == 0, F.col("before")).when(i % 3 == 1, F.concat(F.lit("/web/"), F.regexp_extract("address", "^[^/]+", 0))).otherwise(F.concat(F.lit("/web/"), F.col("address"), F.lit("/../new/deep")))
    met = pages.join(before, "page_id", "left").withColumn("base", F.coalesce(base, F.lit("/")))
    seen = [f(F.col("base"), F.col("path"), "/web").alias(f.__name__) for f in (paths.tracked_reference, paths.manifest_reference)]
    return met.select("page_id", paths.plain(F.col("path"), "/web").alias("path"), *seen)


_MAP = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATE.items()) + " END"
_LOG = f"log AS (SELECT user_id AS batch_id, event_id % 10 AS position, {_MAP} AS state, event_id // 7 AS at_ms, event_id AS seq FROM events)"
_LATEST = f"{_LOG}, latest AS (SELECT batch_id, position, arg_max(state, (at_ms, seq, state)) AS state, max(at_ms) AS at_ms FROM log GROUP BY ALL)"
_COUNTS = f"{_LATEST}, counts AS (SELECT batch_id, count(*) FILTER (state = 'complete') AS complete, count(*) FILTER (state <> 'complete') AS incomplete, bool_and(state = 'complete') AS is_complete, bool_or(state = 'running') AS has_running FROM latest GROUP BY batch_id)"
_OPEN = "created AS (SELECT batch_id, batch_id % 6 AS scope, min(at_ms) AS created_ms FROM log GROUP BY batch_id)"

QUERIES = {f.__name__: f for f in (batch_latest_state, batch_counts, batch_attempts, completion_orders, item_history, newest_incomplete, batch_activity, verify_files, publication, published_files, resumed_replies, media_inputs, output_collisions, path_references)}
SQL = {
    "batch_latest_state": f"WITH {_LATEST} SELECT * FROM latest",
    "batch_counts": f"WITH {_COUNTS} SELECT * FROM counts",
    "batch_attempts": f"WITH {_LOG} SELECT batch_id, position, seq, (count(*) FILTER (state = 'running') OVER (PARTITION BY batch_id, position ORDER BY at_ms, seq)) AS attempt FROM log",
    "completion_orders": f"""WITH {_LOG}, items AS (SELECT batch_id, position, arg_max(state, (at_ms, seq)) AS state, max((at_ms, seq)) AS x, count(*) AS n_ends FROM log WHERE state IN ('complete', 'failed', 'missing') GROUP BY ALL)
        SELECT batch_id, position, state, x[1] AS at_ms, n_ends, row_number() OVER (PARTITION BY batch_id ORDER BY position) - 1 AS input_place, row_number() OVER (PARTITION BY batch_id ORDER BY x) - 1 AS completion_place FROM items""",
    "item_history": f"""WITH RECURSIVE log AS (
            SELECT user_id AS batch_id, event_id % 10 AS position, CASE WHEN value > 60 AND event_type IN ('click', 'purchase') THEN 'needs-reprocessing' WHEN value > 60 AND event_type = 'error' THEN 'missing' ELSE {_MAP} END AS wanted,
                   event_id // 7 AS at_ms, event_id AS seq FROM events),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY batch_id, position ORDER BY at_ms, seq) AS n FROM log),
        walk AS (
            SELECT batch_id, position, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS wanted, 'pending' AS state, 0::BIGINT AS attempt, 0::BIGINT AS since, 0::BIGINT AS at_ms, NULL::VARCHAR AS error, NULL::BIGINT AS lapsed, 0::BIGINT AS was
            FROM ranked WHERE n = 1
            UNION ALL
            SELECT batch_id, position, n, seq, wanted, CASE WHEN error IS NULL AND wanted <> 'pending' THEN wanted ELSE now END,
                   CASE WHEN error IS NULL AND wanted = 'running' THEN attempt + 1 ELSE attempt END, CASE WHEN error IS NULL AND wanted <> 'pending' THEN at_ms ELSE coalesce(lapsed, since) END, at_ms, error, lapsed, attempt
            FROM (SELECT *, CASE WHEN wanted = 'pending' AND attempt = 0 THEN NULL WHEN wanted = 'pending' THEN 'an item that has begun isn''t pending again'
                                 WHEN wanted = 'running' AND now IN ('running', 'complete') THEN 'an item that runs or is complete doesn''t start'
                                 WHEN wanted IN ('complete', 'failed', 'missing') AND now <> 'running' THEN 'only an item that runs can end'
                                 WHEN wanted = 'needs-reprocessing' AND now NOT IN ('running', 'complete') THEN 'only an item that runs or is complete can need reprocessing' END AS error
                  FROM (SELECT r.*, w.attempt, w.since, CASE WHEN w.state = 'running' AND w.since + {LEASE_MS} <= r.at_ms THEN w.since + {LEASE_MS} END AS lapsed,
                               CASE WHEN w.state = 'running' AND w.since + {LEASE_MS} <= r.at_ms THEN 'interrupted' ELSE w.state END AS now
                        FROM walk w JOIN ranked r ON r.batch_id = w.batch_id AND r.position = w.position AND r.n = w.n + 1))),
        last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY batch_id, position ORDER BY n DESC) = 1)
        SELECT batch_id, position, seq, wanted, state, attempt, at_ms, coalesce(error, '') AS error FROM walk WHERE n > 0
        UNION ALL SELECT batch_id, position, -1, 'interrupted', 'interrupted', was, lapsed, '' FROM walk WHERE lapsed IS NOT NULL
        UNION ALL SELECT batch_id, position, -1, 'interrupted', 'interrupted', attempt, since + {LEASE_MS}, '' FROM last WHERE state = 'running' AND since + {LEASE_MS} <= (SELECT max(at_ms) FROM log)""",
    "newest_incomplete": f"WITH {_COUNTS}, {_OPEN} SELECT scope, arg_max(batch_id, (created_ms, batch_id)) AS batch_id, max(created_ms) AS created_ms FROM created JOIN counts USING (batch_id) WHERE NOT is_complete GROUP BY scope",
    "batch_activity": f"WITH {_COUNTS} SELECT batch_id, CASE WHEN is_complete THEN 'complete' WHEN NOT has_running THEN 'incomplete' WHEN batch_id % 4 = 0 THEN 'active' ELSE 'interrupted' END AS activity FROM counts",
    "verify_files": """SELECT CASE WHEN doc_id % 17 = 0 THEN '../' ELSE '' END || 'doc-' || doc_id AS path, CASE WHEN doc_id % 2 = 0 THEN 'artifact' ELSE 'source' END AS kind,
               CASE WHEN doc_id % 17 = 0 THEN 'unsafe' WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 13 = 0 THEN 'not-a-file' ELSE 'changed' END AS problem
        FROM documents WHERE doc_id % 17 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 7 = 0""",
    "publication": """WITH d AS (SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 2 = 0 THEN doc_id % 5 END AS new, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 4 END AS there, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 6 END AS owned FROM documents),
        a AS (SELECT path, CASE WHEN new IS NOT NULL AND there IS NULL THEN 'write' WHEN new = there THEN 'keep' WHEN new IS NOT NULL AND owned = there THEN 'write' WHEN new IS NOT NULL THEN 'refuse'
                               WHEN there IS NOT NULL AND owned = there THEN 'delete' WHEN owned IS NOT NULL AND there IS NOT NULL THEN 'leave' END AS action FROM d)
        SELECT * FROM a WHERE action IS NOT NULL""",
    "published_files": "SELECT doc_id % 10 || '/doc-' || doc_id || '.txt' AS path, sha256(coalesce(text, '')) AS digest FROM documents",
    "resumed_replies": """WITH t AS (SELECT conv_id || '-' || turn AS key, min(coalesce(text, '')) AS text FROM conversations GROUP BY ALL)
        SELECT key, CASE WHEN length(text) % 3 > 0 THEN 1 WHEN length(text) % 9 > 0 THEN 2 ELSE 3 END::BIGINT AS attempts, sha256(CASE WHEN length(text) % 27 = 0 THEN '' ELSE 'You said: ' || text END) AS reply_sha256,
               CASE WHEN length(text) % 27 = 0 THEN 'TimeoutError: no answer to ' || length(text) || ' letters' ELSE '' END AS error FROM t""",
    "media_inputs": """WITH f AS (SELECT doc_id % 3 AS group_pos, 'in/' || source || '/' || (doc_id % 700) || CASE doc_id % 4 WHEN 0 THEN '.MP4' ELSE '.tar.wav' END AS path FROM documents WHERE doc_id % 4 IN (0, 2)),
               o AS (SELECT path, min(group_pos) AS group_pos FROM f GROUP BY path)
        SELECT row_number() OVER (ORDER BY group_pos, path) - 1 AS position, group_pos, path FROM o""",
    "path_references": r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://|/*([?#].*)?$', '', 'g') AS address FROM pages),
        f AS (SELECT p.page_id, list_concat(['web'], string_split(p.address, '/')) AS there,
                     CASE WHEN p.page_id % 3 = 1 THEN ['web', string_split(p.address, '/')[1]] WHEN p.page_id % 3 = 2 THEN list_concat(['web'], string_split(p.address, '/')[:-2], ['new', 'deep'])
                          WHEN b.address IS NULL THEN CAST([] AS VARCHAR[]) ELSE list_concat(['web'], string_split(b.address, '/')[:-2]) END AS here
              FROM p LEFT JOIN p b ON b.page_id = p.page_id - 1),
        c AS (SELECT *, len(list_filter(range(1, least(len(here), len(there)) + 1), lambda k: here[:k] = there[:k])) AS common FROM f),
        r AS (SELECT *, '/' || array_to_string(there, '/') AS path, array_to_string(list_concat(list_transform(range(len(here) - common), lambda k: '..'), there[common + 1:]), '/') AS tracked_reference FROM c)
        SELECT page_id, path, tracked_reference, CASE WHEN common = len(here) OR common = len(there) - 1 THEN tracked_reference ELSE path END AS manifest_reference FROM r""",
    "output_collisions": "SELECT sha256(lower(text)) AS folded, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY lower(text) HAVING count(*) > 1",
}
