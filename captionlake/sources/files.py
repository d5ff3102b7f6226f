"""Files by path: media inputs, correction manifests and texts to find terms in."""

from __future__ import annotations

import os
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The extensions that count as media.
MEDIA = ["aac", "aif", "aiff", "flac", "m4a", "mp3", "ogg", "opus", "wav", "avi", "m2ts", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "mts", "ts", "webm"]
# The extensions of files that terms are taken from.
TEXTS = ["md", "txt", "rs", "toml", "json", "yaml", "yml", "js", "ts", "tsx", "jsx", "py", "go", "java", "cs", "rb", "swift", "kt", "xml", "ini", "env"]
# What is trimmed from a token in a file.
TERM_CHARS = "\"'`()\\[\\]{}<>,;:"


def media_inputs(listed: DataFrame) -> DataFrame:
    """listed: group_pos (place of the argument), path. Media files in order, each once, where it first comes: position, path.

    Paths are compared as they are once "." and ".." and doubled slashes are gone. Places are counted
    within a group of arguments; groups begin where those before them end.
    """
    plain = F.aggregate(F.filter(F.split("path", "/"), lambda p: ~p.isin("", ".")), F.array().cast("array<string>"), _stepped)
    kept = listed.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(MEDIA))
    real = kept.withColumn("path", F.concat(F.when(F.col("path").startswith("/"), "/").otherwise(""), F.array_join(plain, "/")))
    once = real.groupBy("path").agg(F.min("group_pos").alias("group_pos"))
    # A row for each group of arguments: few.
    sizes = once.groupBy("group_pos").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("group_pos", F.coalesce(F.sum("n").over(Window.orderBy("group_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("group_pos").orderBy("path")) - 1
    return once.withColumn("place", place).join(offsets, "group_pos").select((F.col("offset") + F.col("place")).alias("position"), "group_pos", "path")


def _stepped(parts, part):
    up = (part == "..") & (F.size(parts) > 0) & (F.try_element_at(parts, F.lit(-1)) != "..")
    return F.when(up, F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(F.concat(parts, F.array(part)))


def list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """group_pos, path of all files below each of paths."""
    found = None
    for n, path in enumerate(paths):
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.lit(n).alias("group_pos"), "path")
        found = rows if found is None else found.union(rows)
    return found if found is not None else spark.createDataFrame([], "group_pos int, path string")


def manifest_rules(manifests: DataFrame) -> DataFrame:
    """manifests: manifest, scope_rank, text. A row for each line that isn't blank or a comment.

    scope_rank, rule_index, find, replace, line (from 1), error (why a line is no rule). The first
    " ->" parts a line; what is left of it may not be blank, what is right of it may.
    """
    lines = manifests.select("manifest", "scope_rank", F.posexplode(F.split("text", "\r?\n")).alias("at", "raw"))
    trimmed = lines.withColumn("raw", F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")).filter((F.col("raw") != "") & ~F.col("raw").startswith("#"))
    at = F.instr("raw", " ->")
    find = F.regexp_replace(F.substring("raw", F.lit(1), F.greatest(at - 1, F.lit(0))), r"(?U)^\s+|\s+$", "")
    replace = F.regexp_replace(F.expr("substring(raw, instr(raw, ' ->') + 3)"), r"(?U)^\s+|\s+$", "")
    error = F.when(F.col("raw").startswith("->"), "nothing to find").when(at == 0, "no separator").when(find == "", "nothing to find")
    index = (F.row_number().over(Window.partitionBy("manifest").orderBy("at")) - 1).cast("long")
    return trimmed.select("manifest", "scope_rank", index.alias("rule_index"), F.when(error.isNull(), find).alias("find"), F.when(error.isNull(), replace).alias("replace"), (F.col("at") + 1).cast("long").alias("line"), error.alias("error"))


def contributing(rules: DataFrame, explicit: bool = False) -> DataFrame:
    """Rules of the manifests that have any. An explicit manifest without rules is an error."""
    if explicit and rules.filter("error is null").isEmpty():
        raise ValueError("the manifest has no rules")
    return rules.filter("error is null").drop("error", "line")


def manifest_paths(cwd: str, output: str, explicit: str | None = None, name: str = "corrections.md") -> list[tuple[str, int]]:
    """Where manifests for an output folder may lie, broad first, as (path, scope_rank)."""
    if explicit:
        return [(explicit, 0)]
    base, out = (PurePosixPath(os.path.normpath(p)) for p in (cwd, output))
    if out != base and base in out.parents:
        folders = [base, *(base.joinpath(*out.relative_to(base).parts[: n + 1]) for n in range(len(out.relative_to(base).parts)))]
    else:
        folders = [out] if out == base else [out.parent, out]
    return [(str(f / name), n) for n, f in enumerate(folders)]


def term_tokens(files: DataFrame, min_key: int = 3) -> DataFrame:
    """files: path, text, authoritative. Tokens that look like terms: path, line (from 1), place, token, key.

    A term has a dot, an underscore or a capital letter and three bytes at least.
    """
    from captionlake.functions.text import term_key, words_of

    also = [c for c in ("root",) if c in files.columns]
    lines = files.select(*also, "path", "authoritative", F.posexplode(F.split("text", "\r?\n")).alias("at", "line_text"))
    tokens = lines.select(*also, "path", "authoritative", (F.col("at") + 1).cast("long").alias("line"), F.posexplode(words_of(F.col("line_text"))).alias("place", "raw"))
    trimmed = tokens.withColumn("token", F.regexp_replace("raw", f"^[{TERM_CHARS}]+|[{TERM_CHARS}]+$", "")).drop("raw")
    kept = trimmed.filter(F.col("token").rlike(r"[._\p{Lu}]") & (F.octet_length("token") >= 3)).withColumn("key", term_key(F.col("token")))
    return kept.filter(F.char_length("key") >= min_key)


# How deep a crawl goes and how large a file may be.
DEPTH, FILE_BYTES = 4, 1_000_000


def term_files(listed: DataFrame) -> DataFrame:
    """listed: root, path (absolute, below root), length. Those that terms are taken from, by depth, name and size.

    No folder is entered that is too deep or begins with a dot; a file's own name may.
    """
    below = F.expr("substring(path, length(rtrim('/', root)) + 2)")
    folders = F.slice(F.split(below, "/"), F.lit(1), F.greatest(F.size(F.split(below, "/")) - 1, F.lit(0)))
    kept = (F.size(folders) <= DEPTH) & ~F.exists(folders, lambda f: f.startswith("."))
    # A name that is all extension (".env") has none.
    ending = F.lower(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1))
    return listed.filter(F.col("path").startswith(F.concat(F.rtrim("root", F.lit("/")), F.lit("/"))) & kept & ending.isin(TEXTS) & (F.col("length") <= FILE_BYTES))


def sibling_files(listed: DataFrame, own: DataFrame) -> DataFrame:
    """listed: path, length, workspace; own: root (of a discovery), workspace. The transcripts of other workspaces of the root: root, path, length."""
    texts = listed.filter(F.col("path").endswith("/transcript.txt") & (F.col("length") <= FILE_BYTES)).withColumn("root", F.regexp_replace("workspace", "/[^/]+/[^/]+/?$", ""))
    return texts.join(own.select("root", F.col("workspace").alias("own")), "root").filter(F.col("workspace") != F.col("own")).select("root", "path", "length")


def read_term_files(spark: SparkSession, root: str) -> DataFrame:
    """root, path, length, text of the files below root that terms are taken from; those that are no UTF-8 are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.lit(root).alias("root"), F.regexp_replace("path", "^file:(//)?", "").alias("path"), "length", "content")
    return term_files(found).withColumn("text", F.try_validate_utf8(F.col("content").cast("string"))).filter(F.col("text").isNotNull()).drop("content")


def union_of_terms(sources: list[tuple[DataFrame, bool, int]]) -> DataFrame:
    """sources: files (root, path, text), whether they are authoritative, and the least length of a key. Their tokens, a path only from the first source that has it: root, rank, path, line, place, token, key, authoritative."""
    parts = []
    for rank, (files, authoritative, min_key) in enumerate(sources):
        tokens = term_tokens(files.select("root", "path", "text", F.lit(authoritative).alias("authoritative")), min_key)
        parts.append(tokens.withColumn("rank", F.lit(rank)))
    every = reduce(DataFrame.unionByName, parts)
    first = F.min("rank").over(Window.partitionBy("root", "path"))
    return every.withColumn("_first", first).filter(F.col("rank") == F.col("_first")).drop("_first")
