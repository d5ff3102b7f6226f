"""Tables that an operator writes in the folder all executors share, to cut lineage.

The folder is the one named in ``spark.checkpoint.dir``, or else the session's checkpoint folder.
Where neither is set, a local session (tests, a laptop) has one made and set; on a cluster that is
an error, as executors would write to their own disks. Everything written is removed when the
driver ends, or, for tables made inside ``scratch()``, when that block ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and (own := context._jsc.sc().getCheckpointDir()).isDefined():
        base = own.get()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="captionlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    app = context.applicationId
    if _made.get(app) != base:
        _made[app] = base
        atexit.register(_remove, spark, f"{base}/captionlake-{app}")
    return f"{base}/captionlake-{app}"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end, for intermediate ones that the result doesn't read."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)


def unused(name: str, columns: Iterable[str]) -> str:
    """name, with as many underscores more as it takes to be none of columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        delete(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if _open:
        _open[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder, in a folder for each value of by, and read again: computed once, whoever is lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a written table."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(jpath).getLength()
