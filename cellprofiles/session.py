"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators are written for. AQE re-plans joins and splits skewed
#: join partitions at run time; nothing here depends on the size of the cluster.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    app_name: str = "cellprofiles", master: str | None = None, **conf: str
) -> SparkSession:
    """Create (or get) a session with the library's defaults; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """This application's shared folder for intermediate tables.

    It lies below ``spark.checkpoint.dir``; where that is unset, below the warehouse folder. On a
    cluster that must not be a folder of one machine, since each executor would write to its
    own: this raises rather than losing parts. The folder is removed when the driver ends;
    :func:`scratch_scope` removes tables earlier.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        configured = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
        alone = re.match(r"local(\[|$)", spark.sparkContext.master)
        if not alone and not re.match(r"(?!file:)[A-Za-z][\w+.-]*:", configured):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = f"{configured.rstrip('/')}/cellprofiles-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(remove_scratch, spark, root)
    return root


_roots: set[str] = set()
_scopes: list[list[str]] = []


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Remove a scratch table, or the whole folder, through Spark's file system layer, if the session still runs."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch tables made inside the block at its end.

    Only for callers that have written or collected what they need by then.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove_scratch(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below :func:`scratch_root`."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a scan of it.

    Cuts the lineage, survives the loss of executors, freezes row identifiers, and later
    readers still prune columns. Use it for tables that several plans read.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Setting that has a query delete its shuffle files when it ends, and not when the driver next
#: collects garbage.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries inside the block delete their shuffle files when they end."""
    before = spark.conf.get(_SHUFFLE_CLEANUP, "false")
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)


def materialize_in_turn(spark: SparkSession, parts: Iterable[DataFrame], name: str) -> DataFrame:
    """Write tables of one schema, at least one, one after the other; return a scan of all.

    The shuffle files of one are deleted before the next runs, so the disk holds those of one.
    """
    path = scratch_path(spark, name)
    with shuffles_deleted(spark):
        for part in parts:
            schema = part.schema
            part.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
