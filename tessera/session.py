"""Session settings and lineage cutting.

``cut`` is the only place that materialises an intermediate table.  It writes parquet
into the folder named by ``spark.checkpoint.dir`` so that a lost executor never forces
an iterative job to start over, and so that the planner sees real sizes afterwards.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_WRITTEN: set[str] = set()
#: Spark deletes the shuffle files of an execution at its end; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # call-site capture costs milliseconds per column expression
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the configured one, else a local one for tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    existing = context._jsc.sc().getCheckpointDir()
    if existing.isDefined():
        return existing.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if "dir" not in _FALLBACK:
        _FALLBACK["dir"] = tempfile.mkdtemp(prefix="tessera-ckpt-")
        atexit.register(shutil.rmtree, _FALLBACK["dir"], ignore_errors=True)
    return _FALLBACK["dir"]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and continue from the written table; its shuffle files go at once."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _WRITTEN.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete the files behind tables that ``cut`` returned, once nothing reads them any more: rounds that a loop has left behind."""
    for t in tables:
        path = getattr(t, "_cut_path", None)
        if path in _WRITTEN:
            _delete(t.sparkSession, path)


def written() -> set[str]:
    """Paths of the intermediate tables that stand now."""
    return set(_WRITTEN)


def track(path: str) -> str:
    """Count a table written in another way than by ``cut`` among the intermediate ones."""
    _WRITTEN.add(path)
    return path


def release_unread(paths: set[str], docs: DataFrame) -> None:
    """Delete those of the intermediate tables at ``paths`` that ``docs`` does not read."""
    read = docs.inputFiles()
    for path in paths & _WRITTEN:
        if not any(f"/{path.rstrip('/').rsplit('/', 1)[-1]}/" in f for f in read):
            _delete(docs.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Delete every intermediate table that this process has written; for the end of a job, when its results are stored elsewhere."""
    for path in list(_WRITTEN):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    _WRITTEN.discard(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
