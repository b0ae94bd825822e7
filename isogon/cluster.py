"""Things that depend on the session and not on any operator: shipping the
package to executors, finding the folder that driver and executors share, and
cutting lineage there."""

from __future__ import annotations

import ctypes
import gc
import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Of a Python worker: what modules keep from task to task.
CACHES: list[dict] = []


def ship(spark: SparkSession) -> None:
    """Make this package importable in every Python worker of the application.

    Also bounds the Arrow batches sent to Python, so that tables of very long
    texts do not build batches of gigabytes. What the session bounds lower stays. The
    bounds stay set, as the frames that need them run later."""
    app = spark.sparkContext.applicationId
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 4096), ("spark.sql.execution.arrow.maxBytesPerBatch", 16777216)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    target = os.path.join(tempfile.mkdtemp(prefix="isogon-ship-"), f"isogon-{uuid.uuid4().hex[:8]}.zip")
    with open(target, "wb") as f:
        f.write(data.getvalue())
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one of our own only
    where the session names none and runs in one process (tests). On a cluster a
    folder of the driver's would be another one on each executor: an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(sc, "_isogon_shared", None)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="isogon-shared-")
            sc._isogon_shared = root
    if not getattr(sc, "_isogon_checkpoint", False):
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(root)
        sc._isogon_checkpoint = True
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's part of the shared folder."""
    return f"{shared_root(spark)}/isogon/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def clear(spark: SparkSession) -> None:
    """Remove what this application has put in the shared folder through scratch().
    Frames that read it must not be used afterwards."""
    _delete(spark, f"{shared_root(spark)}/isogon/{spark.sparkContext.applicationId}")


def free(name: str, taken: list[str]) -> str:
    """name, with underscores at its end until no column in taken has it."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def through_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends
    there and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._isogon_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of through_table() that nothing will read any more."""
    for df in tables:
        _delete(df.sparkSession, df._isogon_path)


def let_go(but: dict | None = None) -> None:
    """Empty the worker's caches but the one given, and give memory that is free back to the
    system: the worker lives on beside those of later stages."""
    for cache in CACHES:
        if cache is not but:
            cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # there is none but in glibc
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable, cache: dict | None = None) -> Callable:
    """run, a function of a worker's batches, between two let_go()."""

    def tidied(batches):
        let_go(cache)
        yield from run(batches)
        let_go(cache)

    return tidied


@contextmanager
def spent(spark: SparkSession):
    """Removes the shuffle files that were made inside, which Spark does only after some
    collection on the driver. For jobs whose result lies in a table when they end, and which run
    beside no others of the application: another would have to make its shuffle files anew."""
    sc = spark.sparkContext._jsc.sc()
    start = sc.newShuffleId()
    yield
    cleaner = sc.cleaner()
    if cleaner.isDefined():
        for i in range(start + 1, sc.newShuffleId()):
            cleaner.get().doCleanupShuffle(i, True)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for small tables: its files go when the frame does."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)
