"""Session options and the few helpers that every plan needs."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Bytes that one Arrow batch to a Python worker holds, up to one row more.
ARROW_BATCH_BYTES = 4 << 20


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the options the engine is tested under (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(master)
        .appName("genoframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all run on this machine (tests)."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="genoframe-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a plan in the shared folder and continue from the files.

    Parquet in place of ``checkpoint()``: columns stay columnar, so later reads
    prune them, and a lost executor costs nothing that was already written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._cut_path = path
    if _SCRATCH:
        _SCRATCH[-1].append(written)
    return written


_SCRATCH: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """What ``cut`` writes inside is deleted at the end, but for what the caller takes out of the list: its result, written last."""
    _SCRATCH.append([])
    try:
        yield _SCRATCH[-1]
    finally:
        for df in _SCRATCH.pop():
            drop_cut(df)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of just what ``cut`` returned, once no later plan reads them; plans derived from it are left alone."""
    path = getattr(df, "_cut_path", None)
    if path is not None:
        spark = df.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python workers can import it, and bound Arrow batches.

    Batches are bounded by bytes as well as rows: ten thousand long texts would not fit a worker.
    """
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="genoframe-ship-"), "genoframe_pkg.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, str(file.relative_to(root.parent)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


_KEPT: dict[object, object] = {}
#: Tasks of this worker that have asked for a kept value since they began.
_ASKED: set[int] = set()


def kept(owner: object, key: object, make: Callable[[], object]) -> object:
    """A value that a Python worker keeps between tasks: made once for each owner (a broadcast's id) and key; another owner's values go first."""
    _ASKED.add(0)
    if _KEPT.get("owner") != owner:
        if _KEPT:
            _KEPT.clear()
            _trim()
        _KEPT["owner"] = owner
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def _trim() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function that gives freed memory back to the system when its task ends; workers outlive tasks and stages.

    What earlier stages kept goes too, if the task did not ask for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _ASKED.clear()
        try:
            yield from function(batches)
        finally:
            if not _ASKED:
                _KEPT.clear()
            _trim()

    return run
