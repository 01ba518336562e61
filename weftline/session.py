"""Session-level helpers: table access and cutting of lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Rows of a few numbers that a task passes on, at least, where there are more tasks than cores.
ROWS_A_TASK = 1 << 17

_written: list[tuple[SparkSession, str]] = []
#: What the call of ``settle`` or ``tidy`` that is under way has written; every thread has its own.
_steps: ContextVar[list[str] | None] = ContextVar("steps", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a dataset folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a
    temporary folder takes its place if all run on this machine, as in tests;
    on a cluster there is no such folder to fall back on.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="weftline-")
    if held.isEmpty():
        context.setCheckpointDir(found)
        return found if spark.conf.get("spark.checkpoint.dir", None) else context._jsc.sc().getCheckpointDir().get()
    return found


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/weftline-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    if (steps := _steps.get()) is not None:
        steps.append(path)
    return path


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back.

    Cuts the lineage with files that every executor can read, so a lost
    executor costs a re-read and no recomputation.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows at most, in no more partitions than cores or, of many rows, than hold ROWS_A_TASK each; nothing is shuffled."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)))


def release(*dfs: DataFrame) -> None:
    """Removes what ``materialize`` wrote for these, once nothing that is yet to run reads it."""
    for df in dfs:
        path = df.__dict__.pop("_weftline_path", None)
        if path:
            _remove(df.sparkSession, path)


def _within(make: Callable[[], DataFrame], unread: Callable[[DataFrame, str], bool]) -> DataFrame:
    """What ``make`` gives; of the steps that it wrote, here and not in other threads, those that are unread are removed."""
    outer, steps = _steps.get(), []
    token = _steps.set(steps)
    try:
        out = make()
    finally:
        _steps.reset(token)
    for path in steps:
        if unread(out, path):
            _remove(out.sparkSession, path)
        elif outer is not None:
            outer.append(path)
    return out


def settle(make: Callable[[], DataFrame], label: str = "step") -> DataFrame:
    """What ``make`` plans, written; the steps that it wrote on its way are removed."""
    return _within(lambda: materialize(make(), label), lambda out, path: path != out._weftline_path)


def tidy(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` plans, lazy as it is; the steps that its plan doesn't read are removed."""
    read: list[str] = []

    def unread(out: DataFrame, path: str) -> bool:
        if not read:
            read.extend(["", *out.inputFiles()])
        return not any(path.rpartition("/")[2] in f for f in read)

    return _within(make, unread)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    try:
        _written.remove((spark, path))
    except ValueError:  # by a path that was given up before
        pass


@atexit.register
def _clean() -> None:
    for spark, path in list(_written):
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone already
            return
