"""Session helpers: defaults for local use, checkpoint folder, size-checked small sides."""

from __future__ import annotations

import atexit
import os
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar
from uuid import uuid4

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "lodeworks") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own session."""
    return find_on_workers(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LODEWORKS_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def find_on_workers(spark: SparkSession) -> SparkSession:
    """Put this package's place on the path of the Python workers.

    Where executors do not see that place, give them the package with ``--py-files`` as usual.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a session on this machine alone (tests, a
    laptop) gets a temporary folder, once, and on a cluster it is an error: its machines share no such folder.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(found)
        return found
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isEmpty():
        return current.get()
    if not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir is not set; on a cluster it must name a folder that all machines share")
    made = "file://" + tempfile.mkdtemp(prefix="lodeworks-checkpoint-")
    sc.setCheckpointDir(made)
    return made


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


_STAGED: dict[str, SparkSession] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: cuts the lineage and outlives executors.

    What is not removed by ``dropped`` before is removed when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"
    _STAGED[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made and that nothing reads any more."""
    held = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for t in tables for f in t.inputFiles()}
    for path in [p for p in _STAGED if p.split(":", 1)[-1].lstrip("/") in held]:
        _remove(path, _STAGED.pop(path))


def _remove(path: str, spark: SparkSession) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


@atexit.register
def _remove_staged() -> None:
    while _STAGED:
        path, spark = _STAGED.popitem()
        try:
            if spark.sparkContext._jsc is not None:
                _remove(path, spark)
        except Exception:  # the session ended before: its folder is all that is left
            continue


def at_once(jobs: dict[str, Callable[[], T]]) -> dict[str, T]:
    """Results of independent jobs by name, all submitted at once, so that small ones share the executors."""
    with ThreadPoolExecutor(max(1, len(jobs))) as pool:
        running = {name: pool.submit(job) for name, job in jobs.items()}
        return {name: f.result() for name, f in running.items()}


class TooLarge(ValueError):
    """A side that must stay small exceeded its documented bound."""


def bounded_rows(df: DataFrame, limit: int, what: str) -> list[Row]:
    """Collect a side that is small by contract; more than ``limit`` rows raise instead of being cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooLarge(f"{what} has more than {limit} rows, the bound that this operator documents for it")
    return rows


def small_side(df: DataFrame, limit: int) -> DataFrame:
    """``df`` with a broadcast hint where it has at most ``limit`` rows, without one beyond that.

    The count reads at most ``limit + 1`` rows. Beyond the bound the join stays a shuffled join, which
    adaptive execution may still split on skew.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
