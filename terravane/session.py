"""Session helpers: one place for the settings the engine relies on."""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("terravane")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TERRAVANE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; choose a folder only where none is named (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="terravane-"))


def at_once(*steps: Callable[[], Any]) -> list[Any]:
    """Results of independent steps; their jobs run side by side, so that short stages don't leave the cluster idle."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(min(8, len(steps))) as pool:
        return [f.result() for f in [pool.submit(inherit(s)) for s in steps]]


def cut(df: DataFrame) -> DataFrame:
    """Materialise on reliable storage, so that a lost executor costs no earlier stage.

    The plan of a checkpoint still carries the constraints of the plan it came from, and these double with every round of
    an iteration; so the rows are put under a fresh plan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    session = df.sparkSession
    fresh = session._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False)
    out = DataFrame(fresh, session)
    out._kept = kept  # the files live as long as this frame
    return out


def held(df: DataFrame) -> DataFrame:
    """The same rows on what their last shuffle wrote: later reads start there, and a lost executor's share is made again from its lineage."""
    session = df.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), session)


def swept(spark: SparkSession) -> None:
    """Have Spark delete the files of frames that are gone; its cleaner waits for the driver's garbage collection, which a driver with little to do puts off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
