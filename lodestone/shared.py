"""Tables whose lineage is cut in the folder that all executors share; jobs that run side by side."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one where none is set and this machine is all there is."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if context.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by checkpoint() into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def together(spark: SparkSession, steps: dict[str, tuple[Sequence[str], Callable]], at_once: int = 8) -> dict[str, object]:
    """Results by name of steps {name: (steps before it, step)} that run side by side, at_once at a time.

    A step gets the results of those before it, which are listed earlier. If one fails those after it don't run; the
    others end first, then its error is raised. Jobs carry the caller's job group and tags.
    """
    done: dict[str, Future] = {}

    def run(before: Sequence[str], step: Callable) -> object:
        return step(*(done[b].result() for b in before))

    with ThreadPoolExecutor(at_once) as pool:
        for name, (before, step) in steps.items():
            done[name] = pool.submit(inheritable_thread_target(spark)(run), before, step)  # local properties of its own
    return {name: f.result() for name, f in done.items()}
