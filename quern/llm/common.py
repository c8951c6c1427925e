"""Shared helpers of the operators: Arrow maps over slices, worker state, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import graph
from quern.shared import drop_scratch, scratch, shared_dir


__all__ = ["arrow_map", "components", "drop_scratch", "limit_batches", "merge_splits", "release_state", "scratch", "shared_dir", "worker_state"]

#: Rows of an Arrow batch in jobs over whole texts.
BATCH_ROWS = 1000


def limit_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's rows per Arrow batch to ``rows`` if they are more (the default is 10,000).

    Rows here hold whole texts, and both the executor's JVM and its Python worker hold a batch at once. The setting stays:
    results are lazy, so their jobs run after the operator has returned.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


#: Input bytes that a task over texts should have at least, where that leaves a task for every core.
TASK_BYTES = 64 << 20


def merge_splits(df: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Merge scan splits that are much smaller than ``task_bytes``, without a shuffle and never below one task per core.

    Fewer tasks load fewer models and write fewer small files, each of which costs a round of calls to the file system.
    Splits of the usual 128 MB are left alone.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # Where the planner knows no size it says a very large one: then nothing is merged.
    return df.coalesce(min(1 << 30, max(df.sparkSession.sparkContext.defaultParallelism, -(-size // task_bytes))))


_STATES: dict = {}


def worker_state(broadcast, make: Callable):
    """One object per broadcast and Python worker, kept between the tasks of one job; a worker holds one at a time."""
    key = (broadcast.value[0], make.__qualname__)
    if key not in _STATES:
        _STATES.clear()
        _STATES[key] = make(*broadcast.value[1:])
    return _STATES[key]


def release_state() -> None:
    """Workers serve job after job: a task without a state of its own frees that of an earlier job."""
    _STATES.clear()


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema, rows: int = 2000, stateful: bool = False) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows, so that working memory does not follow the batch size.

    ``stateful``: the function uses ``worker_state``.
    """
    limit_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not stateful:
            release_state()
        for b in batches:
            for i in range(0, b.num_rows, rows):
                yield fn(b.slice(i, rows))

    return merge_splits(df).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph (``a``, ``b``): node, root (the smallest node), by the engine's rounds.

    Any order, repeats and self-loops are allowed; nodes without an edge to another are not in the result, so an empty edge
    table gives an empty one. No group is collected, and one small table is written per round.
    """
    return graph.components(edges.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"))).toDF("node", "root")
