"""Per-key work with even tasks where a few keys hold most rows.

Fragment-replicate by estimated load. Two small scans estimate the load: rows by hash bin, then,
within bins that are too full, rows by key. Keys over a task's fair share are split into shards in
proportion to their load; shards and bins are packed onto tasks, largest first onto the emptiest
task. Rows go straight to their task's partition. Where another side is matched, its rows go only
to the tasks that hold a shard of their key.

What the driver holds is bounded by the number of tasks: ``BINS_PER_TASK`` bins a task, and the keys
over ``1 / SPLIT_AT`` of a fair share, of which there are at most ``SPLIT_AT`` a task.

Defined results
    null keys        a key like any other in aggregates; they match nothing in joins
    repeated rows    all kept; rows equal in ``row_key`` go to the same shard
    empty tables     empty results
    other columns    kept in joins, those of the other side with the suffix _other where names clash;
                     ignored in aggregates
"""

from __future__ import annotations

import heapq
import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS_PER_TASK = 16
SPLIT_AT = 4
ROWS_PER_TASK = 50_000


def tasks_for(spark: SparkSession, rows: float, least_rows: int) -> int:
    """As many tasks as shuffles have partitions, or as ``rows`` are worth, but not under the number of cores."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, max(spark.sparkContext.defaultParallelism, math.ceil(rows / least_rows))))


@dataclass(frozen=True)
class LoadPlan:
    """``bins[b]`` is the task of the keys in hash bin b, ``shards`` the tasks of each heavy key."""

    tasks: int
    bins: tuple[int, ...]
    shards: tuple[tuple[object, tuple[int, ...]], ...]
    loads: tuple[float, ...]
    key_type: T.DataType

    def heavy_table(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType(
            [T.StructField("_hkey", self.key_type), T.StructField("_tasks", T.ArrayType(T.IntegerType()))]
        )
        return spark.createDataFrame([(k, list(t)) for k, t in self.shards], schema)

    def bin_task(self, key: Column) -> Column:
        """The task of a key's bin; the optimizer makes one literal of the list."""
        return F.get(F.from_json(F.lit(json.dumps(self.bins)), "array<int>"), _bin(key, len(self.bins)))


def pack(bin_loads: list[float], key_loads: list[tuple[object, float]], tasks: int, key_type: T.DataType) -> LoadPlan:
    """Bins and the shards of heavy keys on tasks, largest load first onto the emptiest task."""
    fair = (sum(bin_loads) + sum(load for _, load in key_loads)) / tasks
    items: list[tuple[float, str, int]] = [(load, "bin", b) for b, load in enumerate(bin_loads)]
    for i, (_, load) in enumerate(key_loads):
        pieces = max(1, min(tasks, -int(-load // fair))) if fair else 1
        items += [(load / pieces, "key", i)] * pieces
    items.sort(key=lambda x: (-x[0], x[1], x[2]))
    heap = [(0.0, t) for t in range(tasks)]
    bins, shards, loads = [0] * len(bin_loads), [[] for _ in key_loads], [0.0] * tasks
    for load, kind, i in items:
        full, task = heapq.heappop(heap)
        loads[task] = full + load
        heapq.heappush(heap, (loads[task], task))
        if kind == "bin":
            bins[i] = task
        else:
            shards[i].append(task)
    return LoadPlan(
        tasks, tuple(bins), tuple((k, tuple(s)) for (k, _), s in zip(key_loads, shards)), tuple(loads), key_type
    )


def _bin(key: Column, bins: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bins)).cast("int")


def _fresh(base: str, *frames: DataFrame) -> str:
    """``base``, with as many underscores behind it as it takes to be no column of the frames."""
    taken = {c.lower() for df in frames for c in df.columns}
    while base in taken:
        base += "_"
    return base


def plan_load(df: DataFrame, key: str, tasks: int | None = None, weight: Column | None = None) -> LoadPlan:
    """A plan from the rows of ``df`` (or the sum of ``weight``, nulls as 0) for each value of ``key``.

    Without ``tasks``, there are as many as shuffles have partitions; fewer where that leaves them
    under ROWS_PER_TASK rows, but never fewer than cores.
    """
    most = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bins = BINS_PER_TASK * most
    load = F.sum(F.coalesce(weight, F.lit(0)).cast("double")) if weight is not None else F.count(F.lit(1)).cast("double")
    at = _bin(F.col(key), bins)
    bin_loads = [0.0] * bins
    for b, n in df.groupBy(at).agg(load).collect():  # at most ``bins`` rows
        bin_loads[b] = max(n, 0.0)
    if tasks is None:
        tasks = most if weight is not None else tasks_for(df.sparkSession, sum(bin_loads), ROWS_PER_TASK)
    least = sum(bin_loads) / tasks / SPLIT_AT
    full = [b for b, n in enumerate(bin_loads) if n > least]
    heavy = []
    if full:
        by_key = df.where(at.isin(full)).groupBy(at.alias("b"), F.col(key).alias("k")).agg(load.alias("n"))
        for b, k, n in by_key.where(F.col("n") > least).collect():  # at most SPLIT_AT * tasks rows
            heavy.append((k, n))
            bin_loads[b] = max(bin_loads[b] - n, 0.0)
    heavy.sort(key=lambda x: (-x[1], str(x[0])))
    return pack(bin_loads, heavy, tasks, df.schema[key].dataType)


def _placed(df: DataFrame, key: str, plan: LoadPlan, task, name: str) -> DataFrame:
    """``df`` with the column ``name``, ``task`` (tasks of a heavy key or null, task of the bin), in that partition.

    The heavy keys are broadcast; their number is bounded by the plan.
    """
    placed, tasks = df, F.lit(None).cast("array<int>")
    if plan.shards:
        names = [_fresh(c, df) for c in ("_hkey", "_tasks")]
        heavy = plan.heavy_table(df.sparkSession).toDF(*names)
        placed = df.join(F.broadcast(heavy), df[f"`{key}`"].eqNullSafe(heavy[names[0]]), "left")
        tasks = F.col(names[1])
    placed = placed.select(*(f"`{c}`" for c in df.columns), task(tasks, plan.bin_task(F.col(f"`{key}`"))).alias(name))
    return placed.repartitionById(plan.tasks, name)


def to_tasks(df: DataFrame, key: str, row_key: list[str], plan: LoadPlan, name: str = "_task") -> DataFrame:
    """Each row of ``df`` once, in the partition of its task; adds the task as ``name``.

    ``row_key`` should tell rows of one key apart: it decides the shard, the same on every run.
    """

    def task(tasks: Column, of_bin: Column) -> Column:
        shard = F.pmod(F.xxhash64(*row_key), F.size(tasks)) + 1
        return F.coalesce(F.element_at(tasks, shard.cast("int")), of_bin)

    return _placed(df, key, plan, task, name)


def replicate(df: DataFrame, key: str, plan: LoadPlan, name: str = "_task") -> DataFrame:
    """The matching side: each row of a heavy key once for each task that holds a shard of it."""

    def task(tasks: Column, of_bin: Column) -> Column:
        return F.explode(F.coalesce(F.array_distinct(tasks), F.array(of_bin)))

    return _placed(df.where(F.col(f"`{key}`").isNotNull()), key, plan, task, name)


def join_balanced(
    df: DataFrame, other: DataFrame, key: str, row_key: list[str], plan: LoadPlan | None = None, how: str = "inner", most_sent: int = 0
) -> DataFrame:
    """``df`` joined with ``other`` on ``key``; ``how`` is inner, left, left_semi or left_anti.

    No task gets all rows of a heavy key of ``df``, and no row of ``other`` goes where its key is not.
    With ``most_sent``, the rows of ``other``, which should be cheap to count, are counted; up to so many
    go to every task, and those of ``df`` stay where they are.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"how: {how}")
    own = {c.lower() for c in df.columns}
    for c in other.columns:
        if c != key and c.lower() in own:
            other = other.withColumnRenamed(c, _fresh(f"{c.lower()}_other", df, other))
    if most_sent and other.count() <= most_sent:
        joined = df.join(F.broadcast(other), key, how)
    else:
        plan = plan or plan_load(df.select(key), key)
        name = _fresh("_task", df, other)
        left = to_tasks(df, key, row_key, plan, name)
        joined = left.join(replicate(other, key, plan, name), [name, key], how)
    rest = [] if how in ("left_semi", "left_anti") else [c for c in other.columns if c != key]
    return joined.select(*(f"`{c}`" for c in (*df.columns, *rest)))


def aggregate_balanced(
    df: DataFrame, key: str, row_key: list[str], aggregates: dict[str, Column], plan: LoadPlan | None = None
) -> DataFrame:
    """One row for each ``key`` with sums of the expressions ``aggregates``.

    Each task sums its own shards; the shards of a key, at most one row a task, are then summed.
    """
    plan = plan or plan_load(df.select(key), key)
    # the names of the inputs are made here, so they cannot clash with those of ``df``
    inputs = df.select(
        F.col(key).alias("k"),
        *(F.col(c).alias(f"r{i}") for i, c in enumerate(row_key)),
        *(e.alias(f"v{i}") for i, e in enumerate(aggregates.values())),
    )
    shards = to_tasks(inputs, "k", [f"r{i}" for i in range(len(row_key))], plan, "task")
    part = shards.groupBy("task", "k").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(len(aggregates))))
    return part.groupBy(F.col("k").alias(key)).agg(*(F.sum(f"v{i}").alias(name) for i, name in enumerate(aggregates)))
