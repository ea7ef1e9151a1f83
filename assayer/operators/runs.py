"""Logs of steps and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.joins import zip_by_position
from assayer.session import checkpointed


def sections(tables: dict[str, DataFrame]) -> DataFrame:
    """Several step tables as one, each with the name of its section."""
    parts = [t.select(F.lit(n).alias("section"), "step", "exit_code", "log") for n, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def last_success(runs: DataFrame, key: str, when: str, passed: str = "passed") -> DataFrame:
    """(key, last_success_at, last_run_at): by aggregation, as only the latest is asked for."""
    return runs.groupBy(key).agg(F.max(F.when(F.col(passed), F.col(when))).alias("last_success_at"), F.max(when).alias("last_run_at"))


def success_so_far(runs: DataFrame, key: str, when: str, tie: str, passed: str = "passed") -> DataFrame:
    """Every run with the time of the last success of its key up to it: a scan in segments, so a key with very many runs is the work of many tasks.

    Runs are range-partitioned by key and time and scanned in each part; what a part of a key ends with is carried over to its next parts, of which there is one row each.
    """
    ranged = checkpointed(runs.repartitionByRange(key, when, tie).withColumn("__part", F.spark_partition_id()))
    success = F.when(F.col(passed), F.col(when))
    inside = Window.partitionBy(key, "__part").orderBy(when, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = ranged.withColumn("__inside", F.last(success, ignorenulls=True).over(inside))
    ends = ranged.groupBy(key, "__part").agg(F.max(success).alias("__end"))  # runs are in order of time, so the last success is the greatest
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(key).alias("__key"), F.col("__part").alias("__at"), F.last("__end", ignorenulls=True).over(before).alias("__carried"))
    joined = scanned.join(carried.filter("__carried is not null"), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__at")), "left")
    return joined.withColumn("last_success_at", F.coalesce("__inside", "__carried")).drop("__part", "__inside", "__key", "__at", "__carried")


def test_progress(collected: DataFrame, reported: DataFrame) -> DataFrame:
    """Collected tests (pos, node) with the status of the case at the same place in the report (pos, status), or not_run."""
    return zip_by_position(collected, reported.select("pos", "status"), "not_run", "status")
