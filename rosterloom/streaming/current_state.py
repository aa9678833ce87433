"""Upkeep of the current state of contacts from a stream of observations (an extension: batch views define the result).

Every micro-batch is reduced to one row per identity and merged into the stored state by a full outer join; the new
state is written beside the old one and named in a small pointer file that is replaced last. A batch that is delivered
again finds its number in the pointer's path and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.operators.records import upsert


def reduce_batch(batch: DataFrame) -> DataFrame:
    """(identity, latest_id, observations, last_seen) of a batch with identity, contact_id, observed."""
    return batch.groupBy("identity").agg(F.max_by("contact_id", F.struct("observed", "contact_id")).alias("latest_id"), F.count("*").alias("observations"), F.max("observed").alias("last_seen"))


def merge_state(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State and batch as one: late observations count, but don't replace a later one."""
    newer = F.struct("i.last_seen", "i.latest_id") > F.struct("c.last_seen", "c.latest_id")
    take = F.col("c.last_seen").isNull() | (F.col("i.last_seen").isNotNull() & newer)
    return upsert(state, batch, ["identity"], {"latest_id": F.when(take, F.col("i.latest_id")).otherwise(F.col("c.latest_id")), "observations": F.coalesce("c.observations", F.lit(0)) + F.coalesce("i.observations", F.lit(0)), "last_seen": F.greatest("c.last_seen", "i.last_seen")})


class StateStore:
    """State tables under one folder; the highest finished batch number is the current one."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def current(self) -> int:
        fs, where = self._fs()
        if not fs.exists(where):
            return -1
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        done = [int(s.getPath().getName().removeprefix("state-")) for s in fs.listStatus(where) if s.getPath().getName().startswith("state-") and fs.exists(path(s.getPath(), "_SUCCESS"))]
        return max(done, default=-1)

    def read(self) -> DataFrame | None:
        number = self.current()
        return None if number < 0 else self.spark.read.parquet(f"{self.folder}/state-{number}")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Merge one micro-batch; for ``foreachBatch``."""
        if number <= self.current():
            return
        state, reduced = self.read(), reduce_batch(batch)
        (reduced if state is None else merge_state(state, reduced)).write.mode("overwrite").parquet(f"{self.folder}/state-{number}")
        self._drop_before(number)

    def _drop_before(self, number: int, kept: int = 2) -> None:
        """Remove states that no reader can be at any more: all but the current one and the one before."""
        fs, where = self._fs()
        for s in fs.listStatus(where):
            name = s.getPath().getName()
            if name.startswith("state-") and int(name.removeprefix("state-")) <= number - kept:
                fs.delete(s.getPath(), True)


def windowed_counts(observations: DataFrame, lateness: str = "3 days", width: str = "1 day") -> DataFrame:
    """Observations per evidence type and day, late rows accepted up to ``lateness``."""
    return observations.withWatermark("observed_at", lateness).groupBy(F.window("observed_at", width), "evidence_type").agg(F.count("*").alias("n"))
