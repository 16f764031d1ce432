"""Live state as a keyed table: folded batch by batch, small, and left by what has ended.

A fold is a list of attributes that combine: the value with the largest sequence number, a largest
value, a count, whether something happened. A batch is first folded by itself, where rows combine
before they are shuffled, so one run with most of the events is no bottleneck; its few rows are
then combined with the state. The table is written anew under the number of the batch and counts
once it is whole; a batch that is run again starts from the version before and gives the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..session import stage
from .jobs import STATUS_SECONDS, start, urgent

OWNER = "run_id"
VERSIONS_KEPT = 3
_BOOKKEEPING = ("seen_us", "ended", "urgent")


@dataclass(frozen=True)
class Attribute:
    """``kind`` is ``last`` (the value of the event with the largest seq), ``max``, ``count`` or ``any``."""

    name: str
    kind: str
    when: Column
    value: Column | None = None


@dataclass(frozen=True)
class Fold:
    """What is kept per key; the first key is the run, whose end takes all its rows out of the state."""

    keys: tuple[str, ...]
    attributes: tuple[Attribute, ...]
    events: Callable[[DataFrame], DataFrame] = lambda events: events

    def parts(self, events: DataFrame) -> DataFrame:
        """A batch folded by itself, and one row per run with when it was seen and whether it ended."""
        made = {
            "last": lambda a: F.max(F.when(a.when, F.struct(F.col("seq").alias("at"), a.value.alias("value")))),
            "max": lambda a: F.max(F.when(a.when, a.value)),
            "count": lambda a: F.count_if(a.when),
            "any": lambda a: F.bool_or(a.when),
        }
        rows = self.events(events).groupBy(*self.keys).agg(*[made[a.kind](a).alias(a.name) for a in self.attributes])
        runs = events.groupBy(OWNER).agg(
            F.max(F.unix_micros("ts")).alias("seen_us"),
            F.bool_or(F.col("type") == "run.finished").alias("ended"),
            F.bool_or(urgent(F.col("type"))).alias("urgent"),
        )
        if self.keys == (OWNER,):
            return rows.join(runs, OWNER)
        return rows.unionByName(runs, allowMissingColumns=True)

    def combine(self, parts: DataFrame) -> DataFrame:
        made = {"last": F.max, "max": F.max, "count": F.sum, "any": F.bool_or}
        return parts.groupBy(*self.keys).agg(
            *[made[a.kind](a.name).alias(a.name) for a in self.attributes],
            F.max("seen_us").alias("seen_us"), F.bool_or("ended").alias("ended"), F.bool_or("urgent").alias("urgent"),
        )

    def values(self, parts: DataFrame) -> DataFrame:
        """The rows as a user reads them."""
        for key in self.keys[1:]:
            parts = parts.where(F.col(key).isNotNull())
        plain = [F.col(f"{a.name}.value").alias(a.name) if a.kind == "last" else F.col(a.name) for a in self.attributes]
        return parts.select(*self.keys, *plain)


class StateTable:
    """The state of a fold in a folder: ``live/v=<batch>`` and, of runs that have left, ``ended/batch=<batch>``.

    A finished run leaves ``keep_seconds`` after it was last seen, any other after
    ``forget_seconds``; time is that of the newest event. Each row carries the status last shown:
    ``snapshot`` is renewed by an urgent event of its run, else at most every ``status_seconds``.
    """

    def __init__(
        self, path: str, fold: Fold, *, keep_seconds: float = 3600, forget_seconds: float = 7 * 86_400, status_seconds: float = STATUS_SECONDS
    ) -> None:
        self.path, self.fold = path, fold
        self.keep_us, self.forget_us, self.status_us = (int(s * 1_000_000) for s in (keep_seconds, forget_seconds, status_seconds))

    def _versions(self, spark: SparkSession) -> list[int]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/live")
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not store.exists(path):
            return []
        found = [s.getPath() for s in store.listStatus(path)]
        whole = [p for p in found if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in whole)

    def _read(self, spark: SparkSession, version: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/live/v={version}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """The sink of a stream."""
        spark, fold = batch.sparkSession, self.fold
        before = [v for v in self._versions(spark) if v < batch_id]
        parts = stage(fold.parts(batch))
        fresh = parts.select(OWNER, "urgent", F.col("seen_us").alias("now_us")).where("seen_us is not null")
        old = self._read(spark, before[-1]) if before else None
        if old is not None:
            known = [*fold.keys, *[a.name for a in fold.attributes], "seen_us", "ended"]
            parts = parts.unionByName(old.select(*known, F.lit(False).alias("urgent")))
        merged = fold.combine(parts)
        if old is not None:
            merged = merged.join(old.select(*[F.col(k).alias(f"_{k}") for k in fold.keys], "snapshot", "shown_us"), _same(fold.keys), "left")
            merged = merged.drop(*[f"_{k}" for k in fold.keys])
        else:
            merged = merged.withColumns({"snapshot": F.lit(None).cast(_snapshot_type(fold, merged)), "shown_us": F.lit(None).cast("long")})
        runs = merged.groupBy(OWNER).agg(F.max("seen_us").alias("run_us"), F.bool_or("ended").alias("run_ended"))
        newest = parts.agg(F.max("seen_us")).first()[0]
        gone = F.col("run_us") < newest - F.when(F.col("run_ended"), self.keep_us).otherwise(self.forget_us)
        seen = fresh.groupBy(OWNER).agg(F.max("now_us").alias("now_us"), F.bool_or("urgent").alias("now_urgent"))
        judged = merged.join(runs, OWNER).join(seen, OWNER, "left").withColumn("gone", F.coalesce(gone, F.lit(False)))
        show = F.col("now_us").isNotNull() & (F.col("now_urgent") | F.col("shown_us").isNull() | (F.col("now_us") - F.col("shown_us") >= self.status_us))
        values = F.struct(*[a.name for a in fold.attributes])
        shown = judged.withColumns(
            {"snapshot": F.when(show, values).otherwise(F.col("snapshot")), "shown_us": F.when(show, F.col("now_us")).otherwise(F.col("shown_us"))}
        ).drop("run_us", "run_ended", "now_us", "now_urgent", "urgent")
        kept = stage(shown)
        kept.where("gone").drop("gone").write.mode("overwrite").parquet(f"{self.path}/ended/batch={batch_id}")
        kept.where("not gone").drop("gone").write.mode("overwrite").parquet(f"{self.path}/live/v={batch_id}")
        for version in before[: -(VERSIONS_KEPT - 1)]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/live/v={version}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def live(self, spark: SparkSession) -> DataFrame:
        """The state of the runs that have not left."""
        return self.fold.values(self._rows(spark))

    def status(self, spark: SparkSession) -> DataFrame:
        """The status as last shown, with the time of the event that showed it."""
        rows = self._rows(spark)
        shown = rows.where("snapshot is not null").select(*self.fold.keys, "snapshot.*", "shown_us")
        return self.fold.values(shown).join(shown.select(*self.fold.keys, F.timestamp_micros("shown_us").alias("shown_at")), list(self.fold.keys))

    def everything(self, spark: SparkSession) -> DataFrame:
        """Live runs and those that have left; one that came back counts as it is now."""
        rows = self._rows(spark)
        ended = spark.read.option("basePath", f"{self.path}/ended").parquet(f"{self.path}/ended/batch=*")
        plain = [*self.fold.keys, *[a.name for a in self.fold.attributes], "seen_us", "ended"]
        parts = rows.select(*plain).unionByName(ended.select(*plain)).withColumn("urgent", F.lit(False))
        return self.fold.values(self.fold.combine(parts))

    def _rows(self, spark: SparkSession) -> DataFrame:
        versions = self._versions(spark)
        if not versions:
            raise FileNotFoundError(f"no state in {self.path} yet")
        return self._read(spark, versions[-1])

    def run(self, stream: DataFrame, *, every: str | None = None, checkpoint: str | None = None) -> StreamingQuery:
        return start(stream, self, every=every, checkpoint=checkpoint)


def _same(keys: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for key in keys:
        out = out & F.col(key).eqNullSafe(F.col(f"_{key}"))
    return out


def _snapshot_type(fold: Fold, merged: DataFrame) -> str:
    fields = [f"{a.name}:{merged.schema[a.name].dataType.simpleString()}" for a in fold.attributes]
    return f"struct<{','.join(fields)}>"
