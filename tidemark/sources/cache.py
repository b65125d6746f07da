"""A factor cache: rows keyed by factor, date and code, each with the snapshot it was computed from."""

from __future__ import annotations

import functools
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import clean
from ..session import few, scratch, stored
from .versions import Versions


def days_missing(wanted: DataFrame, cache: DataFrame, valid: DataFrame) -> DataFrame:
    """(factor, d) of wanted that no valid snapshot in the cache covers: what an incremental build computes."""
    done = cache.join(valid, "snapshot", "left_semi").select("factor", "d").distinct()
    return wanted.select("factor", "d").distinct().join(done, ["factor", "d"], "left_anti")


def hits(cache: DataFrame, valid: DataFrame, universe: DataFrame) -> DataFrame:
    """Per (factor, d) of the cache: n, and hit: every row is of a valid snapshot and the codes are exactly the date's universe."""
    ok = valid.select("snapshot", F.lit(True).alias("_ok"))
    have = cache.join(ok, "snapshot", "left").select("factor", "d", "code", F.coalesce("_ok", F.lit(False)).alias("_ok"))
    want = cache.select("factor", "d").distinct().join(universe.select("d", "code"), "d").withColumn("_want", F.lit(True))
    both = have.withColumn("_have", F.lit(True)).join(want, ["factor", "d", "code"], "full")
    good = F.coalesce(F.col("_have") & F.col("_want") & F.col("_ok"), F.lit(False))
    return both.groupBy("factor", "d").agg(F.count("_have").alias("n"), F.bool_and(good).alias("hit"))


class FactorCache:
    """Factor values under root in immutable writes, and manifests that say which days are read from which write.

    A write lays its rows down once, by factor and month, in a folder of its own; a manifest is a new version of a small table
    (factor, d, snapshot, n, write: a row per factor, day and snapshot), published by the ledger of Versions.  So a reader holds
    the manifest that it began with and sees the cache as it was then; a writer that is killed leaves a folder that nothing
    names; days are never rewritten with others.  What to compute is found in the manifest alone.  One writer at a time.  prune() deletes what no
    manifest of the grace time names.
    """

    SCHEMA = "code long, d date, value double, snapshot string, write string, factor string, month string"
    MANIFEST = "factor string, d date, snapshot string, n long, write string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, f"{self.root}/manifests")

    def manifest(self, version: str | None = None) -> DataFrame:
        """The newest manifest, or that of a version."""
        version = version or self.versions.current()
        return self.versions.read(version) if version else self.spark.createDataFrame([], self.MANIFEST)

    def read(self, factors: list[str] | None = None, since: str | None = None, until: str | None = None, version: str | None = None) -> DataFrame:
        """factor, d, code, value, snapshot; of these factors, from one date to another (both included); of the newest manifest or that of a version.

        The manifest is looked up now: writes after this call change nothing in the frame.
        """
        days = self.manifest(version)
        if factors is not None:
            days = days.where(F.col("factor").isin(factors))
        if since is not None:
            days = days.where(F.col("d") >= F.lit(since).cast("date"))
        if until is not None:
            days = days.where(F.col("d") <= F.lit(until).cast("date"))
        writes = [r.write for r in days.select("write").distinct().collect()]  # folders, one for each write that is still read
        if not writes:
            return self.spark.createDataFrame([], self.SCHEMA).select("factor", "d", "code", "value", "snapshot")
        df = self.spark.read.schema(self.SCHEMA).option("basePath", f"{self.root}/rows").parquet(*[f"{self.root}/rows/write={w}" for w in writes])
        if factors is not None:
            df = df.where(F.col("factor").isin(factors))
        if since is not None:
            df = df.where(F.col("month") >= since[:7])
        if until is not None:
            df = df.where(F.col("month") <= until[:7])
        named = few(days.select("write", "factor", "d", F.col("snapshot").alias("_s")), 500_000)  # factors times days
        keys = [df[c] == named[c] for c in ("write", "factor", "d")] + [df["snapshot"].eqNullSafe(named["_s"])]
        return df.join(named, functools.reduce(lambda x, y: x & y, keys), "left_semi").select("factor", "d", "code", "value", "snapshot")

    def put(self, rows: DataFrame) -> str:
        """Rows (factor, d, code, value, snapshot) in place of all that is stored of their days; what is not a number is null.  The new manifest's version."""
        write = uuid.uuid4().hex[:12]
        path = f"{self.root}/rows/write={write}"
        new = rows.select("code", "d", clean(F.col("value").cast("double")).alias("value"), "snapshot", "factor", F.date_format("d", "yyyy-MM").alias("month"))
        new.repartition("factor", "month").write.partitionBy("factor", "month").parquet(path)
        kind = ", ".join(x for x in self.SCHEMA.split(", ") if not x.startswith("write"))
        told = self.spark.read.schema(kind).parquet(path).groupBy("factor", "d", "snapshot").agg(F.count("*").alias("n")).withColumn("write", F.lit(write))
        with scratch():
            told = stored(told, "cache-days")
            old = self.manifest().join(few(told.select("factor", "d").distinct(), 500_000), ["factor", "d"], "left_anti")
            return self.versions.publish(old.unionByName(told).coalesce(1))

    def build(self, wanted: DataFrame, valid: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> int:
        """Compute only the days of wanted (factor, d) that no valid snapshot covers; how many these were."""
        with scratch():
            missing = stored(days_missing(wanted, self.manifest(), valid), "cache-missing")
            n = missing.count()
            if n:
                self.put(compute(missing))
            return n

    def drop_orphans(self, valid: DataFrame) -> str:
        """Rows of snapshots that are no longer valid are no longer read; nothing is rewritten."""
        return self.versions.publish(self.manifest().join(few(valid.select("snapshot")), "snapshot", "left_semi").select("factor", "d", "snapshot", "n", "write").coalesce(1))

    def prune(self, grace_seconds: float = 86_400.0) -> int:
        """Delete manifests that the newest has replaced for longer than the grace time, and writes that no manifest left names; how many writes."""
        self.versions.prune(1, grace_seconds)
        named = {r.write for v in self.versions.kept() for r in self.manifest(v).select("write").distinct().collect()}
        rows = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/rows")
        fs, gone = rows.getFileSystem(self.spark._jsc.hadoopConfiguration()), 0
        for found in fs.listStatus(rows) if fs.exists(rows) else []:
            name = found.getPath().getName().removeprefix("write=")
            if name not in named and found.getModificationTime() / 1000 <= time.time() - grace_seconds:  # a write that is going on is younger
                fs.delete(found.getPath(), True)
                gone += 1
        return gone
