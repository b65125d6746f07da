"""Versioned datasets: a publication is a new immutable folder and one small pointer file, so readers never see half of it.

Pointer files are numbered and made only if absent, so that of two publishers with one number one takes the next.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fingerprint(df: DataFrame, time: str | None = None) -> str:
    """16 hex digits of the rows' content in any order: count, greatest time, and an order-free hash."""
    parts = [F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0))]
    if time:
        parts.append(F.max(time))
    return df.agg(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 16).alias("f")).first().f


class Versions:
    """A dataset's publications under root, in a ledger of (version, number, published, min_affected)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    LEDGER = "number long, version string, min_affected string, published timestamp"

    def _log(self) -> DataFrame | None:
        fs, path = self._path("ledger")
        return self.spark.read.schema(self.LEDGER).json(str(path)) if fs.exists(path) else None

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _append(self, version: str, affected: str | None) -> int:
        log = self._log()
        number = 1 + ((log.agg(F.max("number")).first()[0] or 0) if log is not None else 0)
        while True:
            fs, path = self._path(f"ledger/{number:020d}.json")
            try:
                out = self._created(fs, path)
            except Py4JJavaError as e:
                if "AlreadyExists" not in str(e.java_exception):
                    raise
                number += 1
                continue
            row = {"number": number, "version": version, "min_affected": affected, "published": datetime.now(UTC).isoformat()}
            out.write(bytearray(json.dumps(row).encode()))
            out.close()
            return number

    def _created(self, fs, path):
        """A stream to a new file; an error if there is one of that name.  The local file system's own create() is not exclusive, the operating system's is."""
        if fs.getUri().getScheme() != "file":
            return fs.create(path, False)
        fs.mkdirs(path.getParent())
        local = self.spark._jvm.java.io.File(path.toUri().getPath()).toPath()
        self.spark._jvm.java.nio.file.Files.createFile(local, self.spark._sc._gateway.new_array(self.spark._jvm.java.nio.file.attribute.FileAttribute, 0))
        return fs.create(path, True)

    def current(self) -> str | None:
        """The version last pointed to; the ledger's append is what publishes."""
        log = self._log()
        return log.orderBy(F.col("number").desc()).select("version").first()[0] if log is not None else None

    def publish(self, df: DataFrame, partition_by: tuple[str, ...] = (), affected: str | None = None) -> str:
        version = f"v-{uuid.uuid4().hex[:12]}"
        df.write.partitionBy(*partition_by).parquet(f"{self.root}/{version}") if partition_by else df.write.parquet(f"{self.root}/{version}")
        self._append(version, affected)
        return version

    def exists(self, version: str) -> bool:
        fs, path = self._path(version)
        return fs.exists(path)

    def rollback(self, version: str) -> None:
        """Point to an earlier publication again; nothing is rewritten.  A version that was never published, or has been pruned, is an error."""
        log = self._log()
        if log is None or not log.where(F.col("version") == version).limit(1).count() or not self.exists(version):
            raise ValueError(f"no version {version}")
        self._append(version, None)

    def kept(self) -> list[str]:
        """Versions whose data are there, the newest publication first."""
        log = self._log()
        last = log.groupBy("version").agg(F.max("number").alias("n")).orderBy(F.col("n").desc()).select("version").collect() if log is not None else []
        return [r.version for r in last if self.exists(r.version)]

    def prune(self, keep: int = 5, grace_seconds: float = 86_400.0) -> list[str]:
        """Delete the data of all but the `keep` versions published last; the versions deleted.

        The current one always stays, and so does one that was current within the grace time, as readers may still hold it.
        The ledger stays whole: it says when the deleted ones were current.
        """
        log = self._log()
        if log is None:
            return []
        until = F.lead("published").over(Window.partitionBy(F.lit(0)).orderBy("number"))  # a row per publication
        last = log.withColumn("until", until).groupBy("version").agg(F.max("number").alias("n"), F.max(F.coalesce("until", F.lit("9999-12-31").cast("timestamp"))).alias("until"))
        limit = datetime.now(UTC).timestamp() - grace_seconds
        old = [r.version for r in last.select("version", "n", F.unix_micros("until").alias("until")).orderBy(F.col("n").desc()).collect()[max(keep, 1) :] if r.until / 1e6 <= limit]
        gone = [v for v in old if self.exists(v)]
        for v in gone:
            fs, path = self._path(v)
            fs.delete(path, True)
        return gone

    def read(self, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{version or self.current()}")

    def changed(self, a: str, b: str) -> DataFrame:
        """Rows in one version only, with the side."""
        x, y = self.read(a), self.read(b)
        return x.exceptAll(y).withColumn("side", F.lit("a")).unionAll(y.exceptAll(x).withColumn("side", F.lit("b")))


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given order, which must decide ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with its keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def audited(stored: DataFrame, fresh: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Keys whose stored value differs from a recomputed one, or that only one side has."""
    j = stored.select(*keys, F.col(value).alias("_a")).join(fresh.select(*keys, F.col(value).alias("_b")), keys, "full")
    same = F.col("_a").eqNullSafe(F.col("_b")) | F.coalesce(F.abs(F.col("_a") - F.col("_b")) <= tolerance, F.lit(False))
    return j.where(~same).select(*keys, F.col("_a").alias("stored"), F.col("_b").alias("fresh"))
