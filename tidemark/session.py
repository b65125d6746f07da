"""Session and storage helpers shared by every module."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tidemark")
    for key, value in (BASE_CONF | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": "8g"} | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables; columns and filters are pruned by Catalyst at the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a new temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    if (scope := _scope.get()) is not None:
        scope.frames.append(out)
    return out


class Scratch:
    """The tables that stored() wrote in a scope."""

    def __init__(self, outer: Scratch | None) -> None:
        self.outer, self.frames = outer, []

    def keep(self, df: DataFrame) -> DataFrame:
        """A frame of stored(), which outlives the scope: it belongs to the scope around it from now on."""
        self.frames = [f for f in self.frames if f is not df]
        if self.outer is not None:
            self.outer.frames.append(df)
        return df


_scope: contextvars.ContextVar[Scratch | None] = contextvars.ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch() -> Iterator[Scratch]:
    """What stored() writes within is deleted at the end, except for frames given to keep().

    Around an operator and the write of its result, it leaves nothing behind but the result.
    """
    scope = Scratch(_scope.get())
    token = _scope.set(scope)
    try:
        yield scope
    finally:
        _scope.reset(token)
        for df in scope.frames:
            discard(df)


def discard(df: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    path = getattr(df, "_stored_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def few(df: DataFrame, at_most: int = 50_000) -> DataFrame:
    """The frame with a broadcast hint if it has few rows, counted here; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.limit(at_most + 1).count() <= at_most else df


def aside(df: DataFrame, names) -> tuple[DataFrame, dict[str, str]]:
    """The frame with columns of these names renamed out of the way, and the renaming that brings them back."""
    moved = {c: f"_aside_{c}" for c in df.columns if c in set(names)}
    return df.withColumnsRenamed(moved), {v: k for k, v in moved.items()}
