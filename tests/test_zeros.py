"""No query stops at zero quantities, zero prices or a total loss."""

import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cross_section as xs
from tidemark.plans import desk, market, memory, pit, prices, tools

SF = "/root/testdata/sf0.001"
NAMES = {k: f for m in (market, pit, prices, tools, desk, memory) for k, f in m.QUERIES.items()}


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("zeros"))
    for t in "region nation customer supplier part orders events documents embeddings labels".split():
        (shutil.copytree if (p := __import__("pathlib").Path(f"{SF}/{t}.parquet")).is_dir() else shutil.copy)(p, f"{out}/{t}.parquet")
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    none = (F.col("l_suppkey") == 1) | (F.col("l_orderkey") % 5 == 0)
    worthless = (F.col("l_suppkey") == 2) | (F.col("l_orderkey") % 7 == 0)
    li.withColumn("l_quantity", F.when(none, 0.0).otherwise(F.col("l_quantity"))).withColumn("l_extendedprice", F.when(worthless, 0.0).otherwise(F.col("l_extendedprice"))).write.parquet(f"{out}/lineitem.parquet")
    o = spark.read.parquet(f"{SF}/orders.parquet")
    o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, 0.0).otherwise(F.col("o_totalprice"))).write.mode("overwrite").parquet(f"{out}/orders-new")
    shutil.rmtree(f"{out}/orders.parquet", ignore_errors=True) or __import__("pathlib").Path(f"{out}/orders.parquet").unlink(missing_ok=True)
    shutil.move(f"{out}/orders-new", f"{out}/orders.parquet")
    return out


@pytest.mark.parametrize("name", sorted(NAMES))
def test_query_runs_on_zeros(spark, zeros, name):
    NAMES[name](spark, zeros).write.format("noop").mode("overwrite").save()


def test_turnover_after_a_total_loss(spark):
    w = spark.createDataFrame([(1, 1, 1.0, -1.0), (2, 1, 0.5, 0.1), (2, 2, 0.5, 0.0)], "at long, code long, w double, r double")
    assert [(r.at, r.turnover) for r in xs.drift_turnover(w).collect()] == [(2, 1.0)]
