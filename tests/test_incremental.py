"""Kept sums equal the full query after appends, a rewrite and a removal, and only changed files are read."""

import os

import pytest
from pyspark.sql import functions as F

from freightlens.operators import aggregates as A
from freightlens.plans.incremental import MonthlySums
from freightlens.sources.model import Freight


@pytest.fixture()
def lines(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def full(spark, folder):
    m = Freight(spark, str(folder))
    return sorted(map(tuple, A.flow_timeseries(m).collect()))


def kept(sums):
    return sorted(map(tuple, sums.series().collect()))


def test_only_changed_files_are_read(spark, lines, tmp_path):
    source = tmp_path / "data/lineitem.parquet"
    sums = MonthlySums(spark, str(source), str(tmp_path / "kept"))
    part = lambda i: lines.where(F.col("l_orderkey") % 5 == i)
    part(0).repartition(3).write.parquet(str(source))
    assert sums.refresh() == 3 and kept(sums) == full(spark, tmp_path / "data")
    assert sums.refresh() == 0 and kept(sums) == full(spark, tmp_path / "data")
    part(1).coalesce(1).write.mode("append").parquet(str(source))
    assert sums.refresh() == 1 and kept(sums) == full(spark, tmp_path / "data")
    files = sorted(f for f in os.listdir(source) if f.endswith(".parquet"))
    part(2).coalesce(1).write.parquet(str(tmp_path / "other"))
    (new,) = [f for f in os.listdir(tmp_path / "other") if f.endswith(".parquet")]
    os.replace(tmp_path / "other" / new, source / files[0])  # a rewrite in place
    for f in os.listdir(source):
        if f.endswith(".crc"):
            os.remove(source / f)
    os.remove(source / files[1])  # and a removal
    spark.catalog.refreshByPath(str(source))
    assert sums.refresh() == 1 and kept(sums) == full(spark, tmp_path / "data")
    assert spark.read.parquet(str(tmp_path / "kept/sums")).select("version").distinct().count() == 5


def test_refresh_cut_short(spark, lines, tmp_path):
    """Sums that were written without a manifest are counted once."""
    source = tmp_path / "data/lineitem.parquet"
    lines.coalesce(1).write.parquet(str(source))
    sums = MonthlySums(spark, str(source), str(tmp_path / "kept"))
    sums.refresh()
    os.remove(tmp_path / "kept/manifest=1/_SUCCESS")
    assert sums.refresh() == 1 and kept(sums) == full(spark, tmp_path / "data")
