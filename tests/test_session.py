import os
import subprocess
import sys
import threading
import time
from pathlib import Path

import pytest

from pyspark.sql import DataFrameWriter, functions as F

from cohortflow.session import RELEASE, Scope, drop_table, shared, written

CLUSTER = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from cohortflow.operators.joins import crowded_keys, join_per_key
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "600m").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {folder!r}).config("spark.sql.shuffle.partitions", "4").getOrCreate())
rows, keys = spark.range(30).select((F.col("id") % 3).alias("k"), "id"), spark.range(2).select(F.col("id").alias("k"))
print("rows", join_per_key(rows, keys, "k", crowded=crowded_keys(rows, "k", 5), rows=5).count())
"""


def test_scopes_keep_and_remove(spark):
    """Tables of a scope go at its end, kept ones and those of other scopes and threads stay."""
    outside = written(spark.range(3), "t")
    with Scope(spark) as outer:
        first = written(spark.range(4), "t")
        with Scope(spark) as inner:
            gone = written(spark.range(5), "t")
            kept = inner.keep(gone.filter("id > 1"), "t")
            other = []
            thread = threading.Thread(target=lambda: other.append(written(spark.range(6), "t")))
            thread.start()
            thread.join()
        assert first.count() == 4 and kept.count() == 3
        with pytest.raises(Exception):
            gone.count()
        last = outer.keep(kept)
    assert (outside.count(), other[0].count(), last.count()) == (3, 6, 3)
    with pytest.raises(Exception):
        kept.count()


def test_writes_leave_no_shuffle_files(spark):
    def files():
        folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in folder for f in Path(d).rglob("shuffle_*.data")}

    before, had = spark.conf.get(RELEASE, None), files()
    counts = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    table, other = written(counts, "counts"), written(counts, "counts")
    for _ in range(50):  # they are removed in the background
        if files() <= had:
            break
        time.sleep(0.1)
    assert files() <= had
    assert table.count() == other.count() == counts.count() == 10
    assert spark.conf.get(RELEASE, None) == before
    drop_table(table)
    assert other.count() == 10 and written(counts, "counts").count() == 10


def test_cluster_with_a_path_without_scheme(tmp_path):
    """A plain path on a disk that all executors share serves a cluster."""
    folder = tmp_path / "shared"
    code = CLUSTER.format(root=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), folder=str(folder))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "rows 20" in done.stdout
    assert [p.name.startswith("tried") for p in (folder / "cohortflow").iterdir()] == [False]


def test_folders_that_executors_do_not_share(spark, tmp_path, monkeypatch):
    assert shared(spark, str(tmp_path))
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: os.makedirs(path))  # the files are on other machines
    assert not shared(spark, str(tmp_path))
    assert not list((tmp_path / "cohortflow").iterdir())
