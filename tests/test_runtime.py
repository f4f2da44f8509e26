"""Where intermediate tables lie, and when they go."""

import gc
import os
import time
from types import SimpleNamespace

import pytest
from strandmill.plans import runtime
from strandmill.streaming import reads as streams


def test_a_cluster_needs_a_shared_folder():
    session = lambda master, found: SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=lambda k, d: found))
    for master in ("yarn", "spark://x:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            runtime.shared_dir(session(master, None))
        assert runtime.shared_dir(session(master, "hdfs:///x/")) == "hdfs:///x"
    assert runtime.shared_dir(session("local[4]", None)) == runtime.LOCAL_CHECKPOINT_DIR


def kept():
    return {p: os.path.isdir(p) for p in runtime._kept}


def test_kept_tables_go_with_the_block(spark, tmp_path):
    spark.range(3).withColumnRenamed("id", "n").write.parquet(str(tmp_path / "in"))
    before = set(runtime._kept)
    with runtime.scratch():
        one = runtime.keep(spark.range(5), "one")
        two = streams.collected(spark.readStream.schema("n long").parquet(str(tmp_path / "in")))
        made = set(runtime._kept) - before
        assert one.count() == 5 and two.count() == 3 and len(made) == 2 and all(kept()[p] for p in made)
    assert not made & set(runtime._kept) and not any(os.path.exists(p) for p in made)


def test_kept_tables_go_with_their_last_reader(spark):
    path = lambda: set(runtime._kept)
    before = path()
    derived = runtime.keep(spark.range(5), "held").where("id > 1")
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    held = path() - before
    runtime.sweep()
    assert held <= path() and derived.count() == 3
    del derived
    for _ in range(40):
        gc.collect()
        spark.range(1).collect()
        spark.sparkContext._jvm.System.gc()
        runtime.sweep()
        if not held & path():
            break
        time.sleep(0.25)
    assert not held & path() and not any(os.path.exists(p) for p in held)
