"""Memory of the Python workers between tasks."""

from __future__ import annotations

import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa

from veilspark.llm import store


def test_a_worker_gives_back_what_a_task_has_freed(spark):
    last = []

    def task(batches):
        for batch in batches:
            parts = [np.ones(12_000) for _ in range(2000)]  # 192 MB, below the size that the allocator maps by itself
            last.append(np.ones(12_000))  # in use above them
            del parts
            yield batch

    class Table:
        sparkSession = spark
        mapInArrow = staticmethod(lambda function, schema: function)

    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024
    before = held()
    batch = pa.record_batch([pa.array([1])], names=["x"])
    assert list(store.map_arrow(Table(), task, "x long")(iter([batch]))) == [batch]
    assert held() - before < 60


def test_a_written_table_leaves_no_shuffle_files(spark):
    files = lambda: {str(p) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for p in Path(d.toString()).rglob("shuffle_*")}
    before, setting = files(), spark.conf.get(store.CLEANUP, None)
    table = store.put(spark.range(10_000).repartition(7, "id"), "cleaned")
    for _ in range(100):  # files are deleted in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and table.count() == 10_000
    assert spark.conf.get(store.CLEANUP, None) == setting
    store.drop(table)
