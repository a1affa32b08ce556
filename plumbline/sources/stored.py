"""Written intermediate tables: they cut the lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_own: str | None = None


def cut(df: DataFrame, name: str) -> DataFrame:
    """`df`, written to the folder of spark.checkpoint.dir and read back; where that is unset on one machine, to a temporary one."""
    global _own
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if _own is None:
            _own = tempfile.mkdtemp(prefix="plumbline-")
            atexit.register(shutil.rmtree, _own, ignore_errors=True)
        base = "file://" + _own
    path = f"{base.rstrip('/')}/plumbline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
