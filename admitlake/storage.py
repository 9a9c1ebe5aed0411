"""The folder that driver and executors share, and frames that are written there once."""

from __future__ import annotations

import tempfile
import uuid
from math import ceil

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. A local session without one gets a temporary folder; on a cluster that is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="admitlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: it is computed once, and outlives the executors that did."""
    path = f"{shared_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of input, as Spark reckons them from its files, that one task of a shuffle holds, about.
HELD = 8 << 20


def tasks_for(df: DataFrame) -> int:
    """How many tasks df is shuffled to, so that what one of them holds does not grow with the input; the session's number at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(ceil(size / HELD), 10_000))
