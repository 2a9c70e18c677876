"""Session construction and the shared working folder."""
from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "noticeboard", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings this library relies on. A cluster supplies its own master,
    memory and shuffle-partition settings; only semantics (UTC, AQE) are fixed here."""
    builder = (SparkSession.builder.appName(app_name)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true"))
    if master:
        builder = builder.master(master)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="noticeboard-")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder: the session's setting, else the
    context's. Only a local session that names none gets a temporary folder of this machine; on a
    cluster that is an error, because executors would write to disks of their own."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """The rows written once to the shared folder and read back: for query tables that several
    branches use, and for results of outside functions that must not be asked twice. The files
    outlive any executor and give the optimizer exact sizes."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Below this much input per core a scan may have fewer splits than the session has cores.
SPREAD_BYTES_PER_CORE = 8 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the input is so small that its splits would leave cores idle
    (judged by the optimizer's size estimate; nothing runs). A large input has splits enough and
    stays as it is, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES_PER_CORE else df
