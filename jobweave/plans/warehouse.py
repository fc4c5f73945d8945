"""Silver table shared by the analytics: written once, read many times.

The table lives in the shared folder named by ``spark.checkpoint.dir``.  Reading
it back cuts the lineage, so an analytic neither repeats the de-duplication
shuffles nor loses work with an executor.
"""

from __future__ import annotations

import hashlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from jobweave.plans import silver as plan
from jobweave.sources import derived, writers

_LOCK = threading.Lock()
_WRITTEN: dict[tuple[str, str], str] = {}
OPTIONS = plan.Options(as_of=derived.AS_OF, analysis_start=derived.WINDOW_START,
                       analysis_end=derived.WINDOW_END)
_LOCAL_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder of the cluster for intermediate tables; a temporary one only where unset."""
    configured = (spark.conf.get("spark.checkpoint.dir", None)
                  or spark.sparkContext.getCheckpointDir())
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="jobweave-"))
    return _LOCAL_DIR[0]


def stage_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    tag = hashlib.md5(sf_dir.encode()).hexdigest()[:12]
    return f"{shared_dir(spark)}/jobweave/{spark.sparkContext.applicationId}/{tag}/{name}"


def staged(spark: SparkSession, sf_dir: str, name: str, build, partition_by=()) -> DataFrame:
    """Write ``build()`` once per application and input, then read the table."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}#{name}")
    with _LOCK:
        if key not in _WRITTEN:
            path = stage_path(spark, sf_dir, name)
            writers.write_parquet(build(), path, partition_by)
            _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a step of a longer computation to the shared folder and read it: what follows neither repeats nor plans it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/jobweave/{spark.sparkContext.applicationId}/steps/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = staged(spark, sf_dir, "silver",
                lambda: plan.to_silver(derived.raw_jobs(spark, sf_dir), OPTIONS),
                ["source_website"])
    return plan.export_columns(df)
