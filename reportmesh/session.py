"""Session helpers: UTC semantics and the durable folder used to cut lineage."""

from __future__ import annotations

import gc
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Conf keys this library relies on. All of them are runtime-settable.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a union that keeps its inputs' partitioning loses it when the adaptive planner coalesces one of them:
    # "Can't zip RDDs with unequal numbers of partitions"
    "spark.sql.unionOutputPartitioning": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SESSION_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Where it is unset the folder lies
    in the warehouse, which executors share as well.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir')}/reportmesh-stages"
        if not sc.master.startswith("local") and named.startswith("file:"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


_scopes = threading.local()


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Drop the stages written inside once the block is left, also by an error.

    For steps whose result lies elsewhere by then, as a published snapshot does. Scopes belong to the
    thread and nest; a stage written with ``beyond_scope`` outlives the innermost one.
    """
    open_scopes = _scopes.__dict__.setdefault("paths", [])
    open_scopes.append([])
    try:
        yield
    finally:
        for path in open_scopes.pop():
            drop_stage(spark, path)


def write_stage(df: DataFrame, *, beyond_scope: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` once as a compressed columnar table in the shared folder and read it back.

    Later readers prune columns, push filters down and plan against a plain scan; lost executors
    re-read the table instead of replaying the steps before it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    open_scopes = _scopes.__dict__.get("paths", [])
    owners = open_scopes[:-1] if beyond_scope else open_scopes
    if owners:
        owners[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut_lineage(df: DataFrame, *, beyond_scope: bool = False) -> DataFrame:
    return write_stage(df, beyond_scope=beyond_scope)[0]


def release_shuffles(spark: SparkSession) -> None:
    """Have shuffle files dropped that no plan needs any more, as those of stages that are written.

    Spark drops them once the driver collects its garbage, which a driver with little to do hardly does.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def together(spark: SparkSession, jobs: list[Callable], most: int = 4) -> list:
    """Results of independent jobs, a few of them at the same time: small ones leave most cores idle.

    All have ended when this returns or raises the first error. Stages that a job writes belong to no scope.
    """
    with ThreadPoolExecutor(most) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    return [job.result() for job in running]


def drop_stage(spark: SparkSession, path: str) -> None:
    """Remove a staged table nothing reads any more."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop_path.getFileSystem(conf).delete(hadoop_path, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use the whole cluster even when the input is a handful of large, unsplittable files."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted, key) if df.rdd.getNumPartitions() < wanted else df
