"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tessera", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with AQE and UTC; master and partitions stay the cluster's unless given."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder set in spark.checkpoint.dir or on the context; one of our own only where none is set.

    A folder of our own is used only with a local master (tests): on a cluster a machine-local
    folder would be lost with its executor, so an unset folder is an error there.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession, per_core: int = 3) -> int:
    """A number of partitions that keeps all cores busy through uneven tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), per_core * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df for work that is heavy for its bytes: hashed over all cores if its scan has too few splits for them.

    A scan with a split for each core stays as it is, so large inputs are not shuffled.
    """
    spark, plan = df.sparkSession, df._jdf.queryExecution()
    # A plan with shuffles would have to run before its partitions are known; only a plain scan is asked.
    plain = not plan.executedPlan().nodeName().startswith("AdaptiveSparkPlan")
    if plain and plan.toRdd().getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(parallelism(spark), key)
