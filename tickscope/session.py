"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on for right results or for streaming state.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",  # of a JSON object's equal keys the last one counts
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

# Settings that only help speed; a cluster's own values win over them.
SUGGESTED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(
    app: str = "tickscope", master: str | None = None, settings: dict[str, str] | None = None
) -> SparkSession:
    """A session with the settings above; ``settings`` wins over the suggested ones."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SUGGESTED, **(settings or {}), **REQUIRED}.items():
        builder = builder.config(key, value)
    return apply_runtime_settings(builder.getOrCreate())


def apply_runtime_settings(spark: SparkSession) -> SparkSession:
    """Set the required settings on a session somebody else built."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints, taken from the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only where it
    is unset and everything runs in one process (tests) is a folder of our own made;
    on a cluster a machine-local folder would not survive a lost executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="tickscope-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def written(rows: DataFrame) -> DataFrame:
    """``rows`` stored once as a table in the checkpoint folder and read back.

    Cuts the lineage, survives lost executors, computes the rows once, and gives
    the optimizer the table's true size, so that a join with it is broadcast only
    if it is really small.
    """
    spark = rows.sparkSession
    place = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    rows.write.parquet(place)
    return spark.read.schema(rows.schema).parquet(place)
