"""Session defaults shared by the bench, the tests and interactive use."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of our own, by application, where the session names none.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder for a local master, and one in the warehouse on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context.applicationId not in _own:
            local = context.master == "local" or context.master.startswith("local[")
            _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='tessera-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_tessera"
        folder = _own[context.applicationId]
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: used more than once, it is computed once, and outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_session(app: str = "tessera", cores: int | str | None = None) -> SparkSession:
    """A session with AQE on and UTC times; on a cluster the submitter's settings win."""
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    return (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
