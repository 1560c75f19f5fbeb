"""What the operators of this subpackage share: inputs, word splitting, and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import tables
from tessera.sources.tables import spread

#: A word is a run of characters other than the space and U+0009 to U+000D.
SPACES = "[ \\u0009-\\u000D]+"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
WORD = "[^ \\u0009-\\u000D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table by Spark's reader; a small one in few files is dealt to all cores."""
    return spread(tables.table(spark, folder, name))


def bounded(spark: SparkSession) -> None:
    """Arrow batches of a few megabytes, unless the session asks for another size: workers hold one at a time."""
    if spark.conf.get(_BATCH) == "67108864b":
        spark.conf.set(_BATCH, "4m")


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and ``more`` alone, so that extra columns can clash with nothing."""
    bounded(docs.sparkSession)
    return docs.select("doc_id", "text", *more)


def whole(docs: DataFrame) -> Column:
    """All columns of ``docs`` in one struct, so that names of our own beside it clash with none; ``select("row.*")`` gives them back."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row")


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


#: Folders of our own, by application, where the session names none.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.

    Only where that is unset: a temporary folder for a local master, and on a cluster a
    folder in the warehouse, which all executors share.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context.applicationId not in _own:
            local = context.master == "local" or context.master.startswith("local[")
            _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='tessera-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_tessera"
        folder = _own[context.applicationId]
    return folder.rstrip("/")


def settle(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in a file that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
