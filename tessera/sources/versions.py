"""Immutable versions of a table with a pointer to the active one, and incremental builds.

A version is a Parquet folder that is written once; its manifest row is written after
it, and a version without a manifest does not exist. The pointer is a log of rows, the
newest of which counts, so switching and going back never overwrite what is being read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "version string, created_at timestamp, n_rows bigint, fingerprint string"


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows and an order-free digest of all columns."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
    n, total, mixed = df.agg(F.count("*"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.bit_xor(row), F.lit(0))).first()
    return n, f"{n}:{total}:{mixed}"


class VersionStore:
    """Versions under a root folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def publish(self, df: DataFrame, version: str) -> str:
        """Write ``df`` as a new version, check what was written, and make it the active one."""
        path = f"{self.root}/data/version={version}"
        df.write.mode("errorifexists").parquet(path)
        n, mark = fingerprint(self.spark.read.schema(df.schema).parquet(path))
        row = self.spark.createDataFrame([(version, n, mark)], "version string, n_rows bigint, fingerprint string").withColumn("created_at", F.current_timestamp())
        row.select("version", "created_at", "n_rows", "fingerprint").write.mode("append").parquet(f"{self.root}/manifest")
        self.activate(version)
        return path

    def activate(self, version: str) -> None:
        """Point to a stored version; unknown ones are refused."""
        if self._log("manifest", _MANIFEST).where(F.col("version") == version).isEmpty():
            raise ValueError(f"no version {version}")
        row = self.spark.createDataFrame([(version,)], "version string").withColumn("at", F.current_timestamp())
        row.write.mode("append").parquet(f"{self.root}/pointer")

    def active(self) -> str | None:
        row = self._log("pointer", "version string, at timestamp").orderBy(F.desc("at")).first()
        return row["version"] if row else None

    def versions(self) -> DataFrame:
        """Versions, newest first, with the active one flagged."""
        return self._log("manifest", _MANIFEST).withColumn("active", F.col("version") == F.lit(self.active())).orderBy(F.desc("created_at"), F.desc("version"))

    def read(self, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/data/version={version or self.active()}")

    def verify(self, version: str) -> bool:
        """Whether the stored rows still have the manifest's fingerprint."""
        row = self._log("manifest", _MANIFEST).where(F.col("version") == version).first()
        return row is not None and fingerprint(self.read(version))[1] == row["fingerprint"]


def incremental(previous: DataFrame, current: DataFrame, key: str = "name", content: str = "text") -> DataFrame:
    """What a build does with each file: reuse (same digest), parse (new or changed) or remove."""
    a = previous.select(F.col(key).alias("k"), F.sha2(F.col(content), 256).alias("old"))
    b = current.select(F.col(key).alias("k"), F.sha2(F.col(content), 256).alias("new"))
    action = F.when(F.col("new").isNull(), "remove").when(F.col("old") == F.col("new"), "reuse").otherwise("parse")
    return a.join(b, "k", "full").select(F.col("k").alias(key), action.alias("action"))
