"""Versions that appear whole or not at all: a staged sink, and snapshots that are checked before they count.

Tasks write Parquet files into a stage folder and report name, rows, size and digest. Only
the commit of the whole job moves the folder to its place, and only then is the list of files
written; a failed job's abort removes the stage (what tasks that still run leave there
afterwards is never listed, and goes with the next write of that version). What readers see is the version that the
pointer names, so a failure at any step, the caller's own check included, leaves the active
version as it was. Files are hashed and copied by tasks, piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.sources.versions import VersionStore

#: Bytes of a file that are held at a time.
PIECE = 8 << 20
_FILE = "name string, n_rows long, size long, sha256 string"


class SnapshotError(ValueError):
    """A snapshot that must not become active; says why."""


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote; no name where it had no rows."""

    name: str | None
    n_rows: int = 0
    size: int = 0
    sha256: str = ""


def _at(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def _digest(files: fs.FileSystem, path: str, copy_to: tuple[fs.FileSystem, str] | None = None) -> tuple[int, str]:
    """Size and SHA-256 of a file, which is copied on the way if a place is given."""
    size, sha = 0, hashlib.sha256()
    out = copy_to[0].open_output_stream(copy_to[1]) if copy_to else None
    with files.open_input_stream(path) as stream:
        while piece := stream.read(PIECE):
            size += len(piece)
            sha.update(piece)
            if out:
                out.write(piece)
    if out:
        out.close()
    return size, sha.hexdigest()


class StagedWriter(DataSourceArrowWriter):
    """Writes a version's files; see the module for what commit and abort do."""

    def __init__(self, root: str, version: str):
        self.root, self.version = root, version

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        files, base = _at(self.root)
        context = TaskContext.get()
        name, writer, n = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.parquet", None, 0
        path = f"{base}/stage/{self.version}/{name}"
        for batch in iterator:
            if writer is None:
                files.create_dir(f"{base}/stage/{self.version}", recursive=True)
                sink = files.open_output_stream(path)
                writer = pq.ParquetWriter(sink, batch.schema)
            writer.write_batch(batch)
            n += batch.num_rows
        if writer is None:
            return Written(None)
        writer.close()
        sink.close()
        return Written(name, n, *_digest(files, path))

    def commit(self, messages: list[Written | None]) -> None:
        files, base = _at(self.root)
        kept = sorted((m for m in messages if m and m.name), key=lambda m: m.name)
        stage, place = f"{base}/stage/{self.version}", f"{base}/data/version={self.version}"
        files.create_dir(stage, recursive=True)
        names = {m.name for m in kept}
        for info in files.get_file_info(fs.FileSelector(stage)):  # of attempts that did not count
            if info.base_name not in names:
                files.delete_file(info.path)
        files.create_dir(f"{base}/data", recursive=True)
        files.move(stage, place)
        columns = [[getattr(m, c.split()[0]) for m in kept] for c in _FILE.split(", ")]
        schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in _FILE.split(", ")])
        files.create_dir(f"{base}/files", recursive=True)
        _put(files, pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema), f"{base}/files/{self.version}.parquet")

    def abort(self, messages: list[Written | None]) -> None:
        files, base = _at(self.root)
        _remove(files, f"{base}/stage/{self.version}")


def _put(files: fs.FileSystem, rows: pa.Table, path: str) -> None:
    """A small table written beside its place and moved there, so that no one reads half of it."""
    with files.open_output_stream(f"{path}.part") as sink:
        pq.write_table(rows, sink)
    files.move(f"{path}.part", path)


def _remove(files: fs.FileSystem, path: str) -> None:
    if files.get_file_info(path).type != fs.FileType.NotFound:
        files.delete_dir(path)


class StagedSource(DataSource):
    """``df.write.format("staged_parquet").option("root", ...).option("version", ...).mode("append").save()``."""

    @classmethod
    def name(cls) -> str:
        return "staged_parquet"

    def writer(self, schema: StructType, overwrite: bool) -> StagedWriter:
        files, base = _at(self.options["root"])
        if files.get_file_info(f"{base}/data/version={self.options['version']}").type != fs.FileType.NotFound:
            raise ValueError(f"version {self.options['version']} exists")
        _remove(files, f"{base}/stage/{self.options['version']}")
        return StagedWriter(self.options["root"], self.options["version"])


class StagedStore(VersionStore):
    """A version store whose versions come from the staged sink or from a snapshot."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root)
        spark.dataSource.register(StagedSource)

    def files(self, version: str) -> DataFrame:
        """name, n_rows, size and sha256 of a version's files."""
        return self.spark.read.schema(_FILE).parquet(f"{self.root}/files/{version}.parquet")

    def _discard(self, version: str) -> None:
        files, base = _at(self.root)
        for path in (f"{base}/stage/{version}", f"{base}/data/version={version}"):
            _remove(files, path)
        if files.get_file_info(f"{base}/files/{version}.parquet").type != fs.FileType.NotFound:
            files.delete_file(f"{base}/files/{version}.parquet")

    def publish(self, df: DataFrame, version: str, after_build: Callable[[DataFrame], object] | None = None) -> str:
        """Write ``df`` as ``version`` and make it active; if writing, the check of its files or ``after_build`` fails, nothing of it stays."""
        place = f"{self.root}/data/version={version}"
        writer = df.write.format("staged_parquet").option("root", self.root).option("version", version).mode("append")
        writer.save()  # a failure has been cleared away by the sink's abort
        try:
            self._activate_checked(version, df.schema, after_build)
        except Exception:
            self._discard(version)
            raise
        return place

    def _activate_checked(self, version: str, schema: StructType | None, after_build: Callable[[DataFrame], object] | None) -> None:
        if wrong := self.problems(version):
            raise SnapshotError("; ".join(wrong))
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/data/version={version}") if schema else self.read(version)
        n, size = self.files(version).agg(F.coalesce(F.sum("n_rows"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
        if after_build:
            after_build(rows)
        row = self.spark.createDataFrame([(version, n, f"{n}:{size}")], "version string, n_rows bigint, fingerprint string").withColumn("created_at", F.current_timestamp())
        row.select("version", "created_at", "n_rows", "fingerprint").write.mode("append").parquet(f"{self.root}/manifest")
        self.activate(version)

    def problems(self, version: str) -> list[str]:
        """What is wrong with the files of a version by its list: missing, of another size, of another content, or not on the list."""
        root = self.root

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, base = _at(root)
            for batch in batches:
                out = []
                for name, size, sha in zip(*(batch.column(c).to_pylist() for c in ("name", "size", "sha256"))):
                    path = f"{base}/data/version={version}/{name}"
                    if files.get_file_info(path).type != fs.FileType.File:
                        out.append(f"missing {name}")
                    elif (found := _digest(files, path)) != (size, sha):
                        out.append(f"{'size' if found[0] != size else 'digest'} of {name}")
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["problem"])

        listed = self.files(version).repartition(max(1, self.spark.sparkContext.defaultParallelism))
        wrong = [r["problem"] for r in listed.mapInArrow(look, "problem string").limit(20).collect()]
        files, base = _at(root)
        held = {i.base_name for i in files.get_file_info(fs.FileSelector(f"{base}/data/version={version}", allow_not_found=True))}
        extra = held - {r["name"] for r in self.files(version).select("name").toLocalIterator()}
        return sorted(wrong) + [f"unlisted {n}" for n in sorted(extra)][:20]

    def import_snapshot(self, source: str, version: str, max_bytes: int, after_activate: Callable[[DataFrame], object] | None = None) -> None:
        """Copy ``version`` of the store at ``source`` and make it active, if all that its list says is true.

        The list must have files, no name that leads out of the folder, and no more than
        ``max_bytes`` in all; each file is hashed while it is copied, and the copies are
        checked again before the pointer moves. Otherwise SnapshotError, and the active version stays.
        """
        root, place = self.root, f"{source.rstrip('/')}/data/version={version}"
        listed = self.spark.read.schema(_FILE).parquet(f"{source.rstrip('/')}/files/{version}.parquet")
        n, size, odd = listed.agg(F.count("*"), F.sum("size"), F.count_if(F.col("name").isNull() | F.col("name").rlike(r"[/\\]|^\.\.?$"))).first()
        if not n:
            raise SnapshotError("empty snapshot")
        if odd:
            raise SnapshotError("a name leads out of the folder")
        if size > max_bytes:
            raise SnapshotError(f"{size} bytes are more than {max_bytes}")
        files, base = _at(root)
        if files.get_file_info(f"{base}/data/version={version}").type != fs.FileType.NotFound:
            raise SnapshotError(f"version {version} exists")
        files.create_dir(f"{base}/stage/{version}", recursive=True)

        def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (there, source_base), (here, own_base) = _at(place), _at(root)
            for batch in batches:
                out = []
                for name, size, sha in zip(*(batch.column(c).to_pylist() for c in ("name", "size", "sha256"))):
                    if there.get_file_info(f"{source_base}/{name}").type != fs.FileType.File:
                        out.append(f"missing {name}")
                    elif (found := _digest(there, f"{source_base}/{name}", (here, f"{own_base}/stage/{version}/{name}"))) != (size, sha):
                        out.append(f"{'size' if found[0] != size else 'digest'} of {name}")
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["problem"])

        try:
            wrong = [r["problem"] for r in listed.repartition(self.spark.sparkContext.defaultParallelism).mapInArrow(copy, "problem string").collect()]
            if wrong:
                raise SnapshotError("; ".join(sorted(wrong)[:20]))
            files.create_dir(f"{base}/data", recursive=True)
            files.create_dir(f"{base}/files", recursive=True)
            files.move(f"{base}/stage/{version}", f"{base}/data/version={version}")
            with files.open_output_stream(f"{base}/files/{version}.parquet.part") as sink:
                pq.write_table(pa.Table.from_pylist([r.asDict() for r in listed.collect()], pq.read_schema(*_open(source, version))), sink)  # a row for each file
            files.move(f"{base}/files/{version}.parquet.part", f"{base}/files/{version}.parquet")
            self._activate_checked(version, None, after_activate)
        except Exception:
            self._discard(version)
            raise


def _open(source: str, version: str) -> tuple:
    files, base = _at(source.rstrip("/"))
    return (files.open_input_file(f"{base}/files/{version}.parquet"),)
