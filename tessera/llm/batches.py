"""Running a function over Arrow batches of (doc_id, text), on the executors, a bounded slice at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows and bytes of text that one call of the function sees at most (a longer text comes alone).
ROWS, BYTES = 1000, 1 << 20


def sliced(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ROWS rows and about BYTES bytes of text; no text is cut."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and (total + n > BYTES or i - start >= ROWS):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def per_text(docs: DataFrame, row: Callable[[str], tuple], schema: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each document: ``keep`` and then what ``row`` says of its text (null: the empty text)."""
    fields = StructType([*(docs.schema[c] for c in keep), *StructType.fromDDL(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for whole in batches:
            for batch in sliced(whole):
                found = [row(t or "") for t in batch.column("text").to_pylist()]
                columns = [batch.column(c) for c in keep]
                types = types or arrow_types(schema)
                made = [pa.array(list(v), t) for v, (_, t) in zip(zip(*found), types)]
                yield pa.RecordBatch.from_arrays(columns + made, names=[*keep, *(n for n, _ in types)])

    return docs.select(*keep, "text").mapInArrow(run, fields)


def arrow_types(schema: str) -> list[tuple[str, pa.DataType]]:
    """Names and Arrow types of a flat schema string such as ``a long, b string``."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return [(n, kinds[k]) for n, k in (field.split() for field in schema.split(","))]
