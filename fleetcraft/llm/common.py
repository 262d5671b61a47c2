"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetcraft.session import checkpoint_dir

#: Rows of one Arrow batch that a task builds at a time.
OUT_ROWS = 256


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder of the cluster."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write to the shared folder and read back: lineage ends at files all executors see."""
    path = shared_path(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column) -> F.Column:
    """A text column as raw UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def map_texts(df: DataFrame, column: str, keep: list[str], fields: T.StructType,
              make: Callable[[], Callable[[list[bytes]], list[tuple]]], out_rows: int = OUT_ROWS) -> DataFrame:
    """One output row per input row: ``keep`` columns plus what a function says of the texts.

    ``make`` is called once per task (to build caches) and returns a function
    from a list of UTF-8 texts (null as empty) to a list of tuples of
    ``fields``. It is given at most ``out_rows`` texts at a time, so a task's
    memory follows the texts it is working on.
    """
    apart = column not in keep
    source = df.select(*keep, utf8(column).alias("__utf8")) if apart else df.select(*keep)
    at = len(keep) if apart else keep.index(column)
    schema = T.StructType([source.schema[c] for c in keep] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        fn = make()
        for batch in batches:
            for start in range(0, batch.num_rows, out_rows):
                part = batch.slice(start, out_rows)
                rows = fn([v or b"" for v in part.column(at).cast(pa.binary()).to_pylist()])
                new = [pa.array([r[i] for r in rows], type=arrow.field(len(keep) + i).type)
                       for i in range(len(fields))]
                kept = [part.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *new], schema=arrow)

    return source.mapInArrow(run, schema)


def map_bytes(df: DataFrame, column: str, keep: list[str], fields: T.StructType,
              make: Callable[[], Callable[[bytes], tuple]], out_rows: int = OUT_ROWS) -> DataFrame:
    """As map_texts() with a function of one text."""
    def make_list():
        one = make()
        return lambda texts: [one(t) for t in texts]

    return map_texts(df, column, keep, fields, make_list, out_rows)


def read_bytes(path: str) -> bytes:
    """A small local file (a tokenizer's vocabulary), read on the driver and shipped to tasks."""
    with open(path, "rb") as f:
        return f.read()


def file_system(uri: str):
    """The pyarrow file system of a folder or file, and its path there."""
    from pyarrow import fs
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def worker_cache(key) -> dict:
    """A dict that lives as long as the Python worker, for what several of its tasks can use."""
    import sys
    import types
    home = sys.modules.setdefault("fleetcraft_worker_cache", types.ModuleType("fleetcraft_worker_cache"))
    return home.__dict__.setdefault("kept", {}).setdefault(key, {})
