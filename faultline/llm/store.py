"""Shared storage: intermediate tables and operator files live in the cluster's checkpoint folder.

``materialise`` cuts lineage by writing Parquet to the folder in ``spark.checkpoint.dir`` and reading
it back, so a lost executor costs only the tasks it ran, and the planner sees true file sizes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from faultline.session import ensure_checkpoint_dir


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with scheme and authority, as the cluster's default file system completes it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(hadoop).toString()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, with its scheme; not created yet."""
    return qualified(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return it as a fresh Parquet scan."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filesystem_uri(path: str) -> str:
    """The URI under which pyarrow knows a qualified path: one name for S3, three slashes for local files."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        raise ValueError(f"{path} has no scheme; complete it with qualified()")
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    return {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + rest


def filesystem(path: str):
    """(pyarrow filesystem, path inside it) for a shared, qualified path; used inside tasks to write files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(filesystem_uri(path))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(table: pa.RecordBatch) -> bytes:
    """A table in Arrow's stream format."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_batch(table)
    return sink.getvalue().to_pybytes()


def unpacked(raw: bytes) -> pa.Table:
    with pa.ipc.open_stream(raw) as stream:
        return stream.read_all()


def by_part(table: pa.RecordBatch, part: np.ndarray) -> pa.RecordBatch:
    """``(part, counts)``: the rows of ``table`` as one packed table for each value of ``part``."""
    order = np.argsort(part, kind="stable")
    parts, first = np.unique(part[order], return_index=True)
    table = table.take(pa.array(order))
    counts = [packed(table.slice(a, z - a)) for a, z in zip(first, [*first[1:], table.num_rows])]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(counts, pa.binary())], ["part", "counts"])


def met_parts(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.Table]:
    """Each part of ``by_part`` whole, from rows sorted by part: column n summed up by all others."""
    now, lots, more = None, [], 0

    def merged() -> pa.Table:
        keys = [c for c in lots[0].column_names if c != "n"]
        found = pa.concat_tables(lots).group_by(keys, use_threads=False).aggregate([("n", "sum")])
        return found.select([*keys, "n_sum"]).rename_columns([*keys, "n"]).combine_chunks()

    for b in batches:
        for part, counts in zip(b.column("part").to_pylist(), b.column("counts")):
            if part != now:
                if lots:
                    yield merged()
                now, lots, more = part, [], 0
            lots.append(unpacked(counts.as_py()))
            more += lots[-1].num_rows if len(lots) > 1 else 0
            if more > lots[0].num_rows + held:
                lots, more = [merged()], 0
    if lots:
        yield merged()
