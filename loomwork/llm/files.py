"""Files of our own formats: kept as rows of Spark tables, so that Spark's file systems alone hold them, and put out as files on request."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """A folder by its URI; what Spark's S3 connector calls s3a is s3 here."""
    scheme, mark, rest = uri.partition("://")
    if not mark:
        raise ValueError("a folder is named with its scheme, as file:///data, s3a://bucket/data or hdfs://host/data")
    return pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


def put_out(table: DataFrame, folder: str, name: str = "name", data: str = "data") -> DataFrame:
    """Write every row's ``data`` as a file ``name`` below a folder that all workers reach: name, bytes.

    A task that runs again writes the same bytes to the same names."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _folder(folder)
        fs.create_dir(path, recursive=True)
        for batch in batches:
            for own, raw in zip(batch["name"].to_pylist(), batch["data"], strict=True):
                with fs.open_output_stream(f"{path}/{own}", compression=None) as out:
                    out.write(raw.as_py())
            yield pa.RecordBatch.from_arrays([batch["name"], pa.array([len(x.as_py()) for x in batch["data"]], pa.int64())], ["name", "bytes"])

    return table.select(F.col(name).alias("name"), F.col(data).alias("data")).mapInArrow(write, "name string, bytes long")
