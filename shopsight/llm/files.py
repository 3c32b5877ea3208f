"""Files in the shared folder, from tasks of any executor."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from shopsight.session import scratch_path


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    uri = scratch_path(spark, name)
    fs, path = place(uri)
    fs.create_dir(path, recursive=True)
    return uri


def write(uri: str, chunks) -> int:
    """Write the chunks to a file and give its length."""
    fs, path = place(uri)
    with fs.open_output_stream(path) as out:
        for chunk in chunks:
            out.write(chunk)
        return out.tell()
