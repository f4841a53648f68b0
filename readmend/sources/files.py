"""Small driver-side files on any file system the paths name."""

from __future__ import annotations

import os

from pyarrow import fs
from pyspark.sql import SparkSession


#: Names that Spark has for a store and pyarrow has not.
_SAME_STORE = {"s3a": "s3", "s3n": "s3"}


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark understands it, with the scheme of its default file system
    where it names none. Tasks and the driver then mean the same place."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    uri = place.getFileSystem(conf).makeQualified(place).toString()
    return uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    scheme, found, rest = path.partition("://")
    if found:
        return fs.FileSystem.from_uri(f"{_SAME_STORE.get(scheme, scheme)}://{rest}")
    if path.startswith("file:"):
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.LocalFileSystem(), os.path.abspath(path)


def read_bytes(path: str) -> bytes:
    system, inner = resolve(path)
    with system.open_input_stream(inner, compression=None) as f:
        return f.read()


def write_bytes(path: str, data) -> None:
    write_chunks(path, [data])


def write_chunks(path: str, chunks) -> None:
    system, inner = resolve(path)
    parent = inner.rsplit("/", 1)[0]
    if parent:
        system.create_dir(parent, recursive=True)
    with system.open_output_stream(inner, compression=None) as f:
        for data in chunks:
            f.write(data)


def delete(path: str) -> None:
    system, inner = resolve(path)
    system.delete_file(inner)


def read_text(path: str) -> str:
    return read_bytes(path).decode()


def write_text(path: str, text: str) -> None:
    write_bytes(path, text.encode())
