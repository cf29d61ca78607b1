"""Files by path or URI: local ones, and those in stores that Arrow reads, by the same calls."""

from __future__ import annotations

import glob as local_glob
import os
import tempfile
import uuid
from fnmatch import fnmatch
from typing import BinaryIO

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):  # as Spark writes it
        path = f"file://{path[5:]}"
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


def open_input(path: str) -> BinaryIO:
    """A seekable binary file; bytes are fetched as they are read."""
    store, at = _store(path)
    return open(at, "rb") if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(at)


def open_output(path: str) -> BinaryIO:
    """A new file that is written from front to end."""
    store, at = _store(path)
    store.create_dir(os.path.dirname(at), recursive=True)
    return store.open_output_stream(at)


def size_of(path: str) -> int:
    store, at = _store(path)
    return store.get_file_info(at).size


def move(source: str, target: str) -> None:
    store, at = _store(source)
    store.move(at, _store(target)[1])


def remove(path: str) -> None:
    store, at = _store(path)
    if store.get_file_info(at).type != pafs.FileType.NotFound:
        store.delete_file(at)


def listed(pattern: str) -> list[str]:
    """The files at a path, in a folder, or that match a glob in the last part of a path."""
    store, at = _store(pattern)
    if isinstance(store, pafs.LocalFileSystem):
        found = sorted(local_glob.glob(at))
        return [f for p in found for f in (sorted(os.path.join(p, n) for n in os.listdir(p)) if os.path.isdir(p) else [p])]
    prefix = pattern[: len(pattern) - len(at)]
    if not any(c in at for c in "*?["):
        info = store.get_file_info(at)
        if info.type == pafs.FileType.File:
            return [pattern]
        return sorted(prefix + f.path for f in store.get_file_info(pafs.FileSelector(at)) if f.type == pafs.FileType.File)
    folder = os.path.dirname(at)
    return sorted(prefix + f.path for f in store.get_file_info(pafs.FileSelector(folder)) if f.type == pafs.FileType.File and fnmatch(f.path, at))


def sized(pattern: str) -> list[tuple[str, int]]:
    """The files of ``listed``, and the bytes of each."""
    files, (store, at) = listed(pattern), _store(pattern)
    if isinstance(store, pafs.LocalFileSystem):
        return [(f, os.path.getsize(f)) for f in files]
    prefix = len(pattern) - len(at)
    return [(f, i.size) for f, i in zip(files, store.get_file_info([f[prefix:] for f in files]), strict=True)]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors reach: below ``spark.checkpoint.dir``; only in local mode a temporary one may stand in."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="scratch-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"
