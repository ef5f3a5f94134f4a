"""Session helpers shared by the operators: staged tables, worker caches, binary blobs."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stilus.storage import discard, new_dir, stage, table

__all__ = ["WORD", "Blobs", "discard", "documents", "free_name", "new_dir", "packs", "released", "stage", "table", "tasks", "text_of", "worker_cache"]

#: Words are maximal runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packs(spark: SparkSession, entries: int, width: int) -> int:
    """Into how many groups so many packed entries go: about 8 MB each, and several to a task, so that tasks are even."""
    return max(4 * tasks(spark), 40, entries * width >> 23)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def text_of(column: str = "text"):
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


_caches: dict[str, dict] = {}


_owner: list[str | None] = []


def worker_cache(owner: str | None = None) -> dict:
    """What an operator keeps in a reused worker from task to task; what others have kept there is dropped first."""
    if _owner != [owner]:
        for name in [n for n in _caches if n != owner]:
            _caches.pop(name).clear()
        gc.collect()
        released()
        _owner[:] = [owner]
    return _caches.setdefault(owner, {}) if owner else {}


def released() -> None:
    """Gives memory that is free, but kept by allocators for later, back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


class Blobs:
    """Arrays kept as raw files in the shared folder, memory-mapped by readers.

    A writer task puts whole files under temporary names and renames them, so
    a retried or speculative task leaves the same content. For a ``file:``
    folder readers map the shared file itself. For other stores a reader
    fetches the file once, maps it and unlinks the local copy at once, so
    nothing stays behind on the executor.
    """

    def __init__(self, uri: str):
        self.uri = uri
        parts = urlparse(uri)
        self.local = unquote(parts.path) if parts.scheme in ("", "file") else None

    def _remote(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def put(self, name: str, array: np.ndarray) -> None:
        data = np.ascontiguousarray(array)
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            temporary = f"{self.local}/.{name}-{uuid.uuid4().hex}"
            data.tofile(temporary)
            os.replace(temporary, f"{self.local}/{name}")
            return
        store, root = self._remote()
        store.create_dir(root, recursive=True)
        temporary = f"{root}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as out:
            out.write(memoryview(data).cast("B"))
        store.move(temporary, f"{root}/{name}")

    def get(self, name: str, dtype) -> np.ndarray:
        if self.local is not None:
            path = f"{self.local}/{name}"
            if os.path.getsize(path) == 0:
                return np.empty(0, dtype)
            return np.memmap(path, dtype, "r")
        store, root = self._remote()
        with tempfile.NamedTemporaryFile() as copy:
            with store.open_input_stream(f"{root}/{name}") as source:
                while chunk := source.read(1 << 22):
                    copy.write(chunk)
            copy.flush()
            return np.memmap(copy.name, dtype, "r") if copy.tell() else np.empty(0, dtype)
