"""Arrays as compressed cells of a row, as memory-mapped files in the shared folder, and the Arrow calls that all operators use."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, GroupedData


_TIDIED = [0.0]


@lru_cache(maxsize=1)
def _libc():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: it keeps what it has freed
        return None


@lru_cache(maxsize=1)
def map_large() -> None:
    """From now on this worker maps blocks of 16 MB or more by themselves, so that they go back when they are freed.

    Smaller ones are used again without new page faults; up to 128 MB of them go back at the end of a task (``tidy``).
    """
    if _libc() is not None:
        _libc().mallopt(-3, 16 << 20)
        _libc().mallopt(-1, 128 << 20)


def tidy(least: float = 2.0) -> None:
    """Give freed memory back to the system, at most every ``least`` seconds: workers live through many tasks and stages."""
    if time.monotonic() - _TIDIED[0] >= least:
        pa.default_memory_pool().release_unused()
        if _libc() is not None:
            _libc().malloc_trim(0)
        _TIDIED[0] = time.monotonic()


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` of tasks that give their memory back when they end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy(0.0)

    return df.mapInArrow(task, schema)


def apply_arrow(groups: GroupedData, one: Callable, schema) -> DataFrame:
    """``applyInArrow`` of groups; freed memory goes back now and then."""

    def task(table: pa.Table) -> pa.Table:
        out = one(table)
        tidy()
        return out

    return groups.applyInArrow(task, schema)


def packed(values: np.ndarray, dtype=None, level: int = 1) -> bytes:
    """An array as one binary cell."""
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(values, dtype).tobytes())


def packed_wide(values: np.ndarray) -> bytes:
    """An array of 64-bit numbers, byte by byte: most of their high bytes are alike."""
    return packed(np.ascontiguousarray(values, np.int64).view(np.uint8).reshape(-1, 8).T)


def unpacked_wide(cell: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpacked(cell, np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1)


def unpacked(cell: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), dtype)


def packed_sorted(values: np.ndarray) -> bytes:
    """An ascending array of 64-bit numbers, by differences."""
    values = np.ascontiguousarray(values, np.uint64)
    steps = values.copy()
    steps[1:] -= values[:-1]
    return packed(steps.view(np.uint8).reshape(-1, 8).T)


def unpacked_sorted(cell: bytes) -> np.ndarray:
    return np.cumsum(unpacked(cell, np.uint8).reshape(8, -1).T.copy().view(np.uint64).reshape(-1), dtype=np.uint64)


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def save(uri: str, *arrays: np.ndarray) -> None:
    """Write arrays one after the other to a file of the shared folder; a task that runs twice replaces it by the same bytes."""
    system, path = _place(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    name = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(name) as out:
        for values in arrays:
            out.write(np.ascontiguousarray(values).data.cast("B") if values.size else b"")
    system.move(name, path)


@lru_cache(maxsize=1 << 15)
def mapped(uri: str, dtype: str) -> np.ndarray:
    """The array at ``uri``, memory-mapped: in place if the folder is mounted, else from an unlinked local copy."""
    from pyarrow import fs

    system, path = _place(uri)
    info = system.get_file_info(path)
    if info.type != fs.FileType.File or not info.size:
        return np.zeros(0, dtype)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with tempfile.NamedTemporaryFile() as local:
        with system.open_input_stream(path) as source:
            while part := source.read(16 << 20):
                local.write(part)
        local.flush()
        return np.memmap(local.name, dtype, "r")  # the mapping outlives the file's name


def save_parts(uri: str, arrays: list[np.ndarray]) -> None:
    """Several arrays in one file, each after its length and width, on bounds of eight bytes."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.itemsize))], np.uint64)
    save(uri, head, *(x for a in arrays for x in (a, np.zeros(-a.nbytes % 8, np.uint8))))


def parts(uri: str) -> list[np.ndarray]:
    """The arrays of ``save_parts``, memory-mapped, as unsigned numbers; none if there is no file."""
    every = np.asarray(mapped(uri, "u1"))
    if not len(every):
        return []
    head = every[: 8 + 16 * int(every[:8].view(np.uint64)[0])].view(np.uint64)
    out, at = [], head.nbytes
    for n, width in head[1:].reshape(-1, 2).tolist():
        out.append(every[at : at + n * width].view(f"u{width}"))
        at += -(-n * width // 8) * 8
    return out
