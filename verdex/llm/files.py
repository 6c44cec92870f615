"""Binary files in the shared folder, written whole by tasks and memory-mapped by workers."""

from __future__ import annotations

import mmap
import os
import sys
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable
from typing import TypeVar

import numpy as np

T = TypeVar("T")


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def local_path(path: str) -> str | None:
    """The plain path of a file: URI or a plain path; None for other stores."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def put(path: str, arrays: list[np.ndarray]) -> None:
    """Write arrays one after another under `path`, which appears whole or not at all; a repeated task writes the same again."""
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    plain = local_path(path)
    if plain:
        temp = local_path(temp)
        os.makedirs(os.path.dirname(plain), exist_ok=True)
        with open(temp, "wb") as f:
            for a in arrays:
                f.write(memoryview(np.ascontiguousarray(a)).cast("B"))
        os.replace(temp, plain)
        return
    store, at = _filesystem(path)
    _, temp_at = _filesystem(temp)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(temp_at) as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())
    store.move(temp_at, at)


def mapped(path: str) -> np.ndarray:
    """The bytes of a file, memory-mapped; a file that isn't there is an error, as what it held would be missing from the
    result. A store without plain files is copied into Spark's own scratch space first. No file stays open for a map where
    Python allows that (3.13 and later)."""
    plain = local_path(path)
    if not plain:
        from pyspark import SparkFiles

        plain = os.path.join(SparkFiles.getRootDirectory(), path.replace("/", "_").replace(":", "_"))
        if not os.path.exists(plain):
            store, at = _filesystem(path)
            with store.open_input_stream(at) as f, open(f"{plain}.{os.getpid()}", "wb") as out:
                while block := f.read(1 << 22):
                    out.write(block)
            os.replace(f"{plain}.{os.getpid()}", plain)
    with open(plain, "rb") as f:
        if not os.fstat(f.fileno()).st_size:
            return np.zeros(0, np.uint8)
        free = {"trackfd": False} if sys.version_info >= (3, 13) else {}
        return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **free), np.uint8)


class Shards:
    """The files of a kind, one per shard, as a worker reads them: MAPS of them are mapped at once, at most.

    A list of the shards that have a file stands beside them (see tell()), so a shard without data is told from a lost one.
    """

    MAPS = 4096

    def __init__(self, path: str, kind: str, parse: Callable[[np.ndarray], T]):
        self.name, self.parse, self.open = f"{path}/{kind}", parse, OrderedDict()
        self.there: np.ndarray | None = None

    def __getitem__(self, k: int) -> T:
        if k in self.open:
            self.open.move_to_end(k)
            return self.open[k]
        if self.there is None:
            self.there = mapped(f"{self.name}-list")
        out = self.parse(mapped(f"{self.name}-{k:06d}") if self.there[k >> 3] >> (k & 7) & 1 else np.zeros(0, np.uint8))
        self.open[k] = out
        if len(self.open) > self.MAPS:
            self.open.popitem(last=False)
        return out


def tell(path: str, kind: str, shards: int, written: Iterable[int]) -> None:
    """Write which of the shards have a file, a bit each."""
    bits = np.zeros(shards // 8 + 1, np.uint8)
    k = np.fromiter(written, np.int64)
    np.bitwise_or.at(bits, k >> 3, np.left_shift(1, k & 7).astype(np.uint8))
    put(f"{path}/{kind}-list", [bits])
