"""A Spark data source of keypoint files: `.npy` arrays (frames x points x dims) under artist/song/instrument.npy.

A file's header is read once, on planning; from it come ranges of frames, each a partition that reads its own bytes. No
file is held whole, and a long file is read by many tasks.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "artist string, song string, instrument string, frame int, kp array<array<double>>"
#: Bytes of a partition, and frames of a batch.
PART_BYTES, BATCH = 32 << 20, 1024


class Mounted:
    """A folder that every machine has under the same path."""

    def listed(self, root: str) -> list[str]:
        return sorted(os.path.join(d, name) for d, _, names in os.walk(root) for name in names)

    def read(self, path: str):
        return open(path, "rb")

    def write(self, path: str):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")

    def move(self, path: str, to: str) -> None:
        os.replace(path, to)


class Store:
    """A store that Arrow can reach by URI."""

    def __init__(self, files):
        self.files = files

    def listed(self, root: str) -> list[str]:
        from pyarrow import fs

        return sorted(f.path for f in self.files.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File)

    def read(self, path: str):
        return self.files.open_input_file(path)

    def write(self, path: str):
        self.files.create_dir(path.rpartition("/")[0], recursive=True)
        return self.files.open_output_stream(path)

    def move(self, path: str, to: str) -> None:
        self.files.move(path, to)


def opened(path: str) -> tuple[Mounted | Store, str]:
    """What reads and writes files at a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = path.removeprefix("file:")
        return Mounted(), path.removeprefix("//") if path.startswith("//") else path
    if "://" not in path:
        return Mounted(), path
    from pyarrow import fs  # it starts threads, which processes that only read mounted folders do without

    files, inner = fs.FileSystem.from_uri(path)
    return Store(files), inner


@dataclass
class Frames(InputPartition):
    """Frames `first` to before `end` of a file, the bytes of which start at `offset`."""

    path: str
    first: int
    end: int
    offset: int
    shape: tuple
    kind: str


def header(file) -> tuple[tuple, bool, np.dtype, int]:
    """Shape, whether columns come first, type and length of the header."""
    start = file.read(12)
    long = start[6] > 1
    size = int.from_bytes(start[8:12] if long else start[8:10], "little") + (12 if long else 10)
    whole = io.BytesIO(start + file.read(size - 12))
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}
    shape, by_column, kind = read[np.lib.format.read_magic(whole)](whole)
    return shape, by_column, kind, size


class Reader(DataSourceReader):
    def __init__(self, root: str, part_bytes: int):
        self.root, self.part_bytes = root, part_bytes

    def partitions(self) -> list[Frames]:
        store, root = opened(self.root)
        found = []
        for path in store.listed(root):
            if not path.endswith(".npy"):
                continue
            with store.read(path) as file:
                shape, by_column, kind, offset = header(file)
            if kind.hasobject or by_column and len(shape) > 1 or len(shape) != 3:
                raise ValueError(f"{path}: an array of numbers (frames x points x dims) by rows is asked for")
            row = max(1, kind.itemsize * shape[1] * shape[2])
            step = max(1, self.part_bytes // row)
            found += [Frames(path, k, min(k + step, shape[0]), offset + k * row, tuple(shape), kind.str) for k in range(0, shape[0], step)]
        return found or [Frames("", 0, 0, 0, (0, 0, 0), "<f8")]

    def read(self, part: Frames) -> Iterator[pa.RecordBatch]:
        if part.end <= part.first:
            return
        store, _ = opened(self.root)
        artist, song, name = part.path.split("/")[-3:]
        names = [artist, song, name.removesuffix(".npy")]
        kind, (points, dims) = np.dtype(part.kind), part.shape[1:]
        with store.read(part.path) as file:
            file.seek(part.offset)
            for first in range(part.first, part.end, BATCH):
                n = min(BATCH, part.end - first)
                data = np.frombuffer(file.read(n * points * dims * kind.itemsize), kind).astype(float)
                inner = pa.ListArray.from_arrays(np.arange(n * points + 1, dtype=np.int32) * dims, pa.array(data))
                kp = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * points, inner)
                yield pa.RecordBatch.from_arrays([*(pa.array([x] * n) for x in names), pa.array(np.arange(first, first + n, dtype=np.int32)), kp], names=["artist", "song", "instrument", "frame", "kp"])


class KeypointArrays(DataSource):
    """`spark.read.format("keypoint_arrays").load(root)`; option `part_bytes` for the bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "keypoint_arrays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))
