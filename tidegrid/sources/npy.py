"""A data source for two-dimensional .npy arrays: blocks of rows are partitions, each read through a memory map.

    spark.dataSource.register(NpyDataSource)
    spark.read.format("npy").option("path", "/shared/mask.npy").option("y0", 0).option("y1", 500).load()

gives (y, x, value), nulls for NaN; option nonzero=true leaves out zeros. The file must lie where all executors can open it.

    cells.write.format("npy").option("path", "/shared/mask.npy").option("height", 12960).option("width", 17280).option("dtype", "u1").mode("overwrite").save()

writes (y, x, value) back: every task puts its cells at their places in a file of its own name beside the target, and the driver writes the
header last and gives it the target's name, so a job that fails leaves what was there before. Tasks that run again write the same
bytes. Cells that the table lacks are 0; a null is NaN, and an error in an array of whole numbers, as is a cell outside the array.
"""

from __future__ import annotations

import contextlib
import io
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage


class Rows(InputPartition):
    def __init__(self, y0: int, y1: int):
        super().__init__((y0, y1))
        self.y0, self.y1 = y0, y1


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.block = int(options.get("rows", 512))
        self.nonzero = str(options.get("nonzero", "false")).lower() == "true"
        shape = np.load(self.path, mmap_mode="r").shape
        if len(shape) != 2:
            raise ValueError(f"an array of two dimensions is needed, not {len(shape)}")
        box = [int(options.get(k, d)) for k, d in (("y0", 0), ("y1", shape[0]), ("x0", 0), ("x1", shape[1]))]
        self.y0, self.y1, self.x0, self.x1 = max(0, box[0]), min(shape[0], box[1]), max(0, box[2]), min(shape[1], box[3])

    def partitions(self) -> list[Rows]:
        return [Rows(a, min(a + self.block, self.y1)) for a in range(self.y0, self.y1, self.block)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        a = np.load(self.path, mmap_mode="r")
        for y in range(part.y0, part.y1, 64):
            rows = np.asarray(a[y : min(y + 64, part.y1), self.x0 : self.x1], dtype=np.float64)
            yy, xx = np.indices(rows.shape, dtype=np.int32)
            keep = (rows != 0) if self.nonzero else np.ones(rows.shape, dtype=bool)
            v = rows[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(yy[keep] + np.int32(y)), pa.array(xx[keep] + np.int32(self.x0)), pa.array(v, mask=np.isnan(v))], names=["y", "x", "value"]
            )


class NpyWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.shape = options["path"], (int(options["height"]), int(options["width"]))
        self.dtype = np.dtype(options.get("dtype", "f8"))
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, {"descr": np.lib.format.dtype_to_descr(self.dtype), "fortran_order": False, "shape": self.shape})
        self.head, self.part = head.getvalue(), f"{self.path}.{uuid.uuid4().hex}.part"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        file = os.open(self.part, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            for batch in batches:
                y, x, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "x", "value"))
                if len(y) and (y.min() < 0 or x.min() < 0 or y.max() >= self.shape[0] or x.max() >= self.shape[1]):
                    raise ValueError("a cell lies outside the array")
                if self.dtype.kind in "iub" and np.isnan(v.astype(np.float64)).any():
                    raise ValueError("an array of whole numbers has no place for nulls")
                at = y.astype(np.int64) * self.shape[1] + x
                order = np.argsort(at, kind="stable")
                at, v = at[order], v[order].astype(self.dtype)
                # cells side by side go in one write
                for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1) if len(at) else ():
                    os.pwrite(file, v[run].tobytes(), len(self.head) + int(at[run[0]]) * self.dtype.itemsize)
        finally:
            os.close(file)
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        with open(self.part, "ab"):
            pass
        with open(self.part, "r+b") as file:
            file.truncate(len(self.head) + self.shape[0] * self.shape[1] * self.dtype.itemsize)
            file.write(self.head)
        os.replace(self.part, self.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        with contextlib.suppress(FileNotFoundError):
            os.remove(self.part)


class NpyDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "y int, x int, value double"

    def reader(self, schema) -> NpyReader:
        return NpyReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(dict(self.options), overwrite)
