"""Spectra in NPZ files as a Spark source: ``spark.read.format("spectra_npz").load(folder)`` after ``register(spark)``.

A file holds time, energy (once, or a row a time), th1_probability and th2_probability, and whatever else has a row a time. Partitions are planned by
file and by range of rows within it: only the headers of arrays are read for that, and a task reads its rows as a stream. Filters on date
and kind, which file names tell, are taken down to the list of files: others are not opened.
"""

from __future__ import annotations

import contextlib
import datetime
import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

# The arrays that a file must have, and the parts of its name.
REQUIRED = ("time", "energy", "th1_probability", "th2_probability")
DATE, KIND = r"(20\d{6})", r"(?i)(?:^|[_-])(TH1|TH2|BLK|MAG)(?:[_-])"
#: Rows of a partition, at most, and of a batch.
ROWS, BATCH = 50_000, 1_000
SCHEMA = "file string, date string, kind string, time timestamp_ntz, energy array<double>, th1_probability array<double>, th2_probability array<double>"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SpectraSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


@dataclass
class Rows(InputPartition):
    """Rows from first up to end of one file."""

    path: str
    first: int
    end: int


class Member:
    """An array of an NPZ file, read row by row from the front; rows that are not asked for are skipped."""

    def __init__(self, archive: zipfile.ZipFile, name: str):
        self.file = archive.open(f"{name}.npy")
        version = np.lib.format.read_magic(self.file)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, fortran, self.dtype = read(self.file)
        if self.dtype.hasobject or fortran and len(self.shape) > 1:
            raise ValueError(f"unreadable: {name} is not a plain array by rows")
        self.row = int(np.prod(self.shape[1:], dtype=np.int64)) * self.dtype.itemsize

    def skip(self, rows: int) -> None:
        self.file.seek(rows * self.row, io.SEEK_CUR)  # stored members jump, compressed ones are read through

    def take(self, rows: int) -> np.ndarray:
        data = self.file.read(rows * self.row)
        if len(data) != rows * self.row:
            raise ValueError("unreadable: the file ends too early")
        return np.frombuffer(data, self.dtype).reshape(rows, *self.shape[1:])


def _times(values: np.ndarray) -> pa.Array:
    if values.dtype.kind in "SU":
        values = np.array([datetime.datetime.fromisoformat(v.decode() if isinstance(v, bytes) else str(v)).replace(tzinfo=None) for v in values], "datetime64[us]")
    return pa.array(values.astype("datetime64[us]"), pa.timestamp("us"))


def _lists(values: np.ndarray) -> pa.Array:
    """Rows of numbers; NaN is null."""
    flat = values.astype(float).ravel()
    width = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * width, pa.int32()), pa.array(flat, pa.float64(), mask=np.isnan(flat)))


class SpectraReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = schema.names
        if "path" not in options:
            raise ValueError("the source needs a path")
        self.path, self.rows = options["path"], int(options.get("rows", ROWS))
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what compares date or kind with a value; the rest stays with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("date",), ("kind",)):
                self.wanted.append(f)
            else:
                yield f

    def _fits(self, name: str) -> bool:
        have = dict(zip(("date", "kind"), name_parts(name)))
        for f in self.wanted:
            v = have[f.attribute[0]]
            test = {EqualTo: lambda: v == f.value, In: lambda: v in f.value, GreaterThan: lambda: v > f.value, GreaterThanOrEqual: lambda: v >= f.value, LessThan: lambda: v < f.value, LessThanOrEqual: lambda: v <= f.value}  # noqa: B023
            if v is None or not test[type(f)]():
                return False
        return True

    def files(self) -> list[str]:
        system, root = _system(self.path)
        if system.get_file_info(root).type == pafs.FileType.File:
            found = [root]
        else:
            found = [x.path for x in system.get_file_info(pafs.FileSelector(root, recursive=True)) if x.type == pafs.FileType.File and x.path.lower().endswith(".npz")]
        return sorted(x for x in found if self._fits(_name(x)))

    def partitions(self) -> list[InputPartition]:
        out = []
        system, _ = _system(self.path)
        for path in self.files():
            with system.open_input_file(path) as f, _archive(f) as archive:
                n = checked(archive)
            out += [Rows(path, a, min(a + self.rows, n)) for a in range(0, n, self.rows)]
        return out

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where no file is left
            return
        system, _ = _system(self.path)
        date, kind = name_parts(_name(partition.path))
        with contextlib.ExitStack() as opened:
            # a handle each, as they are read in turns
            archive = lambda: opened.enter_context(_archive(opened.enter_context(system.open_input_file(partition.path))))
            columns = {c: Member(archive(), c) for c in REQUIRED if c in self.names}
            once = "energy" in columns and len(columns["energy"].shape) == 1
            energy = columns["energy"].take(columns.pop("energy").shape[0]) if once else None
            for m in columns.values():
                m.skip(partition.first)
            for at in range(partition.first, partition.end, BATCH):
                n = min(BATCH, partition.end - at)
                made = {"file": pa.array([_name(partition.path)] * n), "date": pa.array([date] * n, pa.string()), "kind": pa.array([kind] * n, pa.string())}
                made |= {c: _times(m.take(n)) if c == "time" else _lists(m.take(n)) for c, m in columns.items()}
                if once:
                    made["energy"] = _lists(np.tile(energy, (n, 1)))
                yield pa.RecordBatch.from_arrays([made[c] for c in self.names], self.names)


class SpectraSource(DataSource):
    """Options: path, a folder (searched whole) or a file, of any store that pyarrow opens; rows, of a partition at most."""

    @classmethod
    def name(cls) -> str:
        return "spectra_npz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return SpectraReader(schema, self.options)


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _archive(file) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(file)
    except zipfile.BadZipFile as e:
        raise ValueError(f"unreadable: {e}") from e


def name_parts(name: str) -> tuple[str | None, str | None]:
    """Date (yyyymmdd) and kind in a file's name."""
    date, kind = re.search(DATE, name), re.search(KIND, name)
    return date and date.group(1), kind and kind.group(1).upper()


def columns_length(archive: zipfile.ZipFile, name: str) -> int:
    shape = Member(archive, name).shape
    return shape[0] if shape else 0


def checked(archive: zipfile.ZipFile) -> int:
    """The number of times, by headers alone; fails if arrays lack or differ in length."""
    there = {x.removesuffix(".npy") for x in archive.namelist()}
    if lacking := sorted(set(REQUIRED) - there):
        raise ValueError("missing keys: " + ", ".join(lacking))
    n = columns_length(archive, "time")
    rows = [c for c in REQUIRED[2:] if columns_length(archive, c) != n]
    if rows or len(Member(archive, "energy").shape) == 2 and columns_length(archive, "energy") != n:
        raise ValueError("time/probability length mismatch")
    return n
