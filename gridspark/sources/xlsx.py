"""Workbook files as a Spark data source: `register(spark)`, then `spark.read.format("xlsx_cells").load(path)`.

Each sheet of each file is a partition of its own. A task opens its file, reads the parts that it needs from the archive and
streams its sheet, so that it holds a chunk of cells, the shared texts and the styles, but neither the sheet nor the other ones.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridspark.sources.workbooks import CELLS, CHUNK, Workbook

NAME = "xlsx_cells"
ARROW = pa.schema(
    [("wb_id", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("col", pa.int32()), ("kind", pa.string()), ("s", pa.string()), ("n", pa.float64()), ("b", pa.bool_()), ("ts", pa.timestamp("us", "UTC")), ("formula", pa.string())]
)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Sheet(InputPartition):
    """One sheet of one file, by its place in the workbook."""

    uri: str
    wb_id: str
    place: int

    def __post_init__(self):
        super().__init__(None)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.data_only = options["path"], options.get("dataonly", "false").lower() == "true"

    def files(self) -> list[tuple[str, str]]:
        """(URI, path below the folder) of all .xlsx files, in order."""
        system, path = located(self.path)
        scheme = self.path[: self.path.index("://") + 3] if "://" in self.path else ""
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        under = lambda p: p[len(path) :].strip("/") or p.rpartition("/")[2]
        return sorted((scheme + f.path, under(f.path)) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".xlsx"))

    def partitions(self) -> list[Sheet]:
        """Only the list of sheets of each file is read here."""
        out = []
        for uri, wb_id in self.files():
            system, path = located(uri)
            with system.open_input_file(path) as file:
                out += [Sheet(uri, wb_id, i) for i in range(len(Workbook(file).sheets))]
        return out

    def read(self, partition: Sheet | None):
        if partition is None:  # without files
            return
        system, path = located(partition.uri)
        with system.open_input_file(path) as file:
            rows = ((partition.wb_id, *row) for row in Workbook(file).cells(self.data_only, partition.place))
            for some in itertools.batched(rows, CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some, strict=True), ARROW, strict=True)], schema=ARROW)


class XlsxCells(DataSource):
    """Cells of .xlsx files under a path: wb_id is the file's path below it. Option dataonly: stored values in place of formulas.

    Paths are those that pyarrow's file systems reach (local, s3, gs, hdfs); for other stores read_workbooks() takes whole files
    through Spark.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxCells)
