"""The feed as a streaming source with a time cursor: every batch is what came after the cursor.

    spark.dataSource.register(FlowFeed)
    spark.readStream.format("flow_feed").schema(ddl).option("path", folder).option("column", "ts_us").option("after", cursor)

The offset is the largest time read so far. Rows that are written later with a time at or before the offset are not
read, as with any cursor on time. Parquet footers tell which row groups of which files a batch needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


def _open(path: str):
    """The file system of a path and the path inside it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:"):])
    return fs.LocalFileSystem(), path


@dataclass
class RowGroup(InputPartition):
    file: str
    number: int
    after: int
    upto: int


class FeedReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.fieldNames()
        self.path, self.column = options["path"], options.get("column", "ts_us")
        self.first = int(options.get("after", -(2**63)))
        self.footers: dict[str, list[tuple[int, int]]] = {}  # files do not change, so a footer is read once

    def _groups(self) -> dict[str, list[tuple[int, int]]]:
        """Least and largest time of the row groups of every file."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, root = _open(self.path)
        for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.path not in self.footers and info.is_file and info.base_name.endswith(".parquet") and not info.base_name.startswith(("_", ".")):
                with files.open_input_file(info.path) as source:
                    meta = pq.ParquetFile(source).metadata
                at = meta.schema.to_arrow_schema().get_field_index(self.column)
                stats = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
                self.footers[info.path] = [(s.min, s.max) if s is not None and s.has_min_max else (-(2**63), None) for s in stats]
        return self.footers

    def initialOffset(self) -> dict:
        return {"after": self.first}

    def latestOffset(self) -> dict:
        return {"after": max([self.first, *[hi for groups in self._groups().values() for _, hi in groups if hi is not None]])}

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        after, upto = start["after"], end["after"]
        return [RowGroup(file, i, after, upto) for file, groups in sorted(self._groups().items()) for i, (lo, hi) in enumerate(groups)
                if hi is not None and hi > after and lo <= upto]

    def read(self, partition: RowGroup) -> Iterator:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        files, _ = _open(self.path)
        with files.open_input_file(partition.file) as source:
            for batch in pq.ParquetFile(source).iter_batches(row_groups=[partition.number], columns=self.columns):
                t = batch.column(self.column)
                yield batch.filter(pc.and_(pc.greater(t, partition.after), pc.less_equal(t, partition.upto))).select(self.columns)

    def commit(self, end: dict) -> None:
        pass


class FlowFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flow_feed"

    def streamReader(self, schema: StructType) -> FeedReader:
        return FeedReader(schema, self.options)


def read_feed(spark, path: str, ddl: str, after_us: int | None = None, column: str = "ts_us"):
    """The stream of rows later than `after_us`; `column` (a long, one of the columns) holds microseconds."""
    spark.dataSource.register(FlowFeed)
    reader = spark.readStream.format("flow_feed").schema(ddl).option("path", path).option("column", column)
    return (reader if after_us is None else reader.option("after", str(after_us))).load()
