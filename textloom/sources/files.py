"""Whole text files of a folder as a Spark data source, hidden names and empty files included.

Spark's own file sources skip names that start with ``_`` or ``.``, yield no row for an empty file,
and list the folder on the driver. This one lists it in the tasks: each opens the files whose names
fall to it by hash, or the listed ones among them.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "whole_text_files"
# Files that one task opens, about, where the number of files is known.
FILES_PER_TASK = 200
# Characters of a batch that a task hands over; one longer file is a batch of its own.
BATCH_CHARACTERS = 8_000_000


class _Share(InputPartition):
    """Names that fall to one task: those listed, or all whose hash does."""

    def __init__(self, number: int, of: int, listed: list[tuple[int, str]] | None):
        super().__init__(number)
        self.number, self.of, self.listed = number, of, listed


class WholeTextFiles(DataSource):
    """``name, text, list_pos`` of the files directly in ``path`` whose names end in ``suffix``.

    Options: ``path`` (a folder, as a local path or a URI that pyarrow knows), ``suffix``, ``names``
    (a JSON list: only these are opened, ``list_pos`` being the place in the list; a name without a
    file fails) and ``tasks``. Without ``names``, ``list_pos`` is null.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, text string, list_pos int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.names = json.loads(options["names"]) if "names" in options else None
        self.tasks = max(1, int(options.get("tasks", 1)))

    def partitions(self) -> Sequence[InputPartition]:
        if self.names is None:
            return [_Share(i, self.tasks, None) for i in range(self.tasks)]
        # A name that is listed twice is opened once, by one task.
        tasks = max(1, min(self.tasks, -(-len(self.names) // FILES_PER_TASK)))
        listed = list(enumerate(self.names))
        return [_Share(i, tasks, [x for x in listed if zlib.crc32(x[1].encode()) % tasks == i]) for i in range(tasks)]

    def read(self, partition: _Share) -> Iterator:
        """Arrow batches bounded by their characters: Spark's own batches of rows hold 10,000 files."""
        import pyarrow as pa

        kinds = pa.schema([("name", pa.string()), ("text", pa.string()), ("list_pos", pa.int32())])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

        rows, size = [], 0
        for row in self._files(partition):
            if rows and size + len(row[1]) > BATCH_CHARACTERS:
                yield batch(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[1]) + 100
        if rows:
            yield batch(rows)

    def _files(self, partition: _Share) -> Iterator[tuple]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

        def text(name: str) -> str:
            with system.open_input_stream(f"{folder}/{name}{self.suffix}") as file:
                return file.read().decode("utf-8", "replace")

        if partition.listed is not None:
            places: dict[str, list[int]] = {}
            for place, name in partition.listed:
                places.setdefault(name, []).append(place)
            for name, at in places.items():
                content = text(name)
                for place in at:
                    yield name, content, place
            return
        for info in system.get_file_info(fs.FileSelector(folder)):
            name = info.base_name
            mine = info.type == fs.FileType.File and name.endswith(self.suffix)
            if mine and zlib.crc32(name.encode()) % partition.of == partition.number:
                yield name, text(name.removesuffix(self.suffix)), None


def read_files(
    spark: SparkSession, folder: str, suffix: str, names: Sequence[str] | None = None, tasks: int | None = None
) -> DataFrame:
    """``name, text, list_pos``; see ``WholeTextFiles``. ``name`` has no suffix if ``names`` are given."""
    spark.dataSource.register(WholeTextFiles)
    reader = spark.read.format(FORMAT).option("path", folder.rstrip("/")).option("suffix", suffix)
    reader = reader.option("tasks", tasks or spark.sparkContext.defaultParallelism)
    if names is not None:
        reader = reader.option("names", json.dumps(list(names)))
    return reader.load()
