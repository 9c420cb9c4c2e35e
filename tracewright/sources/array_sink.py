"""One JSON array file out of many tasks: each task writes its part, and the commit puts the parts together.

A Python data source. A task writes the elements of its partition to a part file of its own attempt, in a folder beside the target. If
the job ends well the driver joins the parts of the attempts that succeeded, in the order of partitions, with brackets
and commas, and renames the result into place; if it does not, the folder is removed and the target is as it was. Only file
names and counts go to the driver; it copies bytes block by block, as one file has to be written by one writer.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

_BLOCK = 4 << 20
_TRIES = 20


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str
    rows: int


class ArrayWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.indent = options["path"], int(options.get("indent", 2))
        self.folder = f"{self.path.rstrip('/')}.parts-{uuid.uuid4().hex}"
        system, folder = self._at(self.folder)
        system.create_dir(folder, recursive=True)  # here and not by tasks, as one that outlives its job's end would bring the folder back

    def _at(self, path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def write(self, iterator) -> Part:
        """Elements of one partition, each indented as a member of the array and followed by a line feed."""
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        system, folder = self._at(self.folder)
        rows = 0
        with system.open_output_stream(f"{folder}/{name}") as out:
            for row in iterator:
                text = json.dumps(json.loads(row[0]), ensure_ascii=False, indent=self.indent or None)
                lines = text.replace("\n", "\n" + " " * self.indent)
                out.write(((",\n" if rows else "") + " " * self.indent + lines).encode())
                rows += 1
        return Part(task.partitionId(), name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        system, folder = self._at(self.folder)
        whole, filled = f"{folder}/whole", False
        with system.open_output_stream(whole) as out:
            out.write(b"[")
            for part in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition):
                out.write(b",\n" if filled else b"\n")
                with system.open_input_stream(f"{folder}/{part.name}") as source:
                    while block := source.read(_BLOCK):
                        out.write(block)
                filled = True
            out.write(b"\n]\n" if filled else b"]\n")
        system.move(whole, self._at(self.path)[1])
        system.delete_dir(folder)

    def abort(self, messages: list[Part | None]) -> None:
        system, folder = self._at(self.folder)
        for left in range(_TRIES, -1, -1):  # a task that still runs may put its part in while the folder is emptied
            if system.get_file_info(folder).type != fs.FileType.Directory:
                return
            try:
                system.delete_dir(folder)
            except OSError:
                if not left:
                    raise
                time.sleep(0.05)


class ArraySink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tracewright_json_array"

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        if not overwrite:
            raise ValueError("an array file is written whole: use overwrite")
        return ArrayWriter(self.options)


def write_array(rows: DataFrame, path: str, order: list[Column] | None = None, indent: int = 2) -> None:
    """All ``rows`` as one JSON array of objects in the order of ``order`` (or of their partitions): valid JSON, nulls included.

    ``path`` must be in a folder or store that all machines write to. Ranges of the order are written in parallel. A table without rows gives ``[]``.
    A number that JSON lacks (NaN, infinite) becomes text, as in Spark's own writer.
    """
    spark = rows.sparkSession
    spark.dataSource.register(ArraySink)
    dealt = rows
    if order:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    record = F.to_json(F.struct(*[dealt[f"`{c}`"] for c in rows.columns]), {"ignoreNullFields": "false"})
    dealt.select(record.alias("record")).write.format(ArraySink.name()).mode("overwrite").option("indent", str(indent)).save(path)
