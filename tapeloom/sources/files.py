"""Files by path on any file system that Arrow knows, and folders of parts that are written as one."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage


def open_path(path: str):
    """File system and name of any path that Arrow's file systems know (local, hdfs://, s3://, gs://)."""
    from pyarrow import fs

    if path.startswith(("/", "file:")):
        name = path.removeprefix("file:")
        return fs.LocalFileSystem(), "/" + name.lstrip("/") if name.startswith("/") else name
    return fs.FileSystem.from_uri(path)


def list_files(path: str) -> list[tuple[str, int]]:
    """Path and size of a file, or of the files of a folder by name; hidden ones and folders are left out."""
    from pyarrow import fs

    system, name = open_path(path)
    info = system.get_file_info(name)
    scheme = path[: len(path) - len(name)] if path.endswith(name) else ""
    found = system.get_file_info(fs.FileSelector(name)) if info.type == fs.FileType.Directory else [info]
    return sorted((scheme + f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str


class PartsWriter(DataSourceArrowWriter):
    """Writes each task's rows to a file of its own in a hidden folder; when all tasks are done, the files become part-000000.bin and so on, in the tasks' order.

    Until then nothing is seen under the path. If a task fails for good, the hidden folder goes and no file is left. An attempt that was repeated
    or lost writes under a name of its own, and only the attempt that Spark commits is taken. `encode` makes bytes of a batch.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.hidden = f"{path.rstrip('/')}/_writing-{uuid.uuid4().hex}"

    def encode(self, batch: pa.RecordBatch) -> bytes:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = open_path(self.hidden)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/{uuid.uuid4().hex}"
        with system.open_output_stream(name, compression=None) as f:
            for batch in iterator:
                if batch.num_rows:
                    f.write(self.encode(batch))
        return Written(TaskContext.get().partitionId(), name)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = open_path(self.path)
        system.create_dir(folder, recursive=True)
        old = list_files(self.path)
        if self.overwrite:
            for path, _ in old:
                system.delete_file(open_path(path)[1])
            old = []
        first = max((int(p.rsplit("-", 1)[1].removesuffix(".bin")) + 1 for p, _ in old), default=0)
        for k, m in enumerate(sorted((m for m in messages if m), key=lambda m: m.partition), first):
            system.move(m.name, f"{folder}/part-{k:06d}.bin")
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, folder = open_path(self.hidden)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)
