"""Files that tasks write into a shared folder: under an attempt's own name first, then renamed.

A task writes under a name that no other attempt has and returns it as a row of
a written table, so the table lists the files of committed attempts alone. Then
``publish`` renames those to their lasting names; a repeated task finds them
renamed already. Files of lost attempts stay in the attempts' folder, which goes
at the end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, delete_path, make_folder

ATTEMPTS = "_attempts"


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a Hadoop-style URI or an absolute path."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


class Attempt:
    """An open file under a name of its own; ``at`` is the place of the next byte."""

    def __init__(self, folder: str):
        store, path = store_of(f"{folder}/{ATTEMPTS}")
        store.create_dir(path, recursive=True)
        self.name, self.at = uuid.uuid4().hex, 0
        self._out = store.open_output_stream(f"{path}/{self.name}", compression=None)

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.at += len(data)

    def close(self) -> str:
        self._out.close()
        return self.name


def publish(written: DataFrame, folder: str) -> None:
    """Rename the files of ``written`` (attempt, name; repeated rows are one file) to folder/name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(folder)
        for batch in batches:
            for attempt, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = f"{path}/{ATTEMPTS}/{attempt}"
                if store.get_file_info(mine).type != fs.FileType.NotFound:
                    store.move(mine, f"{path}/{name}")
                elif store.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(mine)
            yield pa.RecordBatch.from_arrays([batch.column(1)], names=["name"])

    make_folder(written.sparkSession, folder)
    renamed = Written(written.select("attempt", "name").distinct().mapInArrow(run, "name string"), "published")
    renamed.drop()
    delete_path(written.sparkSession, f"{folder}/{ATTEMPTS}")


def read_ranges(uri: str, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes of each range (offset, length) of a file."""
    store, path = store_of(uri)
    with store.open_input_file(path) as source:
        for offset, length in ranges:
            yield source.read_at(length, offset)


def listing(df: DataFrame, *columns: str, most_tasks: int = 20_000) -> DataFrame:
    """Per file (name) the given columns of its entries as an array of structs in order of offset; a task per file.

    The rows are small and the files they stand for are not, so the number of tasks is set here.
    """
    entries = F.array_sort(F.collect_list(F.struct("offset", *[c for c in columns if c != "offset"])))
    files = max(1, df.select("name").distinct().count())
    return df.groupBy("name").agg(entries.alias("entries")).repartitionByRange(min(files, most_tasks), "name")
