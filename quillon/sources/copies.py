"""Copies of files by Spark tasks, with a commit: what fails, is retried or runs twice leaves no halves behind."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from quillon.operators.scratch import Scratch

#: Bytes read at a time.
CHUNK = 4 << 20


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def copy_files(files: DataFrame, root: str, out: str, path: str = "path") -> int:
    """Copies the files (paths below root) under out, each where it was below root, and gives their number. What stands there is replaced.

    Each attempt of a task copies under a name of its own; the table of what was copied, which holds one attempt of each file, is written,
    and then its files are renamed into place. A rename that is tried again finds its file there already. If copying fails nothing has changed below out.
    """
    held = f"{out}/_copying-{uuid.uuid4().hex}"
    top = root.rstrip("/") + "/"

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = uuid.uuid4().hex
        for batch in batches:
            names = [p[p.index(top) + len(top) :] for p in batch.column(path).to_pylist()]
            copied = [f"{held}/{attempt}/{n}" for n in names]
            for source, target in zip(batch.column(path).to_pylist(), copied):
                (a, from_), (b, to) = _at(source), _at(target)
                b.create_dir(os.path.dirname(to))
                with a.open_input_stream(from_) as reader, b.open_output_stream(to) as writer:
                    while chunk := reader.read(CHUNK):
                        writer.write(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(copied, pa.string())], ["name", "copied"])

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, copied in zip(*(batch.column(c).to_pylist() for c in ("name", "copied"))):
                (system, from_), (_, to) = _at(copied), _at(f"{out}/{name}")
                system.create_dir(os.path.dirname(to))
                if system.get_file_info(from_).type != fs.FileType.NotFound or system.get_file_info(to).type == fs.FileType.NotFound:
                    system.move(from_, to)
            yield batch.select(["name"])

    try:
        table = Scratch(files.sparkSession, "copies").table(files.select(path).distinct().mapInArrow(copy, "name string, copied string"), "copied")
        return table.mapInArrow(commit, "name string").count()
    finally:
        system, folder = _at(held)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)
