"""Rows as objects at given paths, written by the executors, each created once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

WRITTEN = "object_path string, created boolean"


def write_objects(rows: DataFrame, root: str) -> DataFrame:
    """Write `content` to `{root}/{object_path}` for each row, unless there is an object already; lazy.

    `(object_path, created)` comes back. Content goes to a name of its own first and is then moved, so that
    no reader sees half an object, and a task that is run again finds its work done. `root` is a path or a URI that Arrow's
    file systems know.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            paths, created = batch.column("object_path").to_pylist(), []
            for path, content in zip(paths, batch.column("content")):
                target = f"{top}/{path}"
                missing = store.get_file_info(target).type == fs.FileType.NotFound
                if missing:
                    folder, _, name = target.rpartition("/")
                    store.create_dir(folder, recursive=True)
                    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                    with store.open_output_stream(part) as out:
                        out.write(content.as_buffer() or b"")
                    store.move(part, target)
                created.append(missing)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(created, pa.bool_())], ["object_path", "created"])

    return rows.select("object_path", "content").mapInArrow(write, WRITTEN)
