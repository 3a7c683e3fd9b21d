"""Folder listing and file reading in tasks, with no filter on names.

Spark's own file sources hide names that begin with ``_`` or ``.`` and give no
row for an empty file, which a corpus of source code cannot do without. Kept
free of package imports: the functions travel to the workers by value.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle

BATCH_BYTES = 16 << 20


def _store(path: str):
    """The file system of a path, the path inside it, and what stands before."""
    if "://" in path:
        store, inside = pafs.FileSystem.from_uri(path)
    else:
        plain = path.removeprefix("file:")
        store, inside = pafs.LocalFileSystem(), plain
    return store, inside, path[: len(path) - len(inside)] if path.endswith(inside) else ""


def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of each folder: (path, is_dir, size_bytes, error).

    Links to folders are not followed. A folder that cannot be read gives one
    row with the error.
    """
    for batch in batches:
        rows = []
        for path in batch.column("path").to_pylist():
            store, inside, head = _store(path)
            try:
                found = store.get_file_info(pafs.FileSelector(inside))
            except OSError as e:
                rows.append((path, False, None, type(e).__name__))
                continue
            for f in found:
                folder = f.type == pafs.FileType.Directory
                if folder and store.type_name == "local" and os.path.islink(f.path):
                    continue
                rows.append((head + f.path, folder, None if folder else f.size, None))
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        kinds = (pa.string(), pa.bool_(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "is_dir", "size_bytes", "error"]
        )


def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``content`` to (path, size_bytes, error); a file that cannot be
    read keeps a null content and gets the error."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "size_bytes", "error", "content"]
        )

    for batch in batches:
        rows, held = [], 0
        for path, size, error in zip(*(batch.column(c).to_pylist() for c in ("path", "size_bytes", "error"))):
            content = None
            if error is None:
                store, inside, _ = _store(path)
                try:
                    with store.open_input_stream(inside) as f:
                        content = f.read()
                except OSError as e:
                    error = type(e).__name__
            rows.append((path, size, error, content))
            held += len(content or b"")
            if held > BATCH_BYTES:
                yield packed(rows)
                rows, held = [], 0
        if rows:
            yield packed(rows)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
