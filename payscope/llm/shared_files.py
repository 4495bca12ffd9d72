"""Files in the folder that all executors share, beside Spark's own tables."""

from __future__ import annotations

import os
import tempfile

import numpy as np

from payscope.llm.shared import local_path


def save(uri: str, data: bytes) -> None:
    """Write a file of the shared folder as a whole, so that a task that is run again may do it again."""
    path = local_path(uri)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path))
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        os.replace(temporary, path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(path))
        with store.open_output_stream(path) as f:
            f.write(data)


def mapped(uri: str, kind: type) -> np.ndarray:
    """A file of the shared folder as a memory-mapped array, empty if there is none.

    If the folder isn't mounted, the file is fetched to the worker's own disk and its name removed once it is mapped,
    so the copy goes when the worker lets go of the array, however that ends.
    """
    path = local_path(uri)
    remote = not path
    if remote:
        from pyarrow import fs

        store, there = fs.FileSystem.from_uri(uri)
        if store.get_file_info(there).type == fs.FileType.NotFound:
            return np.zeros(0, kind)
        handle, path = tempfile.mkstemp()
        with store.open_input_stream(there) as f, os.fdopen(handle, "wb") as out:
            while chunk := f.read(1 << 22):
                out.write(chunk)
    try:
        return np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)
    finally:
        if remote:
            os.unlink(path)
