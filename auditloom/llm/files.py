"""Binary files in the shared folder, written and read by tasks through Arrow's file systems."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def task_file(folder: str, suffix: str) -> str:
    """A new file name for one attempt of one task.

    A repeated attempt gets another name. Only the names in the committed
    result of the job count, so what a lost executor left behind is never read.
    """
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def open_output(uri: str):
    store, path = _store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def open_input(uri: str):
    store, path = _store(uri)
    return store.open_input_stream(path, compression=None)


def open_mapped(uri: str):
    """Random access; a local file is mapped into memory, not read."""
    import pyarrow as pa

    store, path = _store(uri)
    return pa.memory_map(path) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(path)
