"""Files that tasks write into the shared folder and read from it."""

from __future__ import annotations

import pyarrow.fs as pafs


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; ``file:/x`` and plain paths are local or mounted."""
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def put(folder: str, name: str, data: bytes) -> str:
    """Write a whole file, whose name must hold the attempt: what a failed attempt leaves is then in no list of files."""
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(data)
    return f"{folder}/{name}"


def read_whole(uri: str) -> bytes:
    store, path = open_store(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


def read_range(uri: str, start: int, size: int) -> bytes:
    store, path = open_store(uri)
    with store.open_input_file(path) as f:
        f.seek(start)
        return f.read(size)
