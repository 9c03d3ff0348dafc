"""Files of the shared folder, opened from tasks."""

from __future__ import annotations

from pyarrow import fs as pafs


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The filesystem of a path or URI, and the path inside it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def make_folder(path: str) -> str:
    filesystem, local = open_fs(path)
    filesystem.create_dir(local, recursive=True)
    return path


def read_bytes(path: str) -> bytes:
    filesystem, local = open_fs(path)
    with filesystem.open_input_file(local) as source:
        return source.read()


def write_bytes(path: str, data: bytes) -> None:
    filesystem, local = open_fs(path)
    with filesystem.open_output_stream(local) as out:
        out.write(data)
