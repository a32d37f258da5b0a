"""Files that tasks write and read in the shared folder, in any file system that Arrow knows."""

from __future__ import annotations

import uuid

from pyarrow import fs


def create(folder: str, suffix: str) -> tuple[str, object]:
    """Opens a new file; its name is never used again, so that a repeated task disturbs nothing."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder.rstrip('/')}/{name}", system.open_output_stream(f"{path.rstrip('/')}/{name}", compression=None, buffer_size=1 << 20)


def open_file(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def read(uri: str) -> bytes:
    with open_file(uri) as f:
        return f.read()
