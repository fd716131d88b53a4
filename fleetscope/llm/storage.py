"""Binary part files in a folder that all executors share, by its URI.

Each attempt of a task writes names of its own; only names that come back in a
committed result count, so a lost or repeated task leaves no half-read file.
"""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyarrow import fs


def _place(uri: str):
    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file:///") else "file://" + uri[5:])


def create_folder(uri: str) -> None:
    system, path = _place(uri)
    system.create_dir(path, recursive=True)


def new_stem() -> str:
    return uuid.uuid4().hex


class PartFile:
    """One part file, open for writing."""

    def __init__(self, folder: str, name: str):
        system, path = _place(folder)
        self.name = name
        self.stream = system.open_output_stream(f"{path}/{name}", compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Appends ``data``; returns where it starts."""
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.stream.close()


def open_part(folder: str, name: str):
    system, path = _place(folder)
    return system.open_input_file(f"{path}/{name}")
