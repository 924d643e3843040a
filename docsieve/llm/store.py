"""Arrays in the shared folder that tasks write once and workers map into memory."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI or plain path; None for any other store."""
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def write_bytes(folder: str, name: str, data: bytes | memoryview) -> None:
    """Write a file whole or not at all: a task that runs twice leaves the same file."""
    path = local_path(folder)
    if path is None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part = f"{root}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(data)
        store.move(part, f"{root}/{name}")
        return
    os.makedirs(path, exist_ok=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.write(data)
    os.replace(part, f"{path}/{name}")


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    write_bytes(folder, name, np.ascontiguousarray(values).view(np.uint8).data)


def open_array(folder: str, name: str, dtype) -> np.ndarray:
    """A read-only mapped array; empty if there is no such file.  From a store that cannot be
    mapped, the file is copied to an unnamed temporary one first."""
    path = local_path(folder)
    if path is not None:
        path = f"{path}/{name}"
        if not os.path.exists(path) or not os.path.getsize(path):
            return np.empty(0, dtype=dtype)
        return np.memmap(path, dtype=dtype, mode="r")
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
        return np.empty(0, dtype=dtype)
    copy = tempfile.TemporaryFile()
    with store.open_input_stream(f"{root}/{name}") as source:
        while block := source.read(1 << 22):
            copy.write(block)
    return np.memmap(copy, dtype=dtype, mode="r") if copy.tell() else np.empty(0, dtype=dtype)


class Output:
    """A file written as a stream, in place only when closed without an error."""

    def __init__(self, folder: str, name: str):
        self.path, self.name, self.at = local_path(folder), name, 0
        part = f".{name}-{uuid.uuid4().hex}"
        if self.path is not None:
            os.makedirs(self.path, exist_ok=True)
            self.part, self.out = f"{self.path}/{part}", open(f"{self.path}/{part}", "wb")
            return
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.root, recursive=True)
        self.part = f"{self.root}/{part}"
        self.out = self.store.open_output_stream(self.part)

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def __enter__(self) -> Output:
        return self

    def __exit__(self, kind, *_) -> None:
        self.out.close()
        if kind is None and self.path is not None:
            os.replace(self.part, f"{self.path}/{self.name}")
        elif kind is None:
            self.store.move(self.part, f"{self.root}/{self.name}")
        elif self.path is not None:
            os.remove(self.part)
        else:
            self.store.delete_file(self.part)


def open_file(folder: str, name: str):
    """A seekable file of the shared folder, for reading."""
    path = local_path(folder)
    if path is not None:
        return open(f"{path}/{name}", "rb")
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    return store.open_input_file(f"{root}/{name}")
