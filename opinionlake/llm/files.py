"""Files that tasks write to and read from the shared folder, whatever store it is in."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(path: str):
    """File system and path; a bare path is on the shared mount."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def make_folder(path: str) -> None:
    store, at = _at(path)
    store.create_dir(at, recursive=True)


def save(folder: str, name: str, data: bytes) -> str:
    """Writes under a name of its own, so a repeated task never touches the file of another attempt; the returned path is what counts."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    with Writer(path) as out:
        out.write(data)
    return path


class Writer:
    def __init__(self, path: str):
        store, at = _at(path)
        self.path, self._out = path, store.open_output_stream(at)

    def write(self, data: bytes) -> None:
        self._out.write(data)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self._out.close()


def load(path: str) -> bytes:
    store, at = _at(path)
    with store.open_input_stream(at) as source:
        return source.read()


def open_random(path: str):
    store, at = _at(path)
    return store.open_input_file(at)
