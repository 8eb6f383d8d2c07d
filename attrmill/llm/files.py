"""Binary files in the shared folder, from tasks. Paths may be plain or URIs that
Arrow's file systems know. A file appears under its name only when complete."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyarrow import fs


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_file(folder: str, stem: str, ending: str, parts: Iterable[bytes]) -> str:
    """Writes the parts to a new file folder/stem-<unique>.ending and returns its path.
    Every attempt of a task writes a file of its own, so none changes another's."""
    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex[:12]}.{ending}"
    with store.open_output_stream(f"{base}/.{name}", compression=None) as out:
        for p in parts:
            out.write(p)
    store.move(f"{base}/.{name}", f"{base}/{name}")
    return f"{folder.rstrip('/')}/{name}"


def open_read(path: str):
    store, at = _open(path)
    return store.open_input_file(at)
