"""Writing and opening files in the shared folder from tasks, by URI."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


@contextmanager
def committed(uri: str) -> Iterator:
    """An output stream whose file appears under uri only once it is whole; a task that runs twice writes it twice, alike."""
    system, path = fs.FileSystem.from_uri(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    draft = f"{folder}/_draft-{name}-{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(draft, compression=None) as out:
            yield out
    except BaseException:
        system.delete_file(draft)
        raise
    system.move(draft, path)


def opened(uri: str, seekable: bool = False):
    """The file under uri, for reading."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path) if seekable else system.open_input_stream(path, compression=None)
