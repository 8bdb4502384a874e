"""Files that tasks write to and read from the shared folder, by any address Arrow knows."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


@contextmanager
def committed(folder: str, name: str):
    """A stream to a file that appears under its name only when it is whole.

    A task that is run again, or twice at once, writes the same bytes under the same name.
    """
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as stream:
        yield stream
    system.move(temporary, f"{path}/{name}")
