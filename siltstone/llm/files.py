"""Files in the shared folder, from driver and executors, on any file system that pyarrow opens."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@contextmanager
def written(folder: str, name: str):
    """A stream to folder/name. The file appears under its name only when whole; a repeated task replaces it."""
    system, base = opened(folder)
    system.create_dir(base, recursive=True)
    tmp = f"{base}/_{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(tmp, buffer_size=1 << 20) as out:
        yield out
    system.move(tmp, f"{base}/{name}")


def listed(folder: str, suffix: str) -> list[tuple[str, int]]:
    """(name, size) of the files of a folder with a suffix, in order of name."""
    system, base = opened(folder)
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name.endswith(suffix) and not f.base_name.startswith("_"))
