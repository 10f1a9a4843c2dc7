"""Bytes of files that tasks open by themselves: parts of a file, digests of files larger than memory."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyarrow import fs

CHUNK = 1 << 20


def system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is a local one."""
    found = re.match(r"(\w+):(.*)", path, re.S)
    if not found:
        return fs.LocalFileSystem(), path
    scheme, rest = found.groups()
    if scheme == "file":
        return fs.LocalFileSystem(), re.sub(r"^/*", "/", rest)
    return fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + rest)


def digest(path: str) -> str:
    """SHA-256 of a file, a megabyte at a time."""
    where, name = system(path)
    h = hashlib.sha256()
    with where.open_input_stream(name) as f:
        while chunk := f.read(CHUNK):
            h.update(chunk)
    return h.hexdigest()


def put(path: str, data: bytes) -> None:
    """Writes a file under another name and renames it: whoever reads ``path`` reads all of it."""
    where, name = system(path)
    where.create_dir(name.rpartition("/")[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}.part"
    with where.open_output_stream(part) as f:
        f.write(data)
    where.move(part, name)


def small(path: str, most: int = CHUNK) -> str | None:
    """The text of a file of ``most`` bytes at most, None without such a file or where it is larger or no UTF-8."""
    where, name = system(path)
    info = where.get_file_info(name)
    if info.type != fs.FileType.File or info.size > most:
        return None
    with where.open_input_stream(name) as f:
        try:
            return f.read().decode()
        except UnicodeDecodeError:
            return None
