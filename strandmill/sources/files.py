"""File systems behind paths, seen from the driver and from tasks alike."""

from __future__ import annotations

import gzip
from typing import BinaryIO

from pyarrow import fs


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a path without a scheme is local."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    if path.startswith("s3a://"):
        path = "s3" + path.removeprefix("s3a")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def is_gzip(path: str) -> bool:
    """Whether a file is compressed: its extension is exactly ``gz``, whatever it holds."""
    name = path.rsplit("/", 1)[-1]
    return "." in name.lstrip(".") and name.rsplit(".", 1)[1] == "gz" and name != ".gz"


def size(path: str) -> int:
    """Bytes of a file; a missing one is an error."""
    system, inner = resolve(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return info.size


def is_file(path: str) -> bool:
    """Whether a path names a single file."""
    system, inner = resolve(path)
    return system.get_file_info(inner).type == fs.FileType.File


def open_stored(path: str) -> BinaryIO:
    """The stored bytes, seekable."""
    system, inner = resolve(path)
    return system.open_input_file(inner)


def open_text(path: str) -> BinaryIO:
    """The decompressed bytes in order; gzip members follow each other as one stream."""
    return gzip.GzipFile(fileobj=open_stored(path)) if is_gzip(path) else open_stored(path)


def open_new(path: str) -> BinaryIO:
    """A file to be written, emptied if it exists."""
    system, inner = resolve(path)
    return system.open_output_stream(inner, compression=None)


def is_local(path: str) -> bool:
    """Whether a path is in a file system of the machine, where any place of a file can be written."""
    return isinstance(resolve(path)[0], fs.LocalFileSystem)


def open_at(path: str, place: int) -> BinaryIO:
    """A local file that exists, to be written from a place on."""
    f = open(resolve(path)[1], "r+b")
    f.seek(place)
    return f


def reserve(path: str, size: int) -> None:
    """A new local file of so many bytes, to be written by several tasks at once."""
    with open(resolve(path)[1], "wb") as f:
        f.truncate(size)


def replace(path: str, target: str) -> None:
    """Puts a file in the place of another, or of none, in one step where the file system can."""
    system, inner = resolve(path)
    system.move(inner, resolve(target)[1])


def remove(path: str) -> None:
    """Deletes a file if it's there."""
    system, inner = resolve(path)
    if system.get_file_info(inner).type == fs.FileType.File:
        system.delete_file(inner)


def make_folder(path: str) -> None:
    system, inner = resolve(path)
    system.create_dir(inner, recursive=True)


def remove_folder(path: str) -> None:
    """Deletes a folder with all it holds, if it's there."""
    system, inner = resolve(path)
    if system.get_file_info(inner).type == fs.FileType.Directory:
        system.delete_dir(inner)
